import io
import zipfile

import pytest

from foliomill.operators import markup as M
from foliomill.sources import epub

PAGE = (
    b'<html><head><title>T</title></head><body><h1>Head</h1>loose <span class="i">text</span><br/>more&nbsp;here <span><p>inner</p></span><img src="a.png"/>'
    b"<pre>code</pre><ul><li>one <b>two</b></li></ul><p> </p></body></html>"
)


def parse(data):
    return M.parse_document(data)[0]


def test_segments():
    segs = M.extract_segments(parse(PAGE))
    assert [s.text for s in segs] == ["Head", "loose <x1>text</x1><x2/>more here", "inner", "<x1/><x2/>", "one <x1>two</x1>"]
    assert [s.translatable for s in segs] == [True, True, True, False, True]
    assert segs[1].voids == {2}


def test_identity_round_trip():
    root = parse(PAGE)
    before = M.serialize(root)
    for s in M.extract_segments(root):
        assert M.apply_translation(s, s.text) == []
    M.unwrap_runs(root)
    assert " ".join(M.serialize(root).split()) == " ".join(before.replace("\xa0", " ").split())


def test_damaged_translation():
    root = parse(b"<html><body><p>a <i>b</i> c<br/>d &lt;</p></body></html>")
    seg = M.extract_segments(root)[0]
    problems = M.apply_translation(seg, "A <x1>B C")
    assert problems[0].startswith("unclosed tags x1")
    assert M.serialize(root).split("<body>")[1] == "<p>A <i>B C</i><br/></p></body></html>"


def test_bilingual():
    root = parse(b'<html><body><p id="k" class="c">one <a href="x" class="l">two</a></p><ul><li>three</li></ul></body></html>')
    segs = M.extract_segments(root)
    above = M.parents(root)
    for s in segs:
        source = s.text
        M.apply_translation(s, source.upper().replace("X1", "x1"))
        M.add_original(above, s, source)
    M.unwrap_runs(root)
    out = M.serialize(root)
    assert '<p class="c" style="opacity:0.7">one <span class="l">two</span></p><p id="k" class="c">ONE <a href="x" class="l">TWO</a></p>' in out
    assert '<li><div style="opacity:0.7">three</div>THREE</li>' in out


def test_repair_keeps_text():
    data = b'<html><body><span><p>a</p></span>loose <b>x</b><img src="i"/></body></html>'
    root = parse(data)
    fixes = M.repair_document(root, "2.0")
    assert fixes == ["<span> holding blocks -> <div>", "img alt added", "inline content in <body> wrapped in <div>"]
    text = lambda n: n.text + "".join(text(c) for c in n.children)
    assert text(root) == text(parse(data))
    assert M.repair_document(root, "2.0") == []
    assert M.repair_document(parse(b"<html><body>loose</body></html>"), "3.0") == []
    assert M.repair_document(parse(b"<html><body> </body></html>"), "2.0") == ["empty <body> given a <div>"]


def test_parse_details():
    assert M.numeric_entities("&nbsp;&amp;&zzz;") == "&#160;&amp;&zzz;"
    assert M.parse_document(b"<html><body><p>a</body></html>")[1] is True
    assert M.parse_document(b"<html><body><p>\xe9</p></body></html>")[1] is False
    root = parse(b'<html lang="en"><body/></html>')
    M.set_language(root, "es")
    assert 'lang="es"' in M.serialize(root) and 'xml:lang="es"' in M.serialize(root)


def package(opf, extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", f'<container xmlns="{epub.CONTAINER}"><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr("c.opf", opf)
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


OPF = f'<package xmlns="{epub.OPF}" version="2.0" unique-identifier="u"><metadata xmlns:dc="{epub.DC}"><dc:title> T </dc:title><dc:identifier id="u">old</dc:identifier><dc:language>en</dc:language><dc:language>fr</dc:language><meta name="calibre:series" content=" S "/></metadata><manifest><item id="b" href="b%20b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="zz"/></spine></package>'


def test_package(spark):
    data = package(OPF, {"a.xhtml": "x", "b b.xhtml": "y", "t.ncx": "<ncx/>"})
    files = spark.createDataFrame([("d/x.epub", bytearray(data)), ("d/y.epub", bytearray(b"no zip"))], "path string, content binary")
    books = epub.packages(files)
    rows = {r["path"]: r for r in books.collect()}
    assert rows["d/y.epub"]["error"] == "not a zip file"
    r = rows["d/x.epub"]
    assert (r["title"], r["author"], r["lang"], r["series"], r["ncx_path"], list(r["spine"])) == ("T", "", "en", "S", "t.ncx", ["a"])
    assert [x["item_path"] for x in epub.content_documents(books).orderBy("doc_no").collect()] == ["a.xhtml", "b b.xhtml"]
    got = epub.document_bytes(files.filter("path = 'd/x.epub'"), epub.content_documents(books)).collect()
    assert {x["item_path"]: bytes(x["data"]) for x in got} == {"a.xhtml": b"x", "b b.xhtml": b"y"}
    good = files.filter("path = 'd/x.epub'")
    # made by hand: mimetype is compressed nowhere, but documents are no XML and a listed member is there
    assert {r["problem"] for r in epub.package_problems(good, good).collect()} == {"a.xhtml is not well-formed", "b b.xhtml is not well-formed"}
    worse = spark.createDataFrame([("d/x.epub", bytearray(package(OPF, {"a.xhtml": "<p><img/></p>", "t.ncx": "<ncx/>"})))], "path string, content binary")
    assert {r["problem"] for r in epub.package_problems(worse, good).collect()} == {"missing from output: b b.xhtml", "manifest item missing: b b.xhtml", "a.xhtml: <img> count changed 0 -> 1"}


def test_rewritten_packages(spark):
    ncx = f'<ncx xmlns="{epub.NCX}"><docTitle><text>T</text></docTitle><navMap><navPoint id="1"><navLabel><text>One</text></navLabel></navPoint></navMap></ncx>'
    files = spark.createDataFrame([("x.epub", bytearray(package(OPF, {"a.xhtml": "<p>x</p>", "b b.xhtml": "<p>y</p>", "t.ncx": ncx, "i.png": "img"})))], "path string, content binary")
    docs = spark.createDataFrame([("x.epub", "a.xhtml", "<p>equis</p>")], "path string, item_path string, html string")
    meta = spark.createDataFrame([("x.epub", "es", "new", "Título", {"One": "Uno"})], "path string, lang string, uid string, title string, labels map<string,string>")
    made = epub.rewritten_packages(files, docs, meta)
    r = epub.packages(made).first()
    assert (r["lang"], r["identifier"], r["title"]) == ("es", "new", "Título")
    z = zipfile.ZipFile(io.BytesIO(bytes(made.first()["content"])))
    assert z.read("a.xhtml") == b"<p>equis</p>" and z.read("b b.xhtml") == b"<p>y</p>" and b">Uno<" in z.read("t.ncx") and z.read("i.png") == b"img"
    assert epub.package_problems(made, files).count() == 0


def test_protected_package():
    with pytest.raises(epub.PackageError):
        epub.read_package(package(OPF, {"META-INF/encryption.xml": "<EncryptedData/>"}))


def test_rewrite():
    new = epub.rewritten_opf(OPF.encode(), "es", "new", "Título", contributor="c").decode()
    assert "<dc:language>es</dc:language>" in new and "fr" not in new and ">new<" in new and "Título" in new and 'role="trl"' in new
    out = epub.write_package(package(OPF, {"a.xhtml": "x"}), {"a.xhtml": b"z"})
    z = zipfile.ZipFile(io.BytesIO(out))
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("a.xhtml") == b"z"
    ncx = f'<ncx xmlns="{epub.NCX}"><head><meta name="dtb:uid" content="o"/></head><docTitle><text>T</text></docTitle><navMap><navPoint id="1"><navLabel><text> One </text></navLabel></navPoint></navMap></ncx>'
    got = epub.rewritten_ncx(ncx.encode(), "es", {"One": "Uno"}, "Titulo", "n").decode()
    assert ">Uno<" in got and ">Titulo<" in got and 'content="n"' in got
