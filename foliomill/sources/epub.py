"""EPUB packages: read as tables, written from tables."""

from __future__ import annotations

import hashlib
import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.operators.markup import parse_document

# Namespaces and media types of the package format.
OPF, DC, CONTAINER, NCX = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "urn:oasis:names:tc:opendocument:xmlns:container", "http://www.daisy.org/z3986/2005/ncx/"
XHTML_TYPES = ("application/xhtml+xml", "text/html")
NCX_TYPE = "application/x-dtbncx+xml"


class PackageError(ValueError):
    """Not a readable package: no zip, no package document, or protected."""


def read_package(data: bytes, stem: str = "") -> dict:
    """Metadata, manifest and spine of a package."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise PackageError("not a zip file") from e
    names = set(z.namelist())
    if "META-INF/encryption.xml" in names:
        raw = z.read("META-INF/encryption.xml")
        if b"EncryptedData" in raw and b"obfuscation" not in raw.lower():
            raise PackageError("protected package")
    at = None
    if "META-INF/container.xml" in names:
        root = ET.fromstring(z.read("META-INF/container.xml")).find(f".//{{{CONTAINER}}}rootfile")
        at = root.get("full-path") if root is not None and root.get("full-path") in names else None
    at = at or next((n for n in z.namelist() if n.lower().endswith(".opf")), None)
    if at is None:
        raise PackageError("no package document")
    opf = ET.fromstring(z.read(at))
    base = posixpath.dirname(at)
    manifest = {
        i.get("id"): {"id": i.get("id"), "path": posixpath.normpath(posixpath.join(base, unquote(i.get("href")))), "media_type": i.get("media-type", ""), "properties": i.get("properties", "")}
        for i in opf.iterfind(f"{{{OPF}}}manifest/{{{OPF}}}item") if i.get("href")
    }
    spine = opf.find(f"{{{OPF}}}spine")
    refs = [r.get("idref") for r in opf.iterfind(f"{{{OPF}}}spine/{{{OPF}}}itemref") if r.get("idref") in manifest]
    toc = manifest.get(spine.get("toc")) if spine is not None and spine.get("toc") else None
    toc = toc or next((m for m in manifest.values() if m["media_type"] == NCX_TYPE), None)
    first = lambda tag, default="": ((e.text or "").strip() if (e := opf.find(f".//{{{DC}}}{tag}")) is not None else default)
    key = opf.get("unique-identifier")
    ident = next(((e.text or "").strip() for e in opf.iter(f"{{{DC}}}identifier") if e.get("id") == key), "")
    series = ""
    for meta in opf.iter(f"{{{OPF}}}meta"):
        if meta.get("name") == "calibre:series" and (meta.get("content") or "").strip():
            series = meta.get("content", "").strip()
        elif meta.get("property") == "belongs-to-collection" and (meta.text or "").strip():
            series = (meta.text or "").strip()
        if series:
            break
    return {
        "version": opf.get("version", "2.0"), "title": first("title", stem), "author": first("creator"), "lang": first("language"), "description": first("description"), "series": series, "identifier": ident,
        "opf_path": at, "ncx_path": toc["path"] if toc and toc["path"] in names else None, "manifest": list(manifest.values()), "spine": refs, "names": sorted(names),
    }


_ITEM = "struct<id:string,path:string,media_type:string,properties:string>"
PACKAGE = f"path string, error string, version string, title string, author string, lang string, description string, series string, identifier string, opf_path string, ncx_path string, manifest array<{_ITEM}>, spine array<string>, names array<string>"


def packages(files: DataFrame) -> DataFrame:
    """(path, error, metadata, manifest, spine, names) of (path, content) rows, as a binaryFile scan gives them."""
    item = pa.struct([(c, pa.string()) for c in ("id", "path", "media_type", "properties")])
    text = ("version", "title", "author", "lang", "description", "series", "identifier", "opf_path", "ncx_path")
    schema = pa.schema([("path", pa.string()), ("error", pa.string()), *((c, pa.string()) for c in text), ("manifest", pa.list_(item)), ("spine", pa.list_(pa.string())), ("names", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append({"path": path, "error": None, **read_package(content, posixpath.splitext(posixpath.basename(path))[0])})
                except (PackageError, ET.ParseError) as e:
                    rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, PACKAGE)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the packages below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(path).select("path", "content")


def content_documents(books: DataFrame) -> DataFrame:
    """(path, doc_no, item_path): reading order, then the other XHTML items, each path once."""
    ok = books.filter("error is null")
    items = ok.select("path", "names", F.posexplode("manifest").alias("pos", "m")).filter(F.col("m.media_type").isin(*XHTML_TYPES) & F.array_contains("names", F.col("m.path"))).select("path", "pos", F.col("m.id").alias("id"), F.col("m.path").alias("item_path"))
    spine = ok.select("path", F.posexplode("spine").alias("at", "id"))
    both = items.join(spine, ["path", "id"]).select("path", "item_path", F.lit(0).alias("phase"), F.col("at").alias("pos")).unionByName(items.select("path", "item_path", F.lit(1).alias("phase"), "pos"))
    first = both.groupBy("path", "item_path").agg(F.min(F.struct("phase", "pos")).alias("o"))
    return first.select("path", F.row_number().over(Window.partitionBy("path").orderBy("o")).alias("doc_no"), "item_path")


def document_bytes(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, item_path, data) of wanted members."""
    schema = pa.schema([("path", pa.string()), ("item_path", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, members in zip(*(c.to_pylist() for c in batch.columns)):
                z = zipfile.ZipFile(io.BytesIO(content))
                yield pa.RecordBatch.from_pylist([{"path": path, "item_path": m, "data": z.read(m)} for m in members], schema=schema)

    lists = wanted.groupBy("path").agg(F.collect_list("item_path").alias("members"))
    return files.join(lists, "path").select("path", "content", "members").mapInArrow(run, "path string, item_path string, data binary")


def write_package(source: bytes | None, replaced: dict[str, bytes]) -> bytes:
    """A package with members replaced; ``mimetype`` comes first and is not compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), b"application/epub+zip", compress_type=zipfile.ZIP_STORED)
        done = {"mimetype"}
        if source is not None:
            old = zipfile.ZipFile(io.BytesIO(source))
            for info in old.infolist():
                if info.filename not in done:
                    new = zipfile.ZipInfo(info.filename, date_time=info.date_time)
                    new.external_attr = info.external_attr
                    z.writestr(new, replaced.get(info.filename, old.read(info.filename)), compress_type=zipfile.ZIP_STORED if info.is_dir() else zipfile.ZIP_DEFLATED)
                    done.add(info.filename)
        for name in replaced:
            if name not in done:
                z.writestr(zipfile.ZipInfo(name), replaced[name], compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rewritten_opf(data: bytes, lang: str, uid: str | None = None, title: str | None = None, description: str | None = None, contributor: str | None = None) -> bytes:
    """The package document with language, identifier, title, description and contributor of a translation."""
    ET.register_namespace("", OPF)
    ET.register_namespace("dc", DC)
    opf = ET.fromstring(data)
    meta = opf.find(f"{{{OPF}}}metadata")
    if meta is None:
        return ET.tostring(opf, encoding="utf-8", xml_declaration=True)
    for tag, value in (("title", title), ("description", description)):
        e = meta.find(f"{{{DC}}}{tag}")
        if value and e is not None:
            e.text = value
    langs = meta.findall(f"{{{DC}}}language") or [ET.SubElement(meta, f"{{{DC}}}language")]
    langs[0].text = lang
    for extra in langs[1:]:
        meta.remove(extra)
    key = opf.get("unique-identifier")
    ident = next((e for e in meta.iter(f"{{{DC}}}identifier") if key and e.get("id") == key), None)
    if uid and ident is not None and (ident.text or "").strip():
        ident.text = uid
    if contributor:
        e = ET.SubElement(meta, f"{{{DC}}}contributor")
        e.text = contributor
        if opf.get("version", "2.0").startswith("2"):
            e.set(f"{{{OPF}}}role", "trl")
    return ET.tostring(opf, encoding="utf-8", xml_declaration=True)


def rewritten_ncx(data: bytes, lang: str, labels: dict[str, str], title: str | None = None, uid: str | None = None) -> bytes:
    """The navigation document with language, title, identifier and translated labels."""
    ET.register_namespace("", NCX)
    ncx = ET.fromstring(data)
    ncx.set("{http://www.w3.org/XML/1998/namespace}lang", lang)
    head = ncx.find(f"{{{NCX}}}docTitle/{{{NCX}}}text")
    if title and head is not None:
        head.text = title
    for meta in ncx.iter(f"{{{NCX}}}meta"):
        if uid and meta.get("name") == "dtb:uid":
            meta.set("content", uid)
    for e in ncx.iterfind(f".//{{{NCX}}}navMap//{{{NCX}}}text"):
        e.text = labels.get(" ".join((e.text or "").split()), e.text)
    return ET.tostring(ncx, encoding="utf-8", xml_declaration=True)


def built_packages(documents: DataFrame, books: DataFrame) -> DataFrame:
    """(path, content): a package per book from (book_id, doc_no, html) documents.

    A file is written by one task, so a book's documents meet in one group; the
    group is one book, whatever the corpus' size.
    """
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("doc_no").to_pylist()
        b = rows[0]
        esc = lambda s: (s or "").replace("&", "&amp;").replace("<", "&lt;")
        names = [f"OEBPS/ch{r['doc_no']:05d}.xhtml" for r in rows]
        items = "".join(f'<item id="c{r["doc_no"]}" href="ch{r["doc_no"]:05d}.xhtml" media-type="application/xhtml+xml"/>' for r in rows)
        refs = "".join(f'<itemref idref="c{r["doc_no"]}"/>' for r in rows)
        series = f'<meta name="calibre:series" content="{esc(b["series"])}"/>' if b["series"] else ""
        opf = (
            f'<?xml version="1.0" encoding="utf-8"?><package xmlns="{OPF}" version="{b["version"]}" unique-identifier="uid"><metadata xmlns:dc="{DC}"><dc:title>{esc(b["title"])}</dc:title>'
            f'<dc:creator>{esc(b["author"])}</dc:creator><dc:language>{esc(b["lang"])}</dc:language><dc:identifier id="uid">book-{b["book_id"]}</dc:identifier>{series}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>'
        )
        box = f'<?xml version="1.0"?><container version="1.0" xmlns="{CONTAINER}"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
        parts = {"META-INF/container.xml": box.encode(), "OEBPS/content.opf": opf.encode()} | {n: r["html"].encode() for n, r in zip(names, rows)}
        return pa.Table.from_pylist([{"path": b["path"], "content": write_package(None, parts)}], schema=schema)

    rows = documents.join(books.select("book_id", "path", "version", "title", "author", "lang", "series"), "book_id")
    return rows.groupBy("book_id").applyInArrow(run, "path string, content binary")


def rewritten_packages(files: DataFrame, documents: DataFrame, meta: DataFrame) -> DataFrame:
    """(path, content): packages with documents replaced and the package document rewritten.

    documents (path, item_path, html); meta (path, lang, uid, title, labels
    map<string,string>): a null uid or title stays as it is, labels are those
    of the navigation document.  A package is one file, so its documents meet
    in one task; packages without any replaced document are written too.
    """
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, replaced, lang, uid, title, labels in zip(*(c.to_pylist() for c in batch.columns)):
                parts = {x["item_path"]: x["html"].encode() for x in replaced or ()}
                z = zipfile.ZipFile(io.BytesIO(content))
                package = read_package(content)
                parts[package["opf_path"]] = rewritten_opf(z.read(package["opf_path"]), lang, uid, title)
                if package["ncx_path"]:
                    parts[package["ncx_path"]] = rewritten_ncx(z.read(package["ncx_path"]), lang, dict(labels or ()), title, uid)
                yield pa.RecordBatch.from_pylist([{"path": path, "content": write_package(content, parts)}], schema=schema)

    grouped = documents.groupBy("path").agg(F.collect_list(F.struct("item_path", "html")).alias("replaced"))
    rows = files.join(grouped, "path", "left").join(meta, "path").select("path", "content", "replaced", "lang", "uid", "title", "labels")
    return rows.mapInArrow(run, "path string, content binary")


# Elements whose number must stay, and suffixes of members that are text.
COUNTED = ("img", "image", "a", "table", "svg")
TEXT_SUFFIXES = (".html", ".xhtml", ".htm", ".opf", ".ncx")
_MEMBER = "path string, nth int, name string, stored boolean, whole boolean, digest string, is_text boolean, xml_error boolean, tags map<string,int>"


def members(files: DataFrame) -> DataFrame:
    """A row per member of each package: its place, digest, whether it is well-formed, how often each counted element stands in it."""
    schema = pa.schema([("path", pa.string()), ("nth", pa.int32()), ("name", pa.string()), ("stored", pa.bool_()), ("whole", pa.bool_()), ("digest", pa.string()), ("is_text", pa.bool_()), ("xml_error", pa.bool_()), ("tags", pa.map_(pa.string(), pa.int32()))])

    def row(z: zipfile.ZipFile, path: str, nth: int, info: zipfile.ZipInfo) -> dict:
        try:
            data, whole = z.read(info), True
        except zipfile.BadZipFile:
            data, whole = b"", False
        is_text = info.filename.lower().endswith(TEXT_SUFFIXES)
        error, tags = False, None
        if info.filename.lower().endswith(TEXT_SUFFIXES[:3]):
            try:
                ET.fromstring(data)
            except ET.ParseError:
                error = True
            names = Counter(n.tag for n in parse_document(data)[0].walk() if n.is_element)
            tags = [(t, names[t]) for t in COUNTED]
        return {"path": path, "nth": nth, "name": info.filename, "stored": info.compress_type == zipfile.ZIP_STORED, "whole": whole, "digest": hashlib.sha256(data).hexdigest(), "is_text": is_text, "xml_error": error, "tags": tags}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                z = zipfile.ZipFile(io.BytesIO(content))
                yield pa.RecordBatch.from_pylist([row(z, path, i, info) for i, info in enumerate(z.infolist())], schema=schema)

    return files.select("path", "content").mapInArrow(run, _MEMBER)


def package_problems(after: DataFrame, before: DataFrame) -> DataFrame:
    """(path, problem): what is wrong with packages made from others; both sides are (path, content) of the same paths."""
    new, old = members(after), members(before)
    said = lambda rows, *parts: rows.select("path", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("problem"))
    first = new.filter("nth = 0 and (name <> 'mimetype' or not stored)")
    gone = old.select("path", "name").join(new.select("path", "name"), ["path", "name"], "left_anti")
    listed = packages(after).filter("error is null").select("path", F.explode("manifest.path").alias("name"))
    lost = listed.join(new.select("path", "name"), ["path", "name"], "left_anti")
    both = new.join(old.select("path", "name", F.col("digest").alias("old_digest"), F.col("tags").alias("old_tags")), ["path", "name"])
    counts = both.filter("tags is not null and old_tags is not null").select("path", "name", F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col("old_tags")[t].alias("a"), F.col("tags")[t].alias("b")) for t in COUNTED))).alias("t")).select("path", "name", "t.*").filter("a <> b")
    changed = both.filter("not is_text and name <> 'mimetype' and digest <> old_digest")
    out = said(first, "mimetype is not the first, stored member")
    for more in (
        said(new.filter("not whole"), "damaged member: ", F.col("name")), said(gone, "missing from output: ", F.col("name")), said(lost, "manifest item missing: ", F.col("name")), said(new.filter("xml_error"), F.col("name"), " is not well-formed"),
        said(counts, F.col("name"), ": <", F.col("tag"), "> count changed ", F.col("a").cast("string"), " -> ", F.col("b").cast("string")), said(changed, "resource changed: ", F.col("name")),
    ):
        out = out.unionByName(more)
    return out
