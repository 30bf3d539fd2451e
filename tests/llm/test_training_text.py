import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.llm import confusables, encoding, leakage, mixing, packing, pairs, scannoise, spans, splitting
from foliomill.llm._codes import code_points, gram_hash, prefix, sliding_min, winnow

# --- arrays


@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 20))
def test_sliding_min(values, w):
    a = np.array(values, np.uint64)
    assert sliding_min(a, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


@given(st.text("ab", min_size=1, max_size=60), st.integers(1, 6))
def test_equal_grams_have_equal_hashes(text, k):
    h = gram_hash(prefix(code_points(text)), k)
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))


def test_winnowing_keeps_one_in_each_window():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    kept = set(winnow(h, 7, np.ones(494, bool)).tolist())
    assert all(kept & set(range(i, i + 7)) for i in range(494)) and len(kept) < 250


# --- 1


@settings(max_examples=60)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 5))
def test_packing_holds_the_capacity(sizes, windows):
    bins, still = packing.pack(sizes, 30, windows)
    fill = {}
    for b, n in zip(bins, sizes):
        fill[b] = fill.get(b, 0) + n
    assert all(n <= 30 for n in fill.values()) and len(still) <= windows
    to = packing.merge({b: fill[b] for b in still}, 30)
    joint = {}
    for b, t in to.items():
        joint[t] = joint.get(t, 0) + fill[b]
    assert all(n <= 30 for n in joint.values())


def test_packing_over_blocks(spark):
    rng = random.Random(3)
    rows = [(i, 1, 1, i, "x" * rng.randint(1, 60)) for i in range(1500)]
    seg = spark.createDataFrame(rows, "seg_id long, book_id long, doc_no int, seg_no int, text string")
    books = spark.createDataFrame([(1, "p")], "book_id long, profile string")
    config = spark.createDataFrame([("p", 100)], "profile string, max_chars int")
    out = packing.pack_requests(seg, books, config, block=1, windows=3).collect()  # a block a row: all levels are used
    assert sorted(r["seg_id"] for r in out) == list(range(1500))
    fill = {}
    for r in out:
        fill[r["request_no"]] = fill.get(r["request_no"], 0) + r["n_chars"]
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(1, len(fill) + 1))
    assert len(fill) <= 1.15 * sum(len(r[4]) for r in rows) / 100


def placed_parts(spark, rows, cap, **kw):
    seg = spark.createDataFrame(rows, "seg_id long, book_id long, doc_no int, seg_no int, text string")
    books = spark.createDataFrame([(1, "p")], "book_id long, profile string")
    config = spark.createDataFrame([("p", cap)], "profile string, max_chars int")
    out = packing.pack_requests(seg, books, config, **kw).collect()
    want = sorted((r[0], p) for r in rows for p in range(max(1, -(-len(r[4] or "") // cap))))
    assert sorted((r["seg_id"], r["part_no"]) for r in out) == want  # each part once
    fill = {}
    for r in out:
        key = (r["book_id"], r["doc_no"], r["request_no"])
        fill[key] = fill.get(key, 0) + r["n_chars"]
    assert max(fill.values()) <= cap
    for doc in {k[:2] for k in fill}:
        assert sorted(k[2] for k in fill if k[:2] == doc) == list(range(1, sum(k[:2] == doc for k in fill) + 1))
    return fill


def test_packing_blocks_of_more_than_a_thousand_requests(spark):
    rows = [(i, 1, 1, i, "x" * 60) for i in range(1990)]
    assert len(placed_parts(spark, rows, 100, block=1500)) == 1990


@pytest.mark.parametrize("seed", range(3))
def test_packing_many_levels_null_and_repeated_numbers(spark, seed):
    rng = random.Random(seed)
    no = lambda i: None if i % 3 == 0 else rng.choice([7, i, i // 50, -4])
    rows = [(i, 1, rng.choice([1, 1, 1, 2, None]), no(i), "x" * rng.choice([0, 3, 40, 55, 90, 230])) for i in range(700)]
    rows += [rows[5]] * 40  # one id over and over
    placed_parts(spark, rows, 100, block=rng.choice([8, 30, 200]), windows=rng.choice([1, 5, 16]))


# --- 3


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab .,!\n-*<x1/>́"), max_size=300), st.integers(4, 60), st.integers(0, 40))
def test_pieces_cover_the_text(text, limit, overlap):
    out = splitting.pieces(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c, _ in out) == text
    assert all(c - a <= limit for a, _, c, _ in out)
    o = min(overlap, limit // 2)
    assert all(b - a == min(o, b) for a, b, _, _ in out[1:])


def bodies_of(text, limit, overlap=0):
    return [text[b:c] for _, b, c, _ in splitting.pieces(text, limit, overlap)]


def test_a_heading_never_ends_a_piece():
    para = "Alpha beta gamma delta epsilon zeta eta theta. " * 9
    text = "".join(f"# Head {i}\n\n{para}\n\n## Sub {i}\n\n{para}\n\n" for i in range(4))
    out = bodies_of(text, 600)
    assert "".join(out) == text and max(map(len, out)) <= 600
    assert not any(re.search(r"#+ \w+ \d\s*$", p) for p in out)
    assert all(p.startswith("#") for p in out)  # every section fits
    assert all(not p.rstrip().split("\n")[-1].startswith("#") for p in bodies_of(text, 120))


def test_siblings_are_merged_and_only_large_nodes_opened():
    small, large = "One two three four. ", "Word " * 60 + "end. "
    text = f"{small * 4}\n\n{small * 3}\n\n{large * 4}\n\n{small * 2}\n\n{small}"
    out = bodies_of(text, 400)
    assert out[0] == f"{small * 4}\n\n{small * 3}\n\n" and out[-1] == f"{small * 2}\n\n{small}"
    assert [p for p in out if p.startswith("Word")] == out[1:-1] and "".join(out) == text


def test_pairs_that_fit_are_never_cut():
    inner = "Alpha beta gamma delta. Epsilon zeta eta. " * 4
    text = f"<x1>{inner}</x1> <x2>{inner * 6}</x2> and <x3>short one</x3>. " * 2
    out = bodies_of(text, 260)
    assert "".join(out) == text and max(map(len, out)) <= 260
    for k in ("1", "3"):
        assert all(p.count(f"<x{k}>") == p.count(f"</x{k}>") for p in out)
    assert all(re.search(r"(\.|>|\s)\s*$", p) for p in out)


def test_lists_own_their_items():
    text = "Intro line here.\n" + "".join(f"- item {i} with some text\n  - inner {i} a\n  - inner {i} b\n" for i in range(12))
    out = bodies_of(text, 150)
    assert all(p.startswith(("- item", "Intro")) for p in out) and "".join(out) == text


def test_deep_and_long_texts_stay_linear():
    deep = "".join(f"<x{i}>a " for i in range(3000)) + "".join(f"</x{i}> " for i in reversed(range(3000)))
    assert "".join(bodies_of(deep, 200)) == deep
    long = "<x1>b</x1> word. " * 60_000
    assert "".join(bodies_of(long, 1500)) == long


def test_pieces_end_at_sentences():
    text = "One short sentence here. " * 20
    assert {kind for *_, kind in splitting.pieces(text, 120, 20)} <= {"sentence", "end"}


# --- 2


def test_edges():
    heads = ("3. A Walk Home",)
    e = lambda t, tag="p": scannoise.edges(t, tag, "The Old Bridge", "Ann Ode", heads)
    assert e("he went\n12 THE OLD BRIDGE\nhome") == ("he went\nhome", True, False)
    assert e("he went<x1/>TH€ 0LD BRIDG€ 12<x2/>home")[1:] == (True, False)
    assert e("he went A Walk Home | 14 over there")[1:] == (True, False)
    assert e("T H E   O L D   B R I D G E\nhe went")[1:] == (True, False)
    assert e("he went\n- 14 -\nhome") == ("he went\nhome", False, True)
    assert e("he went [201] home")[2] and e("he went xlvii home")[2] and e("he w¬ 14 ent")[2]
    for clean in ("cf. p. 4.", "He paid (30 £) then", "the old bridge was cold", "12", "18 Everyone sang\n19 Nobody sang", "In 1762 he left"):
        assert e(clean)[1:] == (False, False), clean
    assert e("THE OLD BRIDGE", "h1")[1:] == (False, False)


def test_breaks():
    assert scannoise.joined_breaks("a wo¬\nrd") == ("a word", True, [])
    text, sure, parts = scannoise.joined_breaks("a wo-<x1/>rd and pre- and")
    assert not sure and parts == [("wo", "rd"), ("pre", "and")]


def test_scan_noise(spark):
    good = "the narrow river under some bridge while another stranger watched the old house and the silent garden"
    texts = [good] * 30 + ["tbe narr0w river", "the nar-\nrow river", "pre- and post", "the r|ver and the hou€se", "no noise here"]
    seg = spark.createDataFrame([(i, 1, 1, i, "p", t) for i, t in enumerate(texts)], "seg_id long, book_id long, doc_no int, seg_no int, tag string, text string")
    books = spark.createDataFrame([(1, "Any Title Here", "A B")], "book_id long, title string, author string")
    log = spark.createDataFrame([(1, 1, 1, "x#1: joined broken line …'th€ riv¬' ⏎ 'er'…")], "log_id long, book_id long, doc_no int, entry string")
    got = {(r["tbl"], r["row_id"], r["kind"]) for r in scannoise.scan_noise(seg, books, log).collect()}
    assert got == {("segments", 30, "chars"), ("segments", 31, "hyphen"), ("segments", 33, "chars"), ("cleanup_log", 1, "chars"), ("cleanup_log", 1, "hyphen")}
    fixed = {r["row_id"]: r["clean"] for r in scannoise.repaired_text(seg, books, log).filter("tbl = 'segments'").collect()}
    assert fixed[30] == "the narrow river" and fixed[31] == "the narrow river"


# --- 4

WORDS = "señor mañana niño corazón jardín también después canción árbol último según ningún école forêt élève première garçon français père lumière über für schön müde größe straße".split()


@pytest.fixture(scope="module")
def repairer():
    import pyarrow as pa

    rng = random.Random(1)
    plain = [" ".join(rng.choice([*WORDS, "casa", "perro", "maison", "haus", "tree"]) for _ in range(12)) + "." for _ in range(3000)]
    russian = [" ".join(rng.choice("город река дом стена окно письмо вечер дорога мост сад ключ дверь".split()) for _ in range(10)) + "." for _ in range(1500)]
    counts = next(encoding.count_pairs(iter([pa.RecordBatch.from_arrays([pa.array(plain + russian)], names=["t"])])))
    return encoding.Repairer(encoding.PairModel(counts.column(0).to_numpy(), counts.column(1).to_numpy())), plain, russian


@pytest.mark.parametrize(("right", "used"), [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "mac_roman")])
def test_encoding_round_trip(repairer, right, used):
    r, plain, _ = repairer
    done = same = 0
    for text in plain[:60]:
        try:
            bad = text.encode(right).decode(used)
        except UnicodeError:
            continue
        if bad == text:
            continue
        done += 1
        got = r.repair(bad)
        assert len(r.candidates([text, bad])) >= 1
        same += got is not None and got[0] == text
    assert done and same >= 0.9 * done


def test_encoding_cyrillic(repairer):
    r, _, russian = repairer
    for right, used in (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("utf-8", "cp866"), ("cp1251", "cp1252")):
        assert sum((g := r.repair(t.encode(right).decode(used))) is not None and g[0] == t for t in russian[:40]) >= 36


def test_encoding_twice_and_clean(repairer):
    r, plain, russian = repairer
    twice = "el niño según".encode().decode("cp1252").encode().decode("cp1252")
    assert r.repair(twice)[0] == "el niño según"
    assert all(r.repair(t) is None for t in plain[:200] + russian[:200])
    assert r.repair("Ð, þ, ð.") is None and r.repair("ГОРОД РЕКА ДОМ") is None and r.repair("th€ tr€e") is None
    assert r.repair("a�b")[1] == "lost"


# --- 5


@pytest.mark.parametrize(
    ("prompt", "answer", "want"),
    [
        ("She went home.", None, "empty"), ("She went home.", "<x1/> [[n/a]]​", "empty"), ("She went home.", "Lo siento, no puedo traducir este fragmento.", "refusal"), ("She went home.", "I’m sorry, but I can’t translate this passage. [[n/a]]", "refusal"),
        ("“I’m sorry, I can’t,” said Numod.", "«Lo siento, no puedo», dijo Numod mientras cerraba la puerta.", None), ("The quick brown fox jumps over it.", "Translation: the quick brown fox  jumps over it.", "copy"),
        ("The quick brown fox jumps over it.", "“THE QUICK BROWNFOX JUMPS OVER IT.”", "copy"), ("Anna Doe", "Anna Doe", None),
        ("The first sentence goes here. The second one follows it. And a third one ends the text.", "La primera frase va", "truncated"), ("The first sentence goes here. The second one follows it. And a third one ends the text.", "La primera frase va aquí. La segunda la sigue. Y una tercera acaba el texto.", None),
    ],
)
def test_defects(prompt, answer, want):
    model = pairs.Languages.fit(["the quick brown fox and other animals", "la primera frase va aquí y la segunda la sigue"] * 5, ["en", "es"] * 5)
    got = pairs.judge([prompt], [answer], ["es"], model)[0]
    assert got == want


def test_hot_prompts(spark):
    entries = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(60)], "row_id int, k int")
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(6)], "k int, prompt string")
    want = sorted(map(tuple, entries.join(prompts, "k").collect()))
    for hot in (5, 20, 1000):
        assert sorted(map(tuple, pairs._joined(entries, prompts, ["k"], hot).select("k", "row_id", "prompt").collect())) == want


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert pairs.lcs(a, b) == best[-1][-1]


def test_language_accuracy():
    rng = random.Random(2)
    vocab = {"en": "the and with of under house river window garden while some".split(), "es": "el la con de bajo casa río ventana jardín mientras según".split(), "de": "der die mit von unter haus fluss fenster garten während einige".split()}
    make = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    train = [(make(lang, 10), lang) for lang in vocab for _ in range(100)]
    model = pairs.Languages.fit([t for t, _ in train], [x for _, x in train])
    held = [(make(lang, 8), lang) for lang in vocab for _ in range(100)]
    scores, _ = model.scores([t for t, _ in held])
    assert np.mean([model.names[k] == lang for k, (_, lang) in zip(scores.argmax(1), held)]) > 0.97


# --- 6


def test_skeletons():
    s = lambda t: confusables.skeletons([t])[0]
    base = s("Their narrow é hill 12")
    for same in ("Тheir nаrrow é hill 12", "Ｔｈｅｉｒ narrow é hill １２", "Their narrow é hi​ll 12", "Their narrow é hill 12"):
        assert s(same) == base
    for other in ("their narrow é hill 12", "Their narrow e hill 12", "Their narrow é hill ¹²", "Their narrow é hill l2", "Their narrow é hill 12."):
        assert s(other) != base


def test_look_alike_pairs(spark):
    texts = ["abc d", "abc d", "аbc d", "abc d", "Abc d", None, ""]
    seg = spark.createDataFrame(list(enumerate(texts)), "seg_id long, text string")
    assert sorted((r["seg_a"], r["seg_b"]) for r in confusables.look_alike_pairs(seg).collect()) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]


# --- 7


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta omega kappa sigma theta".split()) + str(rng.randint(0, 40))
    items = [[word() for _ in range(30)] for _ in range(12)]
    docs = []
    for _ in range(60):
        d = [word() for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.7:
            n, it = rng.randint(8, 20), rng.choice(items)
            a = rng.randint(0, 30 - n)
            at = rng.randint(0, len(d))
            d[at:at] = it[a : a + n]
        docs.append(d)
    docs.append([w.upper() for w in items[0]])
    want = {(i, j) for i, d in enumerate(docs) for j, it in enumerate(items) if {tuple(w.lower() for w in d[k : k + 13]) for k in range(len(d) - 12)} & {tuple(it[k : k + 13]) for k in range(18)}}
    got = leakage.leaked_runs(spark.createDataFrame([(i, ", ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(j, " ".join(it)) for j, it in enumerate(items)], "item_id long, text string"))
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and want
    assert all(docs[r["doc_id"]][r["doc_word"]].lower() == items[r["item_id"]][r["item_word"]] for r in rows)


def test_bitmap_holds_its_hashes(spark):
    h = np.random.default_rng(2).integers(-(1 << 63), 1 << 63 - 1, 5000)
    prints = spark.createDataFrame([(int(x),) for x in h], "h long")
    bitmap = leakage.hash_bitmap(prints)
    assert leakage.in_bitmap(bitmap, h).all()
    assert leakage.in_bitmap(bitmap, np.random.default_rng(3).integers(-(1 << 63), 1 << 63 - 1, 5000)).mean() < 0.06
    assert not leakage.in_bitmap(leakage.hash_bitmap(prints.limit(0)), h).any()


# --- 8


@given(st.integers(1, 300), st.integers(0, 1000))
def test_permutation(n, key):
    assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_shard_counts():
    slots = [500, 300, 7]
    shards = [mixing.shard_counts(slots, k, 100) for k in range(9)]
    own, before = [o.tolist() for o, _ in shards], [b.tolist() for _, b in shards]
    assert [sum(x) for x in zip(*own)] == slots and [sum(o) for o in own] == [100] * 8 + [7]
    assert before == [[sum(x) for x in zip([0, 0, 0], *own[:k])] for k in range(9)]
    assert len({tuple(o) for o in own}) > 4 and min(map(min, own)) >= 0


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, "one two three " * rng.randint(5, 60), "a" if i % 4 else "b") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mix_shares(df, targets, block=64).collect()}
    assert shares["none"]["used_tokens"] == 0 and abs(shares["a"]["actual_share"] - 5 / 9) < 0.01
    used = mixing.mix_documents(df, targets, block=64).collect()
    assert all(r["repeats"] <= (1 if r["source"] == "a" else 3) and r["used_tokens"] <= r["repeats"] * r["n_tokens"] for r in used)


# --- 9


@settings(max_examples=40, deadline=None)
@given(st.text("ab", min_size=1, max_size=200))
def test_suffix_array(text):
    assert spans.suffix_array(code_points(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_wavelet_rank():
    seq = np.random.default_rng(1).integers(0, 13, 300)
    index = spans.WaveletTree(seq, 13)
    for s in range(13):
        base = index.rank(np.array([s]), np.array([0]))[0]
        assert [int(index.rank(np.array([s]), np.array([i]))[0] - base) for i in range(0, 301, 17)] == [int((seq[:i] == s).sum()) for i in range(0, 301, 17)]


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_sampled_positions(n):
    codes = code_points("".join(random.Random(n).choice("abcab x") for _ in range(n)))
    index = spans.FMIndex(codes)
    want = spans.suffix_array(np.append(np.searchsorted(index.alphabet, codes) + 1, 0))
    assert (index.locate(np.arange(n + 1)) == want).all()


def test_spans_against_brute_force(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [letters(400) for _ in range(4)]
    docs = []
    for _ in range(30):
        t = letters(rng.randint(50, 600))
        if rng.random() < 0.8:
            n, s = rng.randint(250, 400), rng.choice(shared)
            a = rng.randint(0, 400 - n)
            at = rng.randint(0, len(t))
            t = t[:at] + s[a : a + n] + t[at:]
        docs.append(t)
    docs += [docs[0], docs[0], "z" * 319, "z" * 319, "y" * 700]
    grams = [{d[i : i + 320] for i in range(len(d) - 319)} for d in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if grams[i] & grams[j]}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {(r["doc_a"], r["doc_b"]) for r in spans.document_pairs(df).collect()} == want
    classes = spans.text_classes(df)
    for r in spans.class_matches(df, classes, shard_chars=2000).collect():
        a, b = docs[r["cls_a"]], docs[r["cls_b"]]
        x, y, n = r["start_a"], r["start_b"], r["length"]
        assert n >= 320 and a[x : x + n] == b[y : y + n]
        assert (x == 0 or y == 0 or a[x - 1] != b[y - 1]) and (a[x + n : x + n + 1] != b[y + n : y + n + 1] or not a[x + n : x + n + 1])
    amounts = {r["doc_id"]: r for r in spans.shared_amounts(df).collect()}
    assert amounts[len(docs) - 4]["shared_share"] == 1.0 if len(docs) - 4 in amounts else True
    assert set(amounts) == {i for p in want for i in p}
