"""Problem 1: fill fixed-capacity requests with the segments of a document.

Bounded-space online packing.  A document's segments are cut into blocks of
consecutive ``seg_no``; each block keeps ``windows`` open requests, puts the
next segment into the fullest one that still has room (best fit), and sends off
the fullest when none has.  What is open at a block's end is left over; the
leftovers of many blocks are packed in the same way one level up, until one
block per document is left, where they are merged, largest first.

A block is bounded by rows, not by the values of ``seg_no``: blocks are counted
first, and one that holds more than twice ``block`` rows (null or repeated
numbers) is spread over several by the hash of ``seg_id``; a task that still
meets more rows of one block than that (one ``seg_id`` over and over) starts
another cut of it.  So no task ever holds more, and a document that holds a
third of all rows is spread over as many tasks as it has blocks.

Defined cases: a null text counts 0 characters and is placed; a segment longer
than the capacity is cut into ``ceil(n / capacity)`` parts, of which all but
the last fill a request of their own; a null or negative ``seg_no`` sorts
first; a book without settings gets ``DEFAULT_MAX_CHARS``; repeated rows are
placed one by one; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.plans.runtime import materialize, small

#: Capacity where a book has no settings.
DEFAULT_MAX_CHARS = 24_000
#: Open requests per block.
WINDOWS = 16
#: Rows of a block, and blocks that are merged into one a level up.
BLOCK, FAN = 4096, 256
#: Open requests per block, at most: they are numbered by slot.
MOST_WINDOWS = 64

_OUT = "book_id long, doc_no int, level int, block long, cut int, bin int, is_open boolean, item long, part int, size long, cap long"
_ARROW = pa.schema([("book_id", pa.int64()), ("doc_no", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), ("cut", pa.int32()), ("bin", pa.int32()), ("is_open", pa.bool_()), ("item", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("cap", pa.int64())])


def pack(sizes: list[int], cap: int, windows: int) -> tuple[list[int], set[int]]:
    """The bin of each item, and the bins still open: best fit among ``windows`` open bins."""
    room: dict[int, int] = {}
    out: list[int] = []
    made = 0
    for n in sizes:
        best, left = -1, cap + 1
        for b, r in room.items():
            if n <= r < left:
                best, left = b, r
        if best < 0:
            if len(room) >= windows:
                del room[min(room, key=lambda b: (room[b], b))]
            best, made = made, made + 1
            room[best] = cap
        room[best] -= n
        out.append(best)
        if room[best] <= 0:
            del room[best]
    return out, set(room)


def merge(fills: dict[int, int], cap: int) -> dict[int, int]:
    """Old bin -> bin it is merged into, largest first, best fit."""
    to: dict[int, int] = {}
    room: dict[int, int] = {}
    for b, n in sorted(fills.items(), key=lambda x: (-x[1], x[0])):
        fit = [(r, t) for t, r in room.items() if r >= n]
        if fit:
            t = min(fit)[1]
            room[t] -= n
        else:
            t = b
            room[b] = cap - n
        to[b] = t
    return to


def _block(rows: list[tuple[int, int]], cap: int, windows: int, top: bool) -> list[tuple[int, bool, int, int, int]]:
    """(bin, open, item, part, size) of one block's (item, size) rows.

    Requests sent off are numbered from 0 without gaps, open ones by their slot.
    """
    items: list[tuple[int, int, int]] = []
    for item, n in rows:
        part = 0
        while n > cap:
            items.append((item, part, cap))
            part, n = part + 1, n - cap
        items.append((item, part, n))
    bins, still = pack([n for _, _, n in items], cap, windows)
    if top:
        fills: dict[int, int] = {}
        for b, (_, _, n) in zip(bins, items):
            if b in still:
                fills[b] = fills.get(b, 0) + n
        to = merge(fills, cap)
        bins, still = [to.get(b, b) for b in bins], set()
    sent = {b: i for i, b in enumerate(b for b in dict.fromkeys(bins) if b not in still)}
    slot = {b: i for i, b in enumerate(b for b in dict.fromkeys(bins) if b in still)}
    return [(slot[b] if b in still else sent[b], b in still, item, part, n) for b, (item, part, n) in zip(bins, items)]


def _packer(level: int, top: bool, windows: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cut, held, out = None, 0, [], []

        def close() -> None:
            if held:
                out.extend((key[0], key[1], level, key[2], cut, *row, key[3]) for row in _block(held, key[3], windows, top))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

        for got in batches:
            for book, doc, block, cap, item, size in zip(*(c.to_pylist() for c in got.columns)):
                if key != (book, doc, block, cap):
                    close()
                    key, cut, held = (book, doc, block, cap), 0, []
                elif len(held) >= most:
                    close()
                    cut, held = cut + 1, []
                held.append((item, size))
            if len(out) > 20_000:
                yield batch()
                out.clear()
        close()
        yield batch()

    return run


def _pass(items: DataFrame, level: int, top: bool, windows: int, most: int) -> DataFrame:
    """items: book_id, doc_no, block, cap, item, size, ord."""
    rows = items.repartition("book_id", "doc_no", "block").sortWithinPartitions("book_id", "doc_no", "block", "ord", "item")
    return rows.select("book_id", "doc_no", "block", "cap", "item", "size").mapInArrow(_packer(level, top, windows, most), _OUT)


def pack_requests(segments: DataFrame, books: DataFrame, run_config: DataFrame, windows: int = WINDOWS, block: int = BLOCK) -> DataFrame:
    """(book_id, doc_no, request_no, seg_id, part_no, n_chars, max_chars): every segment in its request.

    ``request_no`` counts from 1 within a document.
    """
    if not 0 < windows <= MOST_WINDOWS:
        raise ValueError(f"windows must be 1 to {MOST_WINDOWS}")
    caps = books.select("book_id", "profile").join(run_config.select("profile", "max_chars"), "profile", "left").groupBy("book_id").agg(F.max("max_chars").alias("cap"))
    caps = small(materialize(caps, "caps"))
    items = segments.select(
        F.col("book_id").cast("long").alias("book_id"), F.col("doc_no").cast("int").alias("doc_no"), F.col("seg_id").cast("long").alias("item"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), F.coalesce(F.col("seg_no"), F.lit(-1)).cast("long").alias("ord"),
    )
    items = items.withColumn("block", F.floor(F.greatest("ord", F.lit(0)) / block))
    counts = items.groupBy("book_id", "doc_no", "block").agg(F.count("*").alias("n"))
    last, most = counts.agg(F.max("block"), F.max("n")).first()
    spread = -(-(most or 0) // block) if (most or 0) > 2 * block else 1
    if spread > 1:  # blocks with too many rows, of which there are at most rows / (2 * block)
        full = materialize(counts.filter(F.col("n") > 2 * block).select(F.col("book_id").alias("fb"), F.col("doc_no").alias("fd"), F.col("block").alias("fk"), F.ceil(F.col("n") / block).alias("subs")), "full-blocks")
        same = F.col("book_id").eqNullSafe(F.col("fb")) & F.col("doc_no").eqNullSafe(F.col("fd")) & (F.col("block") == F.col("fk"))
        sub = F.coalesce(F.pmod(F.xxhash64("item"), F.col("subs")), F.lit(0))
        items = items.join(small(full), same, "left").withColumn("block", F.col("block") * spread + sub).drop("fb", "fd", "fk", "subs")
    items = items.join(caps, "book_id", "left").withColumn("cap", F.greatest(F.coalesce(F.col("cap"), F.lit(DEFAULT_MAX_CHARS)).cast("long"), F.lit(1)))
    level, blocks, done, links = 0, ((last or 0) + 1) * spread - 1, [], []
    while True:
        top = blocks < 1
        placed = _pass(items, level, top, windows, 2 * max(block, FAN * windows))
        if top and not done:  # one block per document, never cut: its bins are the requests
            return placed.select("book_id", "doc_no", (F.col("bin") + 1).cast("long").alias("request_no"), F.col("item").alias("seg_id"), F.col("part").alias("part_no"), F.col("size").alias("n_chars"), F.col("cap").alias("max_chars"))
        placed = materialize(placed, f"packed-{level}")
        done.append(placed.filter(~F.col("is_open")))
        if top:
            break
        # an open request is one item of the next level
        links.append(placed.filter("is_open").withColumn("item_up", (F.col("block") * 65_536 + F.col("cut")) * MOST_WINDOWS + F.col("bin")))
        items = (
            links[-1].groupBy("book_id", "doc_no", "block", "item_up", "cap").agg(F.sum("size").alias("size"))
            .select("book_id", "doc_no", F.col("item_up").alias("item"), "size", F.col("block").alias("ord"), "cap", F.floor(F.col("block") / FAN).alias("block"))
        )
        level, blocks = level + 1, blocks // FAN
    final = done[-1]
    for below in range(level - 1, -1, -1):
        # items of the level above are the open requests of this one
        to = final.select(F.col("book_id").alias("k2"), F.col("doc_no").alias("d2"), F.col("item").alias("i2"), F.col("level").alias("l2"), F.col("block").alias("b2"), F.col("cut").alias("c2"), F.col("bin").alias("n2"))
        same = F.col("book_id").eqNullSafe(F.col("k2")) & F.col("doc_no").eqNullSafe(F.col("d2")) & (F.col("item_up") == F.col("i2"))
        moved = links[below].join(to, same).select("book_id", "doc_no", F.col("l2").alias("level"), F.col("b2").alias("block"), F.col("c2").alias("cut"), F.col("n2").alias("bin"), F.lit(False).alias("is_open"), "item", "part", "size", "cap")
        final = done[below].unionByName(moved)
    return _numbered(final)


def _numbered(placed: DataFrame) -> DataFrame:
    """Counts requests through a document by a running sum over its blocks, not over its rows."""
    where = ["level", "block", "cut"]
    counts = placed.groupBy("book_id", "doc_no", *where).agg((F.max("bin") + 1).cast("long").alias("bins"))
    before = Window.partitionBy("book_id", "doc_no").orderBy(*where).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("book_id").alias("k2"), F.col("doc_no").alias("d2"), *(F.col(c).alias(f"{c}_2") for c in where), F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("base"))
    same = F.col("book_id").eqNullSafe(F.col("k2")) & F.col("doc_no").eqNullSafe(F.col("d2"))
    for c in where:
        same &= F.col(c) == F.col(f"{c}_2")
    out = placed.join(offsets, same)
    return out.select("book_id", "doc_no", (F.col("base") + F.col("bin") + 1).alias("request_no"), F.col("item").alias("seg_id"), F.col("part").alias("part_no"), F.col("size").alias("n_chars"), F.col("cap").alias("max_chars"))


def request_fill(placed: DataFrame) -> DataFrame:
    """(book_id, requests, chars, room, unused_share): how full the requests of each book are."""
    requests = placed.groupBy("book_id", "doc_no", "request_no").agg(F.sum("n_chars").alias("used"), F.max("max_chars").alias("cap"))
    return requests.groupBy("book_id").agg(F.count("*").alias("requests"), F.sum("used").alias("chars"), F.sum("cap").alias("room"), F.round(1 - F.sum("used") / F.sum("cap"), 6).alias("unused_share"))


def request_checks(placed: DataFrame) -> DataFrame:
    """(book_id, segments, parts, chars, too_full, numbers_missing) per book: what must hold of any packing."""
    requests = placed.groupBy("book_id", "doc_no", "request_no").agg(F.sum("n_chars").alias("used"), F.max("max_chars").alias("cap"))
    documents = requests.groupBy("book_id", "doc_no").agg(F.count_if(F.col("used") > F.col("cap")).alias("too_full"), (F.max("request_no") - F.count("*")).alias("numbers_missing"))
    books = documents.groupBy("book_id").agg(F.sum("too_full").alias("too_full"), F.sum("numbers_missing").alias("numbers_missing"))
    parts = placed.groupBy("book_id").agg(F.count_distinct("seg_id").alias("segments"), F.count("*").alias("parts"), F.sum("n_chars").alias("chars"))
    return parts.join(books, "book_id")
