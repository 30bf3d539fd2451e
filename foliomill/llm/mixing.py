"""Problem 8: mix sources to target weights, sizes in tokens.

Each source's documents are put in a pseudorandom order and their tokens
packed into one stream, cut into blocks of ``BLOCK`` tokens.  The mix is the
largest one the repeat caps allow: as many block slots as the scarcest source
can fill.  Slots are spread over output shards by multinomial draws of source
counts: the shards are halved again and again, and at each node of that tree
the left half draws its counts from what the node has to place, seeded by the
node.  So the counts vary from shard to shard, the totals are met exactly, and
a task finds the counts of its shards by walking down from the root: the
driver holds nothing but a row per source.  Slot j of a source is in pass ``j // blocks``
and shows block ``permutation(j % blocks)``, a pseudorandom index permutation
of its own for each source and pass; no block, and so no document, is shown
more than ``max_repeats`` times.  Slots and blocks are joined by index.

Defined cases: documents without text or tokens, or with a source that has no
target, are not used; a source without documents, or with a null or
non-positive share or cap, gets nothing and its share is divided among the
others in proportion; a last, shorter block counts what it has; an empty table
gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.plans.runtime import materialize

#: Rank file of a public byte-level tokenizer, where the session has no ``foliomill.tokenizer``.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block, block slots of an output shard, documents of a prefix-sum bucket.
BLOCK, SHARD_SLOTS, BUCKET_ROWS = 512, 4096, 20_000
SEED = 20_250


@lru_cache(4)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with text."""
    path = tokenizer or documents.sparkSession.conf.get("foliomill.tokenizer", TOKENIZER)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(n, pa.int64())], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").alias("row_text")).filter("row_text is not null and doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long")


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1: a Feistel network, walked until the value is in range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(6):
            x = (right + np.uint64((key * 31 + r * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9FB21C651E98DF25)
            left, right = right, (left ^ (x >> np.uint64(20))) & mask
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _drawn(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """``size`` slots drawn from those left of each source; a source that runs out leaves its draws to the others."""
    got = np.zeros_like(left)
    while size:
        more = np.minimum(rng.multinomial(size, left / left.sum()), left)
        got, left, size = got + more, left - more, size - int(more.sum())
    return got


def shard_counts(slots: list[int], shard: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in a shard, slots of each source in the shards before it)."""
    left = np.array(slots, np.int64)
    before = np.zeros_like(left)
    low, high = 0, -(-int(left.sum()) // shard_slots)
    while high - low > 1:
        middle = (low + high) // 2
        got = _drawn(left, (middle - low) * shard_slots, np.random.default_rng((seed, low, high)))
        if shard < middle:
            left, high = got, middle
        else:
            left, before, low = left - got, before + got, middle
    return left, before


def plan(blocks: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, int]:
    """Block slots per source: the largest mix in which no block is shown too often."""
    use = [(s, w, blocks[s] * c) for s, w, c in targets if blocks.get(s) and w and w > 0 and c and c > 0]
    whole = sum(w for _, w, _ in use)
    if not use:
        return {}
    total = min(cap * whole / w for _, w, cap in use)
    exact = {s: total * w / whole for s, w, _ in use}
    slots = {s: int(x) for s, x in exact.items()}
    caps = {s: cap for s, _, cap in use}
    for s in sorted(exact, key=lambda s: (slots[s] - exact[s], s))[: max(0, round(total) - sum(slots.values()))]:
        slots[s] = min(slots[s] + 1, caps[s])
    return slots


def _stream(tokens: DataFrame) -> DataFrame:
    """tokens with ``start``: first token of each document in its source's stream.

    Prefix sums in two steps: over the buckets of a source, of which there are few, and inside each bucket.
    """
    buckets = max(1, tokens.count() // BUCKET_ROWS)
    rows = tokens.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))


def mix_slots(tokens: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block, shard): which block stands in which output shard, a row per slot."""
    spark = tokens.sparkSession
    sizes = {r["source"]: -(-r["t"] // block) for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("t")).join(targets.select("source"), "source", "left_semi").collect() if r["source"] is not None}
    goal = [(r["source"], r["w"], r["c"]) for r in targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("c")).orderBy("source").collect()]
    slots = plan(sizes, goal)
    names = sorted(slots)
    counts, blocks = [slots[s] for s in names], [sizes[s] for s in names]
    schema = pa.schema([("source", pa.string()), ("block", pa.int64()), ("shard", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                own, before = shard_counts(counts, shard)
                for k, n in enumerate(own.tolist()):
                    j = np.arange(before[k], before[k] + n)
                    turn, index = j // blocks[k], np.empty(n, np.int64)
                    for t in np.unique(turn).tolist():
                        index[turn == t] = permuted(j[turn == t] % blocks[k], blocks[k], k * 1000 + t + SEED)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k]] * n, pa.string()), pa.array(index), pa.array(np.full(n, shard, np.int64))], schema=schema)

    return spark.range(-(-sum(counts) // SHARD_SLOTS)).mapInArrow(run, "source string, block long, shard long")


def mix_documents(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, used_tokens): chosen documents.

    ``repeats`` is how often the most shown part of the document is used,
    ``used_tokens`` what it contributes in all.
    """
    tokens = materialize(token_counts(documents, tokenizer).filter("n_tokens > 0 and source is not null"), "tokens")
    return _used(tokens, targets, block)


def _used(tokens: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    draws = mix_slots(tokens, targets, block).groupBy("source", "block").agg(F.count("*").alias("draws"))
    wanted = tokens.join(targets.select("source").distinct(), "source", "left_semi")
    last = ((F.col("start") + F.col("n_tokens") - 1) / block).cast("long")
    parts = _stream(wanted).withColumn("block", F.explode(F.sequence((F.col("start") / block).cast("long"), last)))
    size = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    used = parts.withColumn("size", size).join(draws, ["source", "block"])
    return used.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.max("draws").cast("int").alias("repeats"), F.sum(F.col("size") * F.col("draws")).alias("used_tokens"))


def mix_shares(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share, repeats): one row per target."""
    tokens = materialize(token_counts(documents, tokenizer).filter("n_tokens > 0 and source is not null"), "tokens")
    have = tokens.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    used = _used(tokens, targets, block).groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.max("repeats").alias("repeats"))
    goal = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    rows = goal.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["available_tokens", "used_tokens", "repeats"])
    whole = materialize(rows, "shares")
    total = whole.agg(F.sum("used_tokens")).first()[0] or 1
    return whole.select("source", "target_share", "max_repeats", "available_tokens", "used_tokens", F.round(F.col("used_tokens") / F.lit(total), 6).alias("actual_share"), "repeats")
