"""Mixing sources to target weights by fixed-length blocks, multinomial draws per shard and index permutations."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import WORD, buckets_of, checkpoint, ship, small_batches

WORDS = re.compile(WORD)
#: The table of sources is broadcast up to so many rows; beyond that it is joined.
FEW_SOURCES = 100_000
RESULT = "doc_id long, size long, source_size long, target double, taken long"


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Share sum(sizes) by weight; a source's excess over `most` times its size goes to the others by weight until none is above."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        unit = total / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in full or free:
            out[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        total -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def _permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a four-round Feistel network over the next even power of two, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            z = (right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(goal: np.ndarray, shards: int, low: int, high: int, seed: int):
    """(shard, first, n) of the shards low to high - 1: each source's slots in the shard, and those in shards before it.

    The sources' slots (goal) are dealt to the shards by halving: a range of shards has a share of the slots, and its left
    half gets multinomial counts, with the range's slots as weights. What goes beyond a source's slots is drawn again from
    the others, so all shards together hold each source's slots exactly. A range's draw has a seed of its own, so every task
    finds the same counts for the shards that it needs, without those of other ranges.
    """
    total = int(goal.sum())
    upto = lambda k: k * total // shards
    stack = [(0, shards, goal, np.zeros(len(goal), np.int64))]
    while stack:
        a, b, have, first = stack.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, first, have
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left, missing = np.zeros(len(goal), np.int64), upto(mid) - upto(a)
        while missing > 0:
            room = have - left
            left = np.minimum(left + rng.multinomial(missing, room / room.sum()), have)
            missing = upto(mid) - upto(a) - int(left.sum())
        stack += [(mid, b, have - left, first + left), (a, mid, left, first)]


def _located(docs: DataFrame) -> tuple[DataFrame, list]:
    """Each row with the place of its first word in its source (start), and the sources: name, size, rows.

    Rows equal in every column are counted together first; the prefix sum is in two steps, buckets and the different rows of
    a bucket, so that no task holds a source or the copies of a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *[c.alias(k) for k, c in _row_hashes(docs).items()])
    # the only pass over the texts
    each = checkpoint(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("doc_id", "row_hash")))
    found = each.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("rows")).collect()
    # Python orders strings by code point
    sources = sorted(((r["source"], r["size"], r["rows"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    known = _known(docs.sparkSession, [(s[0] or "", s[0] is None, buckets_of(s[2])) for s in sources], "source_key string, source_null boolean, buckets int")
    each = each.withColumn("source_key", F.coalesce("source", F.lit(""))).withColumn("source_null", F.col("source").isNull())
    where = ["source_key", "source_null", "bucket"]
    each = each.join(known, where[:2]).withColumn("bucket", F.pmod("h", F.col("buckets")).cast("int"))
    before = Window.partitionBy(*where[:2]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy(*where).agg(F.sum(F.col("size") * F.col("copies")).alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    own = Window.partitionBy(*where).orderBy("h", "row_hash", "row_mark")
    words = F.col("size") * F.col("copies")
    each = each.withColumns({"rank": F.row_number().over(own), "start": F.sum(words).over(own.rowsBetween(Window.unboundedPreceding, 0)) - words})
    each = each.join(sums, where).withColumn("start", F.col("start") + F.col("base"))
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return copies.withColumn("start", F.col("start") + F.col("copy") * F.col("size")), sources


def _row_hashes(docs: DataFrame) -> dict:
    """Two 64-bit hashes of all columns."""
    return {"row_hash": F.xxhash64(*docs.columns), "row_mark": F.xxhash64(F.lit(1), *docs.columns)}


def _known(spark, table: list, schema: str) -> DataFrame:
    """The sources as a table; broadcast if there are few."""
    known = spark.createDataFrame(table, schema)
    return F.broadcast(known) if len(table) <= FEW_SOURCES else known


def mixed_blocks(docs: DataFrame, weights: list[float] | None = None, block: int = 64, shard: int = 4096, seed: int = 17, most: float = 3.0) -> tuple[DataFrame, list]:
    """Pieces of documents with the times that the mix takes their block, and the sources.

    A source's words, documents in hashed order, are packed into blocks of `block` words (the last may be shorter).
    The output has shards of `shard` block slots. Targets become whole slots of each source, and each shard's counts are
    multinomial draws that add up to those (shard_counts). A source's slots, numbered through the shards, go through a
    permutation of its block indices that changes at every pass. The driver holds a row a source.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, sources = _located(docs)
    weights = weights or [1.0 + i % 3 for i in range(len(sources))]
    goal = targets([s[1] for s in sources], weights, most)
    blocks = np.array([-(-s[1] // block) for s in sources], dtype=np.int64)
    want = np.array([g / s[1] * n if s[1] else 0.0 for g, s, n in zip(goal, sources, blocks)])
    # whole slots, rounded along the running sum so that they add up, and never more than `most` passes
    slots_of = np.minimum(np.diff(np.floor(np.cumsum(want) + 0.5), prepend=0), np.floor(blocks * most)).astype(np.int64)
    n_shards = max(1, -(-int(slots_of.sum()) // shard))
    table = [(s[0] or "", s[0] is None, i, int(s[1]), float(g), int(n)) for i, (s, g, n) in enumerate(zip(sources, goal, blocks))]
    known = _known(spark, table, "source_key string, source_null boolean, s int, source_size long, target double, blocks long")

    def draw(batches):
        for pdf in batches:
            if len(pdf):
                for _, first, n in shard_counts(slots_of, n_shards, int(pdf["id"].min()), int(pdf["id"].max()) + 1, seed):
                    s = np.flatnonzero(n)
                    yield pd.DataFrame({"s": s.astype(np.int32), "first": first[s], "n": n[s]})

    # a range of shards to each task, in order; a task expands no more than 1024 slots a row
    counts = spark.range(0, n_shards, 1, max(1, min(n_shards // 64, 4096))).mapInPandas(draw, "s int, first long, n long")
    slots = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1024).cast("int"))))
    slots = slots.select("s", (F.col("first") + F.col("part") * 1024).alias("first"), F.least(F.lit(1024), F.col("n") - F.col("part") * 1024).alias("n"))

    def place(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy()
            s = np.repeat(pdf["s"].to_numpy(), n)
            k = np.repeat(pdf["first"].to_numpy(), n) + np.concatenate([np.arange(x) for x in n] or [np.arange(0)])
            key = (np.uint64(seed) * np.uint64(1_000_003) + s.astype(np.uint64)) * np.uint64(65_537) + (k // blocks[s]).astype(np.uint64)
            yield pd.DataFrame({"s": s, "block": _permute(k % blocks[s], blocks[s], key), "pass": (k // blocks[s]).astype(np.int32)})

    taken = slots.mapInPandas(place, "s int, block long, pass int").groupBy("s", "block").agg(F.count("*").alias("times"))
    rows = rows.join(known, ["source_key", "source_null"])
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    pieces = rows.withColumn("block", F.explode_outer(span))
    pieces = pieces.withColumns({"lo": F.greatest("start", F.col("block") * block) - F.col("start"), "hi": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")})
    # Spark takes what tasks make from a range for small; it is not, so it must not be broadcast
    return pieces.join(taken.hint("merge"), ["s", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0))), sources


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted).

    Null or blank text has size 0 and is never taken; a null source is a source of its own, the last; equal rows are
    taken on their own; an empty table gives no rows. Reruns agree: order and draws come from hashes of ids and seeds.
    """
    pieces, _ = mixed_blocks(docs, **options)
    out = pieces.groupBy("s", "bucket", "rank", "copy", "doc_id", "size", "source_size", "target").agg(F.sum(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)) * F.col("times")).alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of docs: a document taken whole comes as it is, once a pass; what a last
    pass takes of it comes as one more row with those words, joined by a space."""
    columns = docs.columns
    pieces, _ = mixed_blocks(docs, **options)
    # the plan of each row, without its text; rows alike in every column are told apart by a number
    same = list(_row_hashes(docs))
    plan = pieces.filter("block is not null").groupBy("s", "bucket", "rank", "copy", *same).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("p"))
    plan = plan.withColumn("no", F.row_number().over(Window.partitionBy(*same).orderBy("copy"))).select(*[F.col(c).alias(f"_{c}") for c in (*same, "no")], F.col("p").alias("_p"))
    rows = docs.withColumns({f"_{k}": c for k, c in _row_hashes(docs).items()})
    key = [f"_{c}" for c in same]
    rows = rows.withColumn("_no", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))
    whole = rows.join(plan, [*key, "_no"])

    @F.pandas_udf("array<string>")
    def passes(text: pd.Series, lo: pd.Series, hi: pd.Series, times: pd.Series) -> pd.Series:
        # a null stands for the whole text
        out = []
        for t, a, b, n in zip(text, lo, hi, times):
            words = None if min(n) == max(n) else WORDS.findall(t)
            out.append([None if min(n) >= k else " ".join(" ".join(words[x:y]) for x, y, m in zip(a, b, n) if m >= k) for k in range(1, max(n) + 1)])
        return pd.Series(out, dtype=object)

    cut = F.explode(passes("text", F.col("_p.lo"), F.col("_p.hi"), F.col("_p.times")))
    out = whole.withColumn("_cut", cut).withColumn("text", F.coalesce("_cut", "text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*columns)


ship(__name__)
