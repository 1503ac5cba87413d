"""Near-duplicates by MinHash with tensored banding: table keys pair a left and a right collection of few hashes."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import WORD, checkpoint, keep_rows, lower_ascii, row_key, ship, small_batches

WORDS = re.compile(WORD)
#: r left and r right collections of K hashes each make r * r tables of 2 K hashes from 2 r K hash functions.
#: Two documents meet if some left and some right collection agree: at similarity 0.75 that misses
#: 2 * (1 - 0.75 ** 3) ** 16 or 3 pairs in 10,000, at 0.85 fewer than one in 10 million.
R, K = 16, 3
#: Bits of a set's parity bitmap.
BITS = 1024
SIGNATURE = "doc_id long, row_a long, row_b long, row_chars int, n_shingles long, set_a long, set_b long, left array<long>, right array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = 5, memo: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; of all words if there are fewer; none without words."""
    import xxhash

    words = WORDS.findall(lower_ascii(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    memo = {} if memo is None else memo
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    one = np.array([memo[w] for w in words], np.uint64)
    n = max(1, len(one) - width + 1)
    h = np.full(n, min(len(one), width), np.uint64)
    for k in range(min(width, len(one))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n])
    return np.unique(h)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(s):
        return 0, 0
    return int(np.bitwise_xor.reduce(_mix(s)).astype(np.int64)), int(_mix(s + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64))


def _signatures(docs: DataFrame) -> DataFrame:
    """Set size, a 128-bit hash of the whole set, and the collections' keys of each document."""

    def run(batches):
        rng = np.random.default_rng(20)
        seeds = rng.integers(1, 2**63, 2 * R * K, dtype=np.uint64) | np.uint64(1)
        memo: dict = {}
        for pdf in batches:
            out = {k: [] for k in ("n_shingles", "set_a", "set_b", "left", "right")}
            for text in pdf["text"]:
                if len(memo) > 60_000:
                    memo.clear()
                s = shingles(text, memo=memo)
                keys = [[], []]
                if len(s):
                    least = np.full(len(seeds), np.uint64(2**64 - 1))
                    for at in range(0, len(s), 4096):
                        part = s[at : at + 4096, None] * seeds
                        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(0))
                    v = least.reshape(2, R, K)
                    h = np.zeros((2, R), np.uint64)
                    for k in range(K):
                        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, k])
                    keys = [_mix(x + np.arange(R, dtype=np.uint64)).astype(np.int64).tolist() for x in h]
                for name, x in zip(out, (len(s), *_set_hash(s), *keys)):
                    out[name].append(x)
            yield pd.DataFrame({**{c: pdf[c] for c in pdf.columns if c != "text"}, **out})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in row_key().items()], "text")
    return rows.mapInPandas(run, SIGNATURE)


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of a set, as longs: each bit is the parity of the hashes that fall on it.

    Where two bitmaps differ, the sets differ in a hash at least; so they differ in at least as many hashes as bits.
    """
    odd = (np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    """doc (a class), its set of shingles and the set's bitmap. texts: doc, set_a, set_b, text; a text of another set (of a
    row that repeats an id) is left out."""

    def run(batches):
        memo: dict = {}
        for pdf in batches:
            out = {"doc": [], "s": [], "bits": []}
            for doc, a, b, text in zip(pdf["doc"], pdf["set_a"], pdf["set_b"], pdf["text"]):
                if len(memo) > 60_000:
                    memo.clear()
                s = shingles(text, memo=memo)
                if _set_hash(s) == (a, b):
                    for name, x in zip(out, (doc, s.astype(np.int64), parity(s))):
                        out[name].append(x)
            yield pd.DataFrame(out)

    return texts.mapInPandas(run, "doc long, s array<long>, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    left, right = sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc").alias("b"), F.col("s").alias("sb"))

    def run(batches):
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for every node of the links (a, b).

    Least labels pass along links and labels of labels are followed each round, so rounds grow with the logarithm of a
    component's width. Links of a hub are added up in each task first.
    """
    links = checkpoint(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpoint(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        # one union and one aggregate: Spark would pile up constraints on nested expressions from round to round
        near = links.join(labels, links["b"] == labels["node"]).select(F.col("a").alias("node"), "comp", F.lit(False).alias("own"))
        jump = labels.join(labels.select(F.col("node").alias("via"), F.col("comp").alias("far")), F.col("comp") == F.col("via")).select("node", F.col("far").alias("comp"), F.lit(False).alias("own"))
        every = labels.withColumn("own", F.lit(True)).union(near).union(jump)
        new = checkpoint(every.groupBy("node").agg(F.min("comp").alias("comp"), F.min(F.when(F.col("own"), F.col("comp"))).alias("old")))
        changed = not new.filter("comp <> old").isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def near_groups(docs: DataFrame, crowd: int = 32) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is its own).

    1. Equal shingle sets (128-bit hash of the set and its size) are one class, with a number of its own.
    2. Tensored banding: classes with no left key in common with another drop out; the rest take all pairs of a shared
       left key and a right key as table keys.
    3. In tables' groups of more than `crowd` classes, a class of whose shingles fewer than 75 % occur in any other class
       of such groups cannot have a link there and leaves them.
    4. In every table the class of the smallest number is tried with all others by their full sets, and the components of
       the links are found.
    5. Where a table still has several components, every pair of classes in different ones is tried, the largest
       component's members only against the others; so no pair that meets in a table is left out, and no group of
       copies is expanded into all its pairs. Linked sets differ in a seventh of their summed sizes at most; pairs whose
       bitmaps show more than that are left out by the join itself. The components of all links are the result.

    Null text or text without words has an empty set and is linked with nothing. Rows that repeat an id are judged each by
    its own text; rows with a null id are their own. Other columns are ignored; an empty table gives no rows.
    """
    out = _grouped(docs, crowd)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, crowd: int) -> DataFrame:
    """Every row's row_key(), doc_id, n_shingles, comp (a number of its component, null if it is linked with nothing) and component_id."""
    sig = checkpoint(_signatures(docs))
    key = ["n_shingles", "set_a", "set_b"]
    real = sig.filter("n_shingles > 0 and doc_id is not null")
    firsts = real.groupBy(*key).agg(F.min("doc_id").alias("first"))
    shown = real.join(firsts, key).filter("doc_id = first").select(*key, "first", F.col("n_shingles").alias("n"), "left", "right")
    # numbers rise with the first doc_id: of near copies the first is most often the one that the others were made from
    shown = shown.repartitionByRange("first").dropDuplicates(["first", *key]).sortWithinPartitions("first")
    shown = checkpoint(shown.withColumn("rep", F.monotonically_increasing_id()))
    lefts = shown.select("rep", F.explode("left").alias("lk"))
    twice = lefts.groupBy("lk").agg(F.count("*").alias("c")).filter("c > 1").select("lk")
    met = lefts.join(twice, "lk").join(shown.select("rep", "n", "right"), "rep")
    keyed = met.select("rep", "n", "lk", F.explode("right").alias("rk")).select("rep", "n", F.xxhash64("lk", "rk").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    rows = checkpoint(keyed.join(buckets, "key"))
    wanted = shown.join(rows.select("rep").distinct(), "rep", "left_semi").select("first", F.col("rep").alias("doc"), "set_a", "set_b")
    texts = docs.select(F.col("doc_id").cast("long").alias("first"), "text").join(wanted, "first")
    sets = checkpoint(_sets(texts.select("doc", "set_a", "set_b", "text")).dropDuplicates(["doc"]))
    large = rows.filter(F.col("c") > crowd)
    if not large.isEmpty():
        inside = large.select(F.col("rep").alias("doc"), "n").distinct()
        each = sets.join(inside, "doc", "left_semi").select("doc", F.explode("s").alias("x"))
        shared = each.join(each.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1").select("x"), "x").groupBy("doc").agg(F.count("*").alias("c"))
        able = shared.join(inside, "doc").filter("100 * c >= 75 * n").select(F.col("doc").alias("rep"))
        rows = checkpoint(rows.filter(F.col("c") <= crowd).unionByName(large.join(able, "rep", "left_semi").select(*rows.columns)).select("key", "rep", "n"))
    # tables' groups with the same members are kept once
    groups = rows.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).filter("c > 1")
    rows = checkpoint(rows.join(groups.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))
    fits = lambda x, y: (100 * F.least(x, y) >= 75 * F.greatest(x, y))
    hubs = rows.groupBy("key").agg(F.min_by(F.struct("rep", "n"), "rep").alias("hub"))
    star = rows.join(hubs, "key").filter((F.col("rep") != F.col("hub.rep")) & fits(F.col("n"), F.col("hub.n"))).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    first = components(checkpoint(_verified(star, sets)))
    placed = checkpoint(rows.join(first, rows["rep"] == first["node"], "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    placed = placed.join(mixed.select("key", "main"), "key")
    placed = checkpoint(placed.join(sets.select(F.col("doc").alias("rep"), "bits"), "rep"))
    minor = placed.filter("comp <> main").select("key", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("bits").alias("ax"))
    other = placed.select("key", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("bits").alias("bx"), "main")
    once = (F.col("bc") == F.col("main")) | (F.col("a") < F.col("b"))
    apart = reduce(add, (F.bit_count(F.col("ax")[k].bitwiseXOR(F.col("bx")[k])) for k in range(BITS // 64)))
    close = 7 * apart <= F.col("an") + F.col("bn")
    left = minor.join(other, "key").filter((F.col("ac") != F.col("bc")) & once & fits(F.col("an"), F.col("bn")) & close).select("a", "b").distinct()
    more = checkpoint(_verified(left, sets))
    comps = first
    if not more.isEmpty():
        names = first.select(F.col("node").alias("x"), F.col("comp").alias("cx"))
        high = more.join(names, more["a"] == names["x"], "left").select(F.coalesce("cx", "a").alias("a"), "b")
        high = high.join(names, high["b"] == names["x"], "left").select("a", F.coalesce("cx", "b").alias("b"))
        joined = components(high).select(F.col("node").alias("old"), F.col("comp").alias("new"))
        alone = joined.join(first, joined["old"] == first["node"], "left_anti").select(F.col("old").alias("node"), F.col("old").alias("comp"))
        comps = first.union(alone).join(joined, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    classes = shown.select("rep", "first", *key).join(comps, shown["rep"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = classes.groupBy("comp").agg(F.min("first").alias("component_id"))
    found = sig.select("doc_id", *row_key(), *key).join(classes.join(least, "comp").select(*key, "comp", "component_id"), key, "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    own = {"comp": F.when(~alone, F.col("comp")), "component_id": F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))}
    return found.withColumns(own)


def keep_near(docs: DataFrame, crowd: int = 32) -> DataFrame:
    """One row of each component with all its columns: a row of the smallest doc_id (of several, one of them), whatever ids
    rows repeat. Rows without words or id are linked with nothing and stay, but for repeats in id and text."""
    found = _grouped(docs, crowd)
    first = found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", *row_key())).alias("w")).select(*[F.col(f"w.{k}").alias(k) for k in row_key()])
    return keep_rows(docs, first.union(found.filter("comp is null").select(*row_key())))


ship(__name__)
