"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction is retained."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import ship, small_batches

M = 0x9E3779B97F4A7C15
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketch(codes: np.ndarray, width: int = 12, scale: int = 8) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` code points (the whole text if shorter) below 2^64 / scale.

    Sketches of parts merge by union; |A and B| / |A| of two sketches estimates containment without bias of sizes.
    """
    if not len(codes):
        return np.zeros(0, np.uint64)
    width = min(width, len(codes))
    power, done, h = codes.astype(np.uint64) * np.uint64(M) + np.uint64(1), 0, None
    size, mult = 1, M
    while size <= width:
        if width & size:
            n = len(codes) - width + 1
            part = power[done : done + n]
            h = part.copy() if h is None else h * np.uint64(mult) + part
            done += size
        power = power[:-size] * np.uint64(mult) + power[size:] if 2 * size <= width else power
        mult, size = mult * mult % 2**64, size * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h[h < np.uint64(2**64 // scale)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger; two empty sketches are alike only if equal texts made them, which they can't tell: 0."""
    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else 0.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sketches(docs: DataFrame, width: int = 12, scale: int = 8) -> DataFrame:
    """doc_id and sketch (array<long>) of every whole text; null and empty texts have an empty one."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [sketch(_codes(t or ""), width, scale).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sketch array<long>")


def merge_sketches(found: DataFrame, by: str) -> DataFrame:
    """by and the sketch of all texts of a group together: the distinct union of their sketches, combined in each task first."""
    each = found.select(by, F.explode("sketch").alias("x")).distinct()
    return found.select(by).distinct().join(each.groupBy(by).agg(F.sort_array(F.collect_list("x")).alias("sketch")), by, "left").withColumn("sketch", F.coalesce("sketch", F.array().cast("array<long>")))


def containment(part: Column, whole: Column) -> Column:
    """The share of part's sketch that whole's has: how much of one text the other contains, whatever their sizes; null for an empty part."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part))


def fingerprint_pairs(docs: DataFrame, per_range: int = 4000, most_ranges: int = 16_384, per_bucket: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The next document is the next by doc_id (nulls first, then text for equal ids; after the last comes the first).
    Rows go once to ranges of ids, of some per_range rows each or more if that makes over most_ranges of them; bounds come
    from ids with the least hashes, 64 to a range. Each range also gets a copy of the first row of the next, so that
    neighbours meet without a global order in one task. Null text is empty. Texts without a retained hash have an empty
    fingerprint, and likeness 1 to an equal text, else 0. A table of one row is its own next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # null ids come before all others
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    if not count:
        return spark.createDataFrame([], OUT)
    n = min(most_ranges, -(-count // (per_bucket or per_range)))
    share = int((1 << 30) * min(1.0, 64 * n / count))
    cuts: list[int] = []
    if n > 1:
        some = sorted(r[0] for r in rows.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)).select("doc_id").distinct().collect())
        cuts = sorted({some[k * len(some) // n] for k in range(1, n)}) if some else []
    known = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(known.value, ids.fillna(0).astype("int64"), side="left")).astype("int32"))

    # few cuts are compared in place
    pid = find("doc_id") if len(cuts) > 64 else F.coalesce(sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0)), F.lit(0))
    placed = rows.withColumn("pid", pid)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id"))
    firsts = sorted((r["pid"], r["f"]["doc_id"]) for r in placed.select("doc_id", "pid").groupBy("pid").agg(least.alias("f")).collect())
    # the first id of each range is also sent to the range before it; the first of all goes behind the last range's rows
    copies = [(i, firsts[k - 1][0], k == 0) for k, (_, i) in enumerate(firsts)]
    # broadcast: one row a range
    ahead = F.broadcast(spark.createDataFrame(copies, "first long, to int, last boolean"))
    extra = rows.join(ahead, F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("to").alias("pid"), F.lit(True).alias("copy"), "last")
    every = placed.select("doc_id", "text", "pid", F.lit(False).alias("copy"), F.lit(False).alias("last")).unionByName(extra)
    every = every.repartitionById(len(cuts) + 1, F.col("pid")).sortWithinPartitions("pid", "last", F.asc_nulls_first("doc_id"), "copy", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def text_of(s: np.ndarray) -> str:
        return base64.b64encode(s.tobytes()).decode()

    def pairs(batches):
        before = None
        for batch in batches:
            out = {f.name: [] for f in schema}
            for i, text, p, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "pid", "copy"))):
                codes = _codes(text)
                own = sketch(codes)
                if before is not None and before[0] == p and not before[4]:
                    _, id_, old, print_, _, old_text = before
                    half = len(old) // 2
                    new = np.concatenate([old[: len(old) - half], codes[:half]])
                    edited = new.tobytes().decode("utf-32-le", "surrogatepass")
                    e = sketch(new)
                    values = (id_, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), text_of(print_), text_of(e), 1.0 if edited == old_text else likeness(print_, e), 1.0 if text == old_text else likeness(print_, own))
                    for name, v in zip(out, values):
                        out[name].append(v)
                before = (p, i, codes, own, copy, text)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return every.mapInArrow(pairs, OUT)


ship(__name__)
