"""Exact de-duplication by skew-safe combining: local groups, salted digest groups, then a merge of the salts' winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import BLANK, keep_rows, row_key

MAX_ID = "9223372036854775807"
STEP = "100000000000000000000"


def exact_groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once white space is deleted. The row with the most code points, then the smallest
    doc_id, stays. Every grouping has the whole normalised text in its key, so equal digests alone never merge rows:
    Spark's map-side aggregation merges within each task, the salted exchange merges a digest's rows in `salts`
    places, and the last one merges the salts' winners. Groups are formed by content only; rows then look their group's
    winner up by SHA-256, a second hash and the length, a join that carries no text and whose hot keys AQE splits.

    Null text counts as empty; empty texts form one group. A null doc_id loses every tie. Rows that repeat an id are
    separate rows of their groups, marked kept if their id is. Other columns are ignored; an empty table gives no rows.
    """
    found = _found(docs, salts)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _found(docs: DataFrame, salts: int, more: dict | None = None) -> DataFrame:
    """Every row with its group's winner. more: further columns to carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = more or {}
    rows = docs.select(*[c.alias(k) for k, c in more.items()], F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("chars"), F.translate(text, BLANK, "").alias("norm"))
    rows = rows.withColumns({"digest": F.sha2("norm", 256), "second": F.xxhash64("norm"), "size": F.length("norm")})
    # one fixed-width number orders a group's rows: more code points first, then the smaller id, a null id (0) last
    rank = F.expr(f"cast(chars * cast({STEP} as decimal(21,0)) + coalesce(cast({MAX_ID} as decimal(20,0)) - doc_id + 1, 0) as decimal(38,0))")
    key = ["digest", "second", "size", "norm"]
    salted = rows.select(*key, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), rank.alias("best")).groupBy(*key, "salt").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    groups = salted.groupBy(*key).agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    left = f"best % cast({STEP} as decimal(21,0))"
    keep = F.expr(f"case when {left} > 0 then cast(cast({MAX_ID} as decimal(20,0)) - {left} + 1 as bigint) end")
    groups = groups.select("digest", "second", "size", keep.alias("keep_id"), "group_size")
    return rows.select("doc_id", "digest", "second", "size", *more).join(groups, ["digest", "second", "size"])


def keep_exact(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row of each group of equal texts, with all its columns, whatever ids rows repeat.

    Of a group's rows that have the kept id the one with the most code points stays; of rows alike in id and text any.
    Empty and null texts are one group; an empty table gives no rows.
    """
    kept = _found(docs, salts, row_key()).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    best = kept.groupBy("digest", "second", "size").agg(F.max(F.struct("row_chars", "row_a", "row_b")).alias("w"))
    return keep_rows(docs, best.select("w.*"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
