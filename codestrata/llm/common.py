"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of code points outside these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(name: str) -> None:
    """Let tasks get this module's functions with the job, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files, so a lost executor costs no more than its tasks.

    What was shuffled to make df goes once the files are there; else it stays until the driver happens to collect its
    garbage, and jobs of many rounds pile it up. Only a local session may come without spark.checkpoint.dir: there driver
    and executors are one process.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "codestrata-checkpoints"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        # the setting counts for DataFrames that are made under it
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hand texts to Python in batches of at most `size` bytes, unless the session has a setting of its own (the default is 64 MB)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def buckets_of(rows: int, least: int = 500) -> int:
    """Buckets for so many rows of one key: some square root of the rows to each, so neither buckets nor their number grow large."""
    return max(1, int(rows / max(least, rows**0.5)))


def row_key() -> dict[str, Column]:
    """Names a row by its doc_id and text: two 64-bit hashes of both and the text's length (null text counts as empty)."""
    text, own = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    return {"row_a": F.xxhash64(own, text), "row_b": F.xxhash64(text, F.lit(1), own), "row_chars": F.length(text)}


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose row_key() is among kept's, with all their columns; of rows alike in id and text one."""
    key = [f"_{k}" for k in row_key()]
    rows = docs.withColumns(dict(zip(key, row_key().values())))
    found = rows.join(kept.select(*[F.col(k).alias(f"_{k}") for k in row_key()]).distinct(), key, "left_semi")
    # the join has dealt and sorted the rows by these columns
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).filter("_n = 1").select(*docs.columns)


def lower_ascii(text: str) -> str:
    return text.translate(_FOLD)


_FOLD = str.maketrans(UPPER, LOWER)
ship(__name__)
