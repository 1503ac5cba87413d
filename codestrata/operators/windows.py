"""Runs of rows and delta decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Token types by index and modifiers by bit.
TOKEN_TYPES = ["namespace", "type", "class", "enum", "interface", "struct", "typeParameter", "parameter", "variable", "property", "enumMember", "event", "function", "method", "macro", "keyword", "modifier", "comment", "string", "number", "regexp", "operator", "decorator"]
MODIFIERS = ["declaration", "definition", "readonly", "static", "deprecated", "abstract", "async", "modification", "documentation", "defaultLibrary"]


def runs(rows: DataFrame, part: list[str], order: str, flag: str, least: int = 2, span: tuple[str, str] | None = None) -> DataFrame:
    """Maximal runs of rows with flag set, at least `least` long: part, first and last (of order), n; with span also from and to,
    the least of one column and the greatest of another."""
    own, flagged = Window.partitionBy(*part).orderBy(order), Window.partitionBy(*part, flag).orderBy(order)
    island = rows.withColumn("_g", F.row_number().over(own) - F.row_number().over(flagged)).filter(F.col(flag) == 1)
    more = [F.min(span[0]).alias("from"), F.max(span[1]).alias("to")] if span else []
    return island.groupBy(*part, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), *more).filter(F.col("n") >= least).drop("_g")


def delta_decode(tokens: DataFrame, part: str, order: str = "seq") -> DataFrame:
    """Absolute positions, types and modifiers from relative ones: d_line, d_col, len, type_idx, bits."""
    own = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("line", F.sum("d_line").over(own)).withColumn("_g", F.sum(F.when(F.col("d_line") != 0, 1).otherwise(0)).over(own))
    col = F.sum("d_col").over(Window.partitionBy(part, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    names, types = F.array(*map(F.lit, MODIFIERS)), F.array(*map(F.lit, TOKEN_TYPES))
    mods = F.filter(names, lambda x, i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    return rows.withColumn("col", col).select(part, order, "line", "col", (F.col("col") + F.greatest("len", F.lit(0))).alias("end_col"), F.coalesce(F.get(types, F.col("type_idx")), F.lit("unknown")).alias("type"), F.array_join(mods, ",").alias("modifiers"))
