"""Filters, canonical order, limits and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("error", "warning", "information", "hint")
RANGE = ("path", "start_line", "start_col", "end_line", "end_col")
SUPPRESSED = r"#\s*(type:\s*ignore|pyright:\s*ignore)"


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    level = severity.strip().lower()
    if level not in LEVELS:
        raise ValueError(f"severity must be one of {', '.join(LEVELS)}")
    return findings.filter(F.lower(F.trim("severity")) == level)


def suppress(findings: DataFrame, codes: list[str]) -> DataFrame:
    """Drop the codes; rows without a code stay."""
    return findings.filter(~F.coalesce(F.col("code").isin(*codes), F.lit(False)))


def inline_suppress(findings: DataFrame, lines: DataFrame, pattern: str = SUPPRESSED) -> DataFrame:
    """Drop findings whose source line matches; findings without a line stay. lines: path, line, text."""
    marked = lines.filter(F.regexp_like("text", F.lit(pattern))).select("path", F.col("line").alias("start_line")).distinct()
    return findings.join(marked, ["path", "start_line"], "left_anti")


def drop_messages(findings: DataFrame, patterns: list[str]) -> DataFrame:
    hit = reduce(lambda a, b: a | b, (F.col("message").contains(p) for p in patterns), F.lit(False))
    return findings.filter(~F.coalesce(hit, F.lit(False)))


def filter_symbols(defs: DataFrame, kinds: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    if kinds:
        defs = defs.filter(F.lower(F.trim("kind")).isin(*[k.strip().lower() for k in kinds]))
    return defs.filter(F.regexp_like("name", F.lit(pattern))) if pattern else defs


def exclude_names(defs: DataFrame, patterns: list[str]) -> DataFrame:
    return defs.filter(~reduce(lambda a, b: a | b, (F.regexp_like("name", F.lit(p)) for p in patterns), F.lit(False)))


def dedupe_findings(findings: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row, by seq, of each (range, severity, message)."""
    own = Window.partitionBy(*RANGE, "severity", "message").orderBy(seq)
    return findings.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def at_position(ranges: DataFrame, line: Column | int, col: Column | int) -> DataFrame:
    """Ranges that hold the position, both ends included."""
    at = F.struct((line if isinstance(line, Column) else F.lit(line)).cast("long").alias("l"), (col if isinstance(col, Column) else F.lit(col)).cast("long").alias("c"))
    ends = [F.struct(F.col(f"{e}_line").cast("long").alias("l"), F.col(f"{e}_col").cast("long").alias("c")) for e in ("start", "end")]
    return ranges.filter((ends[0] <= at) & (at <= ends[1]))


def order_locations(df: DataFrame, *more: str) -> DataFrame:
    return df.orderBy(*RANGE, *more)


def check_limit(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")


def top(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first `limit` rows and whether there are more (truncated)."""
    if limit is None:
        return df.orderBy(*order).withColumn("truncated", F.lit(False))
    check_limit(limit)
    # at most limit + 1 rows meet in one task
    first = df.orderBy(*order).limit(limit + 1)
    rows = first.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > limit).filter(F.col("_n") <= limit).drop("_n")


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows from offset on, at most limit if it is above 0, with total_count and truncated."""
    offset = max(offset, 0)
    rows = df.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(limit) if limit > 0 else rows
    total = df.agg(F.count("*").alias("total_count"))
    # broadcast: one row
    return rows.crossJoin(F.broadcast(total)).withColumn("truncated", (F.lit(limit) > 0) & (F.col("total_count") > offset + limit))
