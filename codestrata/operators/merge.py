"""Unions by priority, snapshot differences and line deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_prioritized(primary: DataFrame, secondary: DataFrame, key: list[str], query: str) -> DataFrame:
    """primary and the secondary rows with a new key, of equal keys the row with the least other columns; source says of each
    query whether secondary rows were added. Queries are told by a summary that is joined back, so a hot query is no single task.
    Null queries are one query; keys with nulls are new."""
    new = secondary.join(primary.select(*key).distinct(), key, "left_anti")
    rest = [c for c in secondary.columns if c not in key]
    new = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.select(*key).distinct()
    both = primary.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)))
    told = both.groupBy(F.col(query).alias("_q")).agg(F.max("_p").alias("_max"), F.min("_p").alias("_min"))
    label = F.when(F.col("_max") == 0, "secondary").when(F.col("_min") == 0, "combined").otherwise("primary")
    return both.join(told, F.col(query).eqNullSafe(F.col("_q"))).select(*primary.columns, label.alias("source"))


def fallback_union(primary: DataFrame, secondary: DataFrame, query: str) -> DataFrame:
    """secondary only for queries without primary rows."""
    return primary.unionByName(secondary.join(primary.select(query).distinct(), query, "left_anti")).distinct()


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """added, removed, changed or unchanged for each key of two versions; a null content is a content of its own."""
    a = old.select(key, F.md5(content).alias("old_hash"), F.lit(True).alias("old"))
    b = new.select(key, F.md5(content).alias("new_hash"), F.lit(True).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def _lines(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(key, F.explode(F.split(content, "\r\n|\r|\n")).alias("text"))


def line_changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """The lines of each key whose counts differ: key, text, d (above 0 for lines added, so many times; below for removed ones)."""
    return _net_lines(old, new, key, content).filter("d <> 0")


def _net_lines(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    n = _lines(old, key, content).withColumn("d", F.lit(-1)).union(_lines(new, key, content).withColumn("d", F.lit(1)))
    return n.groupBy(key, "text").agg(F.sum("d").alias("d"))


def line_delta(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Lines added and removed per key, as multisets: counts of a line in one version above those in the other."""
    net = _net_lines(old, new, key, content)
    return net.groupBy(key).agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


def assign_root(paths: DataFrame, roots: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """The longest declared root over each path by components, else the nearest directory that holds a marker, else null.

    paths: path; roots: root; markers: root.
    """
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("p")).select("path", "depth", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("root"))
    found = up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", "depth").alias("declared"))
    out = paths.join(found, "path", "left")
    if markers is None:
        return out.select("path", F.col("declared").alias("root"))
    near = up.join(markers.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", "depth").alias("near"))
    return out.join(near, "path", "left").select("path", F.coalesce("declared", "near").alias("root"))


def within_root(paths: DataFrame, root: str) -> DataFrame:
    root = root.rstrip("/")
    return paths.filter((F.col("path") == root) | F.col("path").startswith(root + "/"))
