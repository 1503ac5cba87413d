"""Summaries, metrics, coverage, duplicates, rule scans and conformance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.scalars import half_up


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity per path; an unknown severity counts as information."""
    level = F.lower(F.trim("severity"))
    n = {k: F.count_if(F.coalesce(level, F.lit("")) == k) for k in ("error", "warning", "hint")}
    return findings.groupBy("path").agg(n["error"].alias("error"), n["warning"].alias("warning"), (F.count("*") - n["error"] - n["warning"] - n["hint"]).alias("information"), n["hint"].alias("hint"), F.count("*").alias("total"))


def function_metrics(nodes: DataFrame) -> DataFrame:
    """Cyclomatic and cognitive complexity, nesting, lines and parameters of each function, from nodes' enclosing functions.

    A node counts in every function around it: fn_path is exploded and what lies between is a difference of depths.
    """
    fns = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef')").select("repo", "path", F.col("nid").alias("fn"), "name", F.col("nest_cog").alias("cog0"), F.col("nest_all").alias("all0"), (F.col("end_line") - F.col("line") + 1).alias("loc"), "n_params")
    inside = nodes.select("repo", "path", F.explode("fn_path").alias("fn"), "kind", "nest_cog", "nest_all", "bool_n")
    met = inside.join(fns.select("repo", "path", "fn", "cog0", "all0"), ["repo", "path", "fn"])
    branch = F.col("kind").isin("If", "While", "For", "AsyncFor", "ExceptHandler")
    nest = F.col("kind").isin("If", "While", "For", "AsyncFor", "ExceptHandler", "With", "AsyncWith", "Try")
    got = met.groupBy("repo", "path", "fn").agg(
        F.sum(F.when(branch | (F.col("kind") == "Assert"), 1).otherwise(0) + F.when(F.col("kind") == "BoolOp", F.col("bool_n") - 1).otherwise(0)).alias("cy"),
        F.sum(F.when(branch, 1 + F.col("nest_cog") - F.col("cog0")).when(F.col("kind") == "BoolOp", 1).otherwise(0)).alias("co"),
        F.max(F.when(nest, F.col("nest_all") - F.col("all0") + 1)).alias("ne"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return fns.join(got, ["repo", "path", "fn"], "left").select("repo", "path", "fn", "name", (zero("cy") + 1).alias("cyclomatic"), zero("co").alias("cognitive"), zero("ne").alias("nesting"), F.col("loc").cast("long").alias("loc"), F.col("n_params").cast("long").alias("n_params"))


def metrics_summary(values: DataFrame, column: str) -> DataFrame:
    """Rows, average to two places and greatest of an integer column; zeros without rows."""
    n, s, m = F.count(column), F.coalesce(F.sum(column), F.lit(0)), F.coalesce(F.max(column), F.lit(0))
    return values.agg(n.alias("n"), s.alias("s"), m.cast("long").alias("greatest")).select("n", F.when(F.col("n") > 0, half_up(F.col("s"), F.col("n"), 2)).otherwise(0.0).alias("average"), "greatest")


def percentage(part: str, whole: str, empty: float):
    return F.when(F.col(whole) > 0, half_up(100 * F.col(part), F.col(whole), 1)).otherwise(empty)


def coverage_summary(items: DataFrame, flag: str, empty: float = 100.0) -> DataFrame:
    """How many items have flag, of how many, in percent (`empty` without items)."""
    return items.agg(F.count("*").alias("total"), F.count_if(flag).alias("covered")).withColumn("pct", percentage("covered", "total", empty))


def duplicates(items: DataFrame, norm: str, item: str, min_lines: int = 3, lines: str | None = None) -> DataFrame:
    """Groups of two or more items with the same normalised text: h, n, first and each of their items, a row an occurrence.
    Texts count as the same by two hashes and their length; null texts are no group's."""
    if lines:
        items = items.filter(F.col(lines) >= min_lines)
    rows = items.filter(F.col(norm).isNotNull()).select(F.md5(norm).alias("h"), F.xxhash64(norm).alias("_h"), F.length(norm).alias("_n"), F.col(item).alias("item"))
    groups = rows.groupBy("h", "_h", "_n").agg(F.count("*").alias("n"), F.min("item").alias("first")).filter("n >= 2")
    return rows.join(groups, ["h", "_h", "_n"]).select("h", "n", "first", "item")


def rule_scan(lines: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A row for each line and rule (id, severity, pattern) that matches it."""
    hits = F.array(*[F.when(F.regexp_like("text", F.lit(p)), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, p in rules])
    rows = lines.withColumn("_r", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    return rows.select(*[c for c in lines.columns if c != "text"], "_r.rule_id", "_r.severity", F.trim("text").alias("snippet"))


def test_coverage(defs: DataFrame, refs: DataFrame, listed: bool = True) -> DataFrame:
    """Each definition (sym) with the distinct test files (ref_file) that refer to it: their number, their sorted list and whether there are any.

    A list is one value of a row; without it (listed=False) counts are made in two steps, whatever the number of files, and
    covering_files has the files as rows.
    """
    counted = F.count_distinct("ref_file")
    n = refs.groupBy("sym").agg(counted.alias("n"), *([F.sort_array(F.collect_set("ref_file")).alias("files")] if listed else []))
    met = defs.select("sym").join(n, "sym", "left")
    return met.select("sym", F.coalesce("n", F.lit(0)).cast("int").alias("test_files"), *(["files"] if listed else []), F.col("n").isNotNull().alias("covered"))


def covering_files(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """sym, ref_file: the distinct test files that refer to each definition, a row each."""
    return refs.filter("ref_file is not null").select("sym", "ref_file").distinct().join(defs.select("sym"), "sym", "left_semi")


def missing_annotations(facts: DataFrame) -> DataFrame:
    """Functions that lack an annotation: repo, path, name, line, no_return, and the counted parameters without one, in order."""
    functions = facts.filter("tag = 'def' and kind = 'function'").select("repo", "path", "nid", "name", "line", (~F.col("annotated")).alias("no_return"))
    bare = facts.filter("tag = 'param' and role = '' and not annotated").groupBy("repo", "path", F.col("scope").alias("nid")).agg(F.sort_array(F.collect_list(F.struct("name_line", "name_col", "name"))).alias("p"))
    rows = functions.join(bare, ["repo", "path", "nid"], "left").filter("no_return or p is not null")
    return rows.select("repo", "path", "name", "line", "no_return", F.array_join(F.transform(F.coalesce("p", F.expr("array()")), lambda x: x["name"]), ",").alias("params"))


def annotation_summary(facts: DataFrame) -> DataFrame:
    """One row: functions and counted parameters, how many are annotated, and the share of both together in percent (100 without any)."""
    functions, params = F.expr("tag = 'def' and kind = 'function'"), F.expr("tag = 'param' and role = ''")
    n = facts.agg(F.count_if(functions).alias("functions"), F.count_if(functions & F.col("annotated")).alias("returns"), F.count_if(params).alias("params"), F.count_if(params & F.col("annotated")).alias("annotated"))
    return n.withColumns({"part": F.col("returns") + F.col("annotated"), "whole": F.col("functions") + F.col("params")}).withColumn("pct", percentage("part", "whole", 100.0)).drop("part", "whole")


def interface_conformance(methods: DataFrame, classes: list[str]) -> DataFrame:
    """Each method of the named classes: in how many of them it is, whether in all (common), whether its parameters then differ
    (mismatched), and for others the sorted classes that have it (only_in). methods: cls, method, params."""
    own = methods.filter(F.col("cls").isin(*classes)).select("cls", "method", "params")
    n = own.groupBy("method").agg(F.count_distinct("cls").alias("classes"), F.count_distinct("params").alias("p"), F.sort_array(F.collect_set("cls")).alias("has"))
    common = F.col("classes") == len(set(classes))
    return n.select("method", "classes", common.alias("common"), (common & (F.col("p") > 1)).alias("mismatched"), F.when(~common, F.array_join("has", ",")).alias("only_in"))


def protocol_text(methods: DataFrame, classes: list[str], name: str = "GeneratedProtocol") -> DataFrame:
    """The text of a protocol class: a line for each method that all named classes have, by the first of them, with its return
    annotation; private ones but __init__ are left out, and without common methods there is a pass. methods: cls, method, params, returns."""
    common = interface_conformance(methods, classes).filter("common").select("method")
    shown = methods.filter(F.col("cls") == classes[0]).join(common, "method").groupBy("method").agg(F.min(F.struct("params", "returns")).alias("s"))
    params = F.concat(F.lit("self"), F.when(F.col("s.params") != "", F.concat(F.lit(", "), "s.params")).otherwise(""))
    line = F.concat(F.lit("    def "), "method", F.lit("("), params, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "s.returns"), F.lit("")), F.lit(": ..."))
    public = ~F.col("method").startswith("_") | (F.col("method") == "__init__")
    lines = shown.agg(F.sort_array(F.collect_list(F.when(public, F.struct("method", line.alias("l"))))).alias("l"), F.count("*").alias("n"))
    body = F.concat_ws("\n", F.lit(f"class {name}(Protocol):"), F.when(F.col("n") == 0, F.array(F.lit("    pass"))).otherwise(F.transform("l", lambda x: x["l"])))
    return lines.select(F.concat(body, F.lit("\n")).alias("text"))
