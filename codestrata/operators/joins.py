"""Interval joins, context, anti joins and symbol look-ups over DataFrames with named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.scalars import dead_confidence


def add_context(locs: DataFrame, lines: DataFrame) -> DataFrame:
    """The stripped source line of each location (path, start_line), null out of range. lines: path, line, text."""
    text = lines.select("path", F.col("line").alias("start_line"), F.regexp_replace("text", "[\r\n]+$", "").alias("context"))
    return locs.join(text, ["path", "start_line"], "left")


#: Levels of blocks: lines up to 2^40.
LEVELS = 40


def aligned_blocks(start: Column, end: Column) -> Column:
    """The fewest blocks (k, b) that make up the lines from start to end: block b of level k has the 2^k lines from b * 2^k on.

    At each level at most the first and the last block stick out of the pairs that the next level is made of, so an interval
    of n lines has at most 2 log2(n) blocks.
    """
    at = lambda k: (F.call_function("shiftright", start.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", end.cast("long") + 1, k))

    def level(k):
        lo, hi = at(k)
        block = lambda odd, b: F.when((lo < hi) & (odd % 2 == 1), F.struct(k.alias("k"), b.alias("b")))
        return F.array(block(lo, lo), block(hi, hi - 1))

    # no block is longer than the interval; a level more makes up for rounded logarithms
    top = F.least(F.floor(F.log2(F.greatest(end.cast("long") - start.cast("long") + 1, F.lit(1)))).cast("int") + 1, F.lit(LEVELS - 1))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), level)), lambda x: x.isNotNull())


def enclosing(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """All (point, interval) pairs with start_line <= line <= end_line in a path.

    Intervals become aligned blocks, and a point meets them by equality in the one block of each level that it lies in, each
    pair once, whatever the lengths. The driver sees the levels that occur, LEVELS at most. Lines are 0 or more.
    Blocks are more and wider than the files they come from suggest, so neither side is ever broadcast.
    points: path, pid, line. intervals: path, nid, start_line, end_line.
    """
    cut = intervals.withColumn("_x", F.explode(aligned_blocks(F.col("start_line"), F.col("end_line"))))
    cut = cut.select(*intervals.columns, F.col("_x.k").alias("_k"), F.col("_x.b").alias("_b"))
    levels = sorted(r["_k"] for r in cut.select("_k").distinct().collect())
    if not levels:
        return points.join(intervals, "path").limit(0)
    lies = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(F.col("line").cast("long"), k).alias("b")) for k in levels]))
    dealt = points.withColumn("_x", lies).select(*points.columns, F.col("_x.k").alias("_k"), F.col("_x.b").alias("_b"))
    return dealt.hint("merge").join(cut.hint("merge"), ["path", "_k", "_b"]).drop("_k", "_b")


def enclosing_scope(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """The innermost interval over each point; equal spans keep the least nid; null without one."""
    best = enclosing(points, intervals).groupBy("path", "pid").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "nid")).alias("b"))
    return points.select("path", "pid").join(best, ["path", "pid"], "left").select("path", "pid", F.col("b.nid").alias("nid"))


def selection_ranges(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """All intervals over each point from the inner to the outer, as nids."""
    own = F.sort_array(F.collect_list(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "nid")))
    return enclosing(points, intervals).groupBy("path", "pid").agg(F.transform(own, lambda x: x["nid"]).alias("nids"))


def nest_outline(defs: DataFrame, mode: str = "direct") -> DataFrame:
    """nid and parent_id: the smallest ("direct") or the largest ("outermost") other interval around each one."""
    if mode not in ("direct", "outermost"):
        raise ValueError("mode must be direct or outermost")
    inner = defs.select("path", F.col("nid").alias("pid"), F.col("start_line").alias("line"), F.col("end_line").alias("last"), F.col("start_line").alias("own_start"))
    met = enclosing(inner, defs).filter("last <= end_line and pid <> nid and (end_line - start_line > last - own_start or nid < pid)")
    span = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "nid")
    best = (F.min if mode == "direct" else F.max)(span)
    return inner.select("path", F.col("pid").alias("nid")).join(met.groupBy("path", F.col("pid").alias("nid")).agg(best.alias("b")), ["path", "nid"], "left").select("path", "nid", F.col("b.nid").alias("parent_id"))


def unused(imports: DataFrame, uses: DataFrame, file: str, name: str, exports: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Imported names that their file neither uses nor exports; the last import of a name stands for it."""
    if order:
        imports = imports.withColumn("_n", F.row_number().over(Window.partitionBy(file, name).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    left = imports.join(uses.select(file, name).distinct(), [file, name], "left_anti")
    return left.join(exports.select(file, name).distinct(), [file, name], "left_anti") if exports is not None else left


def dead_code(defs: DataFrame, refs: DataFrame, findings: DataFrame | None = None, exclude: list[str] | None = None, include_tests: bool = False) -> DataFrame:
    """Undecorated definitions with no reference from another file and at most one inside, and definitions that findings call unused.

    defs: sym, name, decorated, in_test; refs: sym, external (0/1); findings: sym. reason is "no references" or "unused
    diagnostic", and confidence follows from it and the name. On a clash the reported row wins.
    """
    counts = refs.groupBy("sym").agg(F.sum("external").alias("ext"), F.sum(1 - F.col("external")).alias("own"))
    for p in exclude or ():
        defs = defs.filter(~F.regexp_like("name", F.lit(p)))
    if not include_tests:
        defs = defs.filter(~F.col("in_test"))
    rows = defs.filter(~F.col("decorated")).join(counts, "sym", "left").filter("coalesce(ext, 0) = 0 and coalesce(own, 0) <= 1").select("sym", "name", F.lit("no references").alias("reason"))
    if findings is not None:
        told = defs.join(findings.select("sym").distinct(), "sym", "left_semi").select("sym", "name", F.lit("unused diagnostic").alias("reason"))
        rows = told.unionByName(rows.join(told.select("sym"), "sym", "left_anti"))
    return rows.withColumn("confidence", dead_confidence(F.col("name"), F.col("reason")))


def suggest_imports(unresolved: DataFrame, exporters: DataFrame) -> DataFrame:
    """Statements that would import each unresolved name: name x exporters of that name (name, module)."""
    text = F.when(F.col("name") == F.col("module"), F.concat(F.lit("import "), "module")).otherwise(F.concat(F.lit("from "), "module", F.lit(" import "), "name"))
    return unresolved.select("name").distinct().join(exporters.select("name", "module").distinct(), "name").select("name", "module", text.alias("statement"))


def search_symbols(defs: DataFrame, queries: list[str]) -> DataFrame:
    """For each query its exact matches by name, else the names that contain it in any case. queries: the few that a user states;
    they are part of the plan, so a definition meets them in one pass without a join."""
    if not queries:
        return defs.limit(0).withColumns({"q": F.lit(""), "match": F.lit("")})
    told = F.array(*map(F.lit, dict.fromkeys(queries)))
    kind = lambda q: F.when(F.col("name") == q, "exact").when(F.contains(F.lower("name"), F.lower(q)), "part")
    hits = defs.withColumn("_h", F.explode(F.filter(F.transform(told, lambda q: F.struct(q.alias("q"), kind(q).alias("match"))), lambda h: h["match"].isNotNull())))
    rows = hits.select(*defs.columns, "_h.q", "_h.match")
    # broadcast: at most one row a query
    exact = F.broadcast(rows.filter("match = 'exact'").select("q").distinct())
    return rows.filter("match = 'exact'").unionByName(rows.filter("match = 'part'").join(exact, "q", "left_anti").select(*rows.columns)).distinct()


def gram_index(defs: DataFrame, longest: int = 3) -> DataFrame:
    """name, gram: the distinct names of defs by their distinct runs of 1 to `longest` characters in lower case. Store it to keep it
    between searches."""
    names = defs.select("name").filter("name is not null").distinct().withColumn("l", F.lower("name"))
    runs = F.expr(f"array_distinct(flatten(transform(sequence(1, {longest}), n -> if(length(l) < n, array(), transform(sequence(1, length(l) - n + 1), i -> substring(l, i, n))))))")
    return names.select("name", F.explode(runs).alias("gram"))


def search_many(defs: DataFrame, queries: DataFrame, index: DataFrame | None = None, longest: int = 3) -> DataFrame:
    """search_symbols for a table of queries (q): each one's exact matches by name, else the names that contain it in any case.

    A query's names are sought among those that have its rarest run of characters (gram_index), and then compared; a query
    with a run that no name has finds nothing, and so do null and empty ones. A query never meets all definitions.
    """
    index = gram_index(defs, longest) if index is None else index
    asked = queries.select("q").filter("length(q) > 0").distinct()
    exact = asked.join(defs, asked["q"] == defs["name"]).select(*defs.columns, "q", F.lit("exact").alias("match"))
    rest = asked.join(defs.select(F.col("name").alias("q")).distinct(), "q", "left_anti").withColumn("l", F.lower("q"))
    runs = F.expr(f"array_distinct(transform(sequence(1, greatest(length(l) - {longest - 1}, 1)), i -> substring(l, i, least({longest}, length(l)))))")
    runs = rest.select("q", "l", F.explode(runs).alias("gram"))
    n = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = runs.join(n, "gram", "left").groupBy("q", "l").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lost")).filter("lost = 0")
    met = rarest.join(index, "gram").filter(F.contains(F.lower("name"), F.col("l"))).select("q", "name")
    part = met.join(defs, "name").select(*defs.columns, "q", F.lit("part").alias("match"))
    return exact.unionByName(part).distinct()


def with_zero_kinds(rows: DataFrame, kinds: DataFrame, kind: str = "kind") -> DataFrame:
    """Counts for every kind, 0 where none. kinds: a column of that name."""
    dim = kinds.select(kind).distinct()
    return dim.join(rows.groupBy(kind).agg(F.count("*").alias("n")), kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))
