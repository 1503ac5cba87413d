"""Graph operators over edges (src, dst)."""

from __future__ import annotations

import os
import re
import tempfile
from functools import reduce
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.scalars import half_up
from codestrata.operators.joins import enclosing


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: no plan, and no estimate of sizes, passes from one round to the next."""
    return _written(df, f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    """Files say little of how large their rows are in memory, so a join with such a table is never a broadcast, unless it asks for one."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


class Rounds:
    """The tables of an iteration: a table put under a name takes the place of the last one, whose files go."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.held, self.n = spark, f"{shared_folder(spark)}/tables/{uuid4().hex}", {}, 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.n += 1
        old, self.held[name] = self.held.get(name), f"{self.folder}/{name}-{self.n}"
        out = _written(df, self.held[name])
        if old:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return out


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, whose driver and executors are one process, may come without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "codestrata-checkpoints")


def coupling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct neighbours in (ca) and out (ce) within the vertices, and instability ce / (ca + ce) to 3 places, 0 when isolated."""
    inside = edges.join(vertices.select(F.col("v").alias("src")), "src", "left_semi").join(vertices.select(F.col("v").alias("dst")), "dst", "left_semi").filter("src <> dst")
    ca = inside.groupBy(F.col("dst").alias("v")).agg(F.count_distinct("src").alias("ca"))
    ce = inside.groupBy(F.col("src").alias("v")).agg(F.count_distinct("dst").alias("ce"))
    n = vertices.select("v").join(ca, "v", "left").join(ce, "v", "left").select("v", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return n.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, half_up(F.col("ce"), F.col("ca") + F.col("ce"), 3)).otherwise(0.0))


def layer_violations(edges: DataFrame, layer_of: DataFrame) -> DataFrame:
    """Edges from a later layer to an earlier one. layer_of: v, layer (index); ends without a layer are ignored."""
    a, b = layer_of.select(F.col("v").alias("src"), F.col("layer").alias("src_layer")), layer_of.select(F.col("v").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.join(a, "src").join(b, "dst").filter("src_layer > dst_layer").select("src", "dst", "src_layer", "dst_layer")


def assign_layers(vertices: DataFrame, layers: list[list[str]]) -> DataFrame:
    """v and its layer: of the declared names in order, the first that is a whole component of v (by / or .) decides. layers: lists of names, from the top."""
    parts = F.split("v", r"[/.]")
    hit = F.filter(F.array(*[F.when(F.array_contains(parts, n), F.lit(i)) for i, names in enumerate(layers) for n in names]), lambda x: x.isNotNull())
    return vertices.select("v", F.get(hit, F.lit(0)).alias("layer")).filter("layer is not null")


#: Numbers of 64 bits that a node carries: a search has groups of at most 64 * WORDS roots, half of that as a rule.
WORDS = 16


def traverse(edges: DataFrame, roots: DataFrame, direction: str = "callees", depth: int = 1, max_items: int = 200) -> DataFrame:
    """Nodes within `depth` steps of each root: root, node, depth (first reached), root excluded, at most max_items a root by (depth, node).

    truncated is set once a root has reached max_items. direction: callers, callees or both.

    All roots are searched at once: each node carries a bit for each root of a group that has reached it, in WORDS numbers, so
    a level is one join and one aggregate with a row a node and group, however many of a group's roots meet there.
    """
    if direction not in ("callers", "callees", "both") or depth < 1:
        raise ValueError("direction must be callers, callees or both, and depth at least 1")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rounds = Rounds(edges.sparkSession)
    links = rounds.put("links", {"callees": edges.select("src", "dst"), "callers": back, "both": edges.select("src", "dst").union(back)}[direction].distinct())
    own = roots.select("root").distinct()
    groups = max(1, own.count() // (32 * WORDS))
    dealt = own.withColumn("g", F.pmod(F.xxhash64("root"), F.lit(groups)))
    dealt = dealt.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("root")) - 1)
    dealt = rounds.put("roots", dealt.select("root", F.struct("g", F.floor(F.col("i") / (64 * WORDS)).alias("part")).alias("g"), (F.col("i") % (64 * WORDS)).alias("i")))
    bits = [f"b{w}" for w in range(WORDS)]
    mark = lambda w: F.when(F.floor(F.col("i") / 64) == w, F.expr("shiftleft(1L, cast(i % 64 as int))")).otherwise(F.lit(0).cast("long"))
    # a node's bits: the roots of a group that have reached it
    seen = rounds.put("seen", dealt.select("g", F.col("root").alias("node"), *[mark(w).alias(x) for w, x in enumerate(bits)]))
    frontier, levels = seen, []
    for d in range(1, depth + 1):
        step = frontier.select("g", F.col("node").alias("src"), *bits).join(links, "src").groupBy("g", F.col("dst").alias("node")).agg(*[F.bit_or(x).alias(x) for x in bits])
        was = seen.select("g", "node", *[F.col(x).alias(f"_{x}") for x in bits])
        fresh = step.join(was, ["g", "node"], "left").select("g", "node", *[F.col(x).bitwiseAND(F.bitwise_not(F.coalesce(f"_{x}", F.lit(0).cast("long")))).alias(x) for x in bits])
        frontier = rounds.put(f"level-{d}", fresh.filter(reduce(lambda a, b: a | b, [F.col(x) != 0 for x in bits])))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(d)))
        if d < depth:
            seen = rounds.put("seen", seen.unionByName(frontier).groupBy("g", "node").agg(*[F.bit_or(x).alias(x) for x in bits]))
    if not levels:
        return roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("truncated")).limit(0)
    found = reduce(DataFrame.unionByName, levels).select("g", "node", "depth", F.posexplode(F.array(*bits)).alias("word", "mask")).filter("mask <> 0")
    found = found.select("g", "node", "depth", "word", F.explode(F.expr("filter(sequence(0, 63), k -> (shiftright(mask, k) & 1L) = 1L)")).alias("bit"))
    found = found.select("g", "node", "depth", (F.col("word") * 64 + F.col("bit")).alias("i"))
    found = found.join(dealt, ["g", "i"]).select("root", "node", "depth")
    own = Window.partitionBy("root")
    ranked = found.withColumn("_n", F.row_number().over(own.orderBy("depth", "node")))
    return ranked.withColumn("truncated", F.count("*").over(own) >= max_items).filter(F.col("_n") <= max_items).drop("_n")


def type_hierarchy(bases: DataFrame, roots: DataFrame, direction: str = "supertypes", depth: int = 3, max_items: int = 200) -> DataFrame:
    """traverse on class to base edges (src is the class)."""
    return traverse(bases, roots, {"supertypes": "callees", "subtypes": "callers", "both": "both"}[direction], depth, max_items)


class ReachIndex(NamedTuple):
    """labels: node, tree (its root), lo, hi; a node is at or below another of its tree just if its hi lies from the other's lo
    to the other's hi. others: src, dst, the edges that are not in the forest."""

    labels: DataFrame
    others: DataFrame


#: Siblings that are put in order in one task, about.
SIBLINGS = 1 << 17


def reach_index(edges: DataFrame) -> ReachIndex:
    """An index of what reaches what along edges (src, dst): a row a node and a row for each edge outside a spanning forest.

    Each node hangs below the least of its dst; a ring is opened at its least node. A walk around each tree, down and up every
    edge, is a chain of single links, and the places along it, counted from its end by doubled steps, are the labels. Rounds
    grow with the logarithm of a tree's size, each with a row for two steps of the walk. Siblings are put in order by runs of
    hashes, so a node with very many children is no single task.
    """
    rounds = Rounds(edges.sparkSession)
    links = rounds.put("links", edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    nodes = rounds.put("nodes", links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    above = rounds.put("above", links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to")))
    opened = jumps(above, rounds)[0].filter("ring is not null").select(F.col("ring").alias("node")).distinct()
    tree = rounds.put("tree", above.join(opened, "node", "left_anti"))
    others = rounds.put("others", links.join(tree.select(F.col("node").alias("src"), F.col("to").alias("dst")), ["src", "dst"], "left_anti"))
    runs = max(1, tree.count() // SIBLINGS)
    dealt = tree.withColumn("run", F.pmod(F.xxhash64("node"), F.lit(runs)))
    heads = dealt.groupBy("to", "run").agg(F.min("node").alias("head"))
    follow = heads.select("to", "run", F.lead("head").over(Window.partitionBy("to").orderBy("run")).alias("follow"))
    beside = dealt.withColumn("next", F.lead("node").over(Window.partitionBy("to", "run").orderBy("node"))).join(follow, ["to", "run"])
    first = heads.groupBy(F.col("to").alias("node")).agg(F.min_by("head", "run").alias("first"))
    place = lambda node, up: F.struct(node.alias("node"), up.alias("up"))
    down = nodes.join(first, "node", "left").select(place(F.col("node"), F.lit(False)).alias("at"), place(F.coalesce("first", "node"), F.col("first").isNull()).alias("to"))
    later = F.coalesce("next", "follow")
    up = beside.select(place(F.col("node"), F.lit(True)).alias("at"), place(F.coalesce(later, F.col("to")), later.isNull()).alias("to"))
    walk = rounds.put("walk", down.unionByName(up).withColumn("d", F.lit(1).cast("long")).withColumn("on", F.lit(True)))
    while not walk.filter("on").isEmpty():
        far = walk.select(F.col("at").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("on").alias("on2"))
        going = walk.filter("on").join(far, "to", "left")
        going = going.select("at", F.coalesce("to2", "to").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.coalesce("on2", F.lit(False)).alias("on"))
        walk = rounds.put("walk", walk.filter("not on").unionByName(going))
    near, wide = F.when(F.col("at.up"), F.col("d")), F.when(~F.col("at.up"), F.col("d"))
    labels = walk.groupBy(F.col("at.node").alias("node")).agg(F.min("to.node").alias("tree"), F.coalesce(F.max(near), F.lit(0)).alias("lo"), F.max(wide).alias("hi"))
    return ReachIndex(rounds.put("labels", labels), others)


#: Labels of one part: intervals that start in it are compared in one task, as a power of 2.
PART = 18


def _outermost(spans: DataFrame, rounds: Rounds) -> DataFrame:
    """Of each dst's intervals (dst, via, path, start_line, end_line, loop, new) those that lie in no other; equal ones are one,
    new if all of them are, and loop if one of them is.

    Intervals are apart or one within the other, so one lies in another just if one that starts before it ends after it. Those
    that start in one part of a tree are compared by a running maximum, and with earlier parts by their maximum.
    """
    at = ["dst", "path", "part"]
    dealt = spans.withColumn("part", F.shiftright("start_line", PART)).groupBy(*at, "via", "start_line", "end_line").agg(F.max("loop").alias("loop"), F.min("new").alias("new"))
    before = Window.partitionBy(*at).orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    own = rounds.put("own-parts", dealt.withColumn("_far", F.max("end_line").over(before)).filter("_far is null or _far < end_line").drop("_far"))
    parts = own.groupBy(*at).agg(F.max("end_line").alias("far"))
    earlier = parts.select(*at, F.max("far").over(Window.partitionBy("dst", "path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("far")).filter("far is not null")
    return own.join(earlier, at, "left").filter("far is null or far < end_line").select("dst", "via", "path", "start_line", "end_line", "loop", "new")


def reached(index: ReachIndex, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """src, dst for every path of one or more edges from a source to a target, both tables of node.

    What reaches a target is what is below it in its tree, and what is at or below the src of another edge whose dst already
    reaches the target or is the target. Such edges are found round by round, a row for a target and an edge's src; those
    below others of the same target are left out, since they add nothing. So a target's intervals are apart in the end, and
    each pair is made once.
    """
    rounds = Rounds(index.labels.sparkSession)
    spot = index.labels.select("node", F.col("tree").alias("path"), F.col("hi").alias("line"))
    span = index.labels.select(F.col("node").alias("via"), F.col("tree").alias("path"), F.col("lo").alias("start_line"), F.col("hi").alias("end_line"))
    points = rounds.put("points", sources.select("node").distinct().join(spot, "node").withColumnRenamed("node", "src"))
    far = span.select(F.col("via").alias("src"), F.col("path").alias("_path"), F.col("start_line").alias("_lo"), F.col("end_line").alias("_hi"))
    doors = rounds.put("doors", index.others.join(spot, F.col("dst") == F.col("node")).join(far, "src").select(F.col("src").alias("door"), "path", "line", "_path", "_lo", "_hi"))
    own = targets.select(F.col("node").alias("dst")).distinct().join(span, F.col("dst") == F.col("via"))
    frontier = seen = rounds.put("seen", own.withColumns({"loop": F.lit(False), "new": F.lit(True)}))
    while not doors.isEmpty() and not frontier.isEmpty():
        met = enclosing(doors, frontier.select("dst", "path", "start_line", "end_line"))
        # an edge from the target itself, whose dst reaches it, makes a ring
        met = met.select("dst", F.col("door").alias("via"), F.col("_path").alias("path"), F.col("_lo").alias("start_line"), F.col("_hi").alias("end_line"), (F.col("door") == F.col("dst")).alias("loop"), F.lit(True).alias("new"))
        seen = rounds.put("seen", _outermost(seen.withColumn("new", F.lit(False)).unionByName(met), rounds))
        frontier = seen.filter("new")
    # in an interval of another node, which reaches the target, lies the target itself only if it is on a ring
    return enclosing(points, seen).filter("src <> dst or via <> dst or loop").select("src", "dst")


def jumps(links: DataFrame, rounds: Rounds | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Where single links lead in the end, by doubled steps. links: node, to; one row a node.

    Returns ends (node, end, ring) and the steps taken: end is the first node without a link of its own, and ring is null;
    on a way that never ends, end is a node of the ring that the way runs into and ring the least node of that ring. The
    k-th table of steps (node, to) has the nodes 2^k links on, for ways that go on there. Rounds grow with the logarithm of
    the longest way, or of the number of links where there are rings.
    """
    rounds = rounds or Rounds(links.sparkSession)
    kind, tag, span = dict(links.dtypes)["node"], uuid4().hex[:8], 1
    goes_on = links.select(F.col("node").alias("to")).distinct()
    first = links.join(goes_on.withColumn("on", F.lit(True)), "to", "left").select("node", "to", F.coalesce("on", F.lit(False)).alias("on"), F.col("node").alias("least"))
    # a table a round: where the ways that still went on have come by then
    tables = [rounds.put(f"{tag}-0", first)]
    n = tables[0].count()
    while span <= n and not (now := tables[-1].filter("on")).isEmpty():
        after = now.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("on").alias("more"), F.col("least").alias("least2"))
        for t in tables:
            after = after.unionByName(t.filter("not on").select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("on").alias("more"), F.lit(None).cast(kind).alias("least2")))
        further = now.select("node", "to", "least").join(after, "to").select("node", F.col("far").alias("to"), F.col("more").alias("on"), F.least("least", "least2").alias("least"))
        tables.append(rounds.put(f"{tag}-{len(tables)}", further))
        span *= 2
    ends = reduce(DataFrame.unionByName, [t.filter("not on").select("node", F.col("to").alias("end")) for t in tables])
    # after so many steps a way without an end is on its ring, and every node of a ring is where one of them has come
    now = tables[-1].filter("on")
    ring = now.select(F.col("node").alias("end"), F.col("least").alias("ring")).join(now.select(F.col("to").alias("end")).distinct(), "end", "left_semi")
    endless = now.select("node", F.col("to").alias("end")).join(ring, "end").select("node", "end", "ring")
    return ends.withColumn("ring", F.lit(None).cast(kind)).unionByName(endless), [t.filter("on").select("node", "to") for t in tables[:-1]]


def sccs(edges: DataFrame) -> DataFrame:
    """node, component (least node) of strongly connected components with more than one node or a self-loop.

    Nodes with one way out are decided by where that way leads: all of them leave at once, along ways of any length, found
    by doubled steps (jumps); so do, with edges turned, nodes with one way in. Ways that never leave such nodes end in rings,
    each a component. Edges into a way that was left out go to its end instead; if they turn out to come from the end's own
    component, the way from there on belongs to it. What is left, nodes with two ways in and out at least, is searched from
    hashed pivots, many to a round: every node gets the least hash that reaches it, and what reaches that hash's node within
    its label is that node's component. Edges between labels leave. Rounds grow with the logarithm of a path, save in graphs
    that neither rule cuts; each round is a table in the shared folder.
    """
    rounds = Rounds(edges.sparkSession)
    plain = rounds.put("edges", edges.select("src", "dst").distinct())
    loops = plain.filter("src = dst").select(F.col("src").alias("node"))
    left = rounds.put("left", plain.filter("src <> dst"))
    found: list[DataFrame] = []
    levels: list[tuple[DataFrame, DataFrame, list[DataFrame]]] = []
    size = left.count()
    while size:
        before = size
        for src, dst in (("src", "dst"), ("dst", "src")):
            left, rings, level = _shortcut(left, src, dst, rounds, len(levels))
            found.append(rings)
            levels.append(level)
            size = left.count()
            if not size:
                break
        if size > 0.75 * before:
            left, some = _pivots(left, rounds, len(levels))
            found.append(some)
            size = left.count()
    groups = loops.select("node", F.col("node").alias("c")).limit(0)
    for some in found:
        groups = groups.unionByName(some)
    groups = rounds.put("groups", groups)
    for entries, ends, steps in reversed(levels):
        groups = rounds.put("groups", groups.unionByName(_readmit(groups, entries, ends, steps, rounds)).distinct())
    name = groups.groupBy("c").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    out = groups.join(name.filter("n > 1").select("c", "component"), "c").select("node", "component")
    return checkpoint(out.unionByName(loops.join(out, "node", "left_anti").select("node", F.col("node").alias("component"))))


def _shortcut(left: DataFrame, src: str, dst: str, rounds: Rounds, k: int) -> tuple[DataFrame, DataFrame, tuple]:
    """left without nodes that have one way out (from src to dst), and those without any; the rings among them (node, c); and what
    is needed to take others back: entries (src, at, end), ends (node, end) and steps."""
    e = left.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    single = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to")).filter("n = 1").select(F.col("a").alias("node"), "to")
    ends, steps = jumps(rounds.put(f"single-{k}", single), rounds)
    ends = rounds.put(f"ends-{k}", ends)
    rings = ends.filter("ring is not null")
    rings = rounds.put(f"rings-{k}", rings.select(F.col("end").alias("node"), F.col("ring").alias("c")).distinct())
    # ends without any way out, and ways into rings, are in no component but the rings
    ways = e.select(F.col("a").alias("end")).distinct()
    ends = rounds.put(f"open-{k}", ends.filter("ring is null").join(ways, "end", "left_semi").select("node", "end"))
    ruled = single.select("node")
    more = e.join(ruled, e["a"] == ruled["node"], "left_anti")
    into = rounds.put(f"into-{k}", more.join(ends, F.col("b") == F.col("node")).select("a", F.col("b").alias("at"), "end"))
    # an edge that stays leads to a node with more ways out, or to the end of a way
    kept = more.join(ways, more["b"] == ways["end"], "left_semi").join(ruled, F.col("b") == F.col("node"), "left_anti").select("a", "b")
    after = kept.unionByName(into.filter("a <> end").select("a", F.col("end").alias("b"))).distinct()
    left = rounds.put("left", after.select(F.col("a").alias(src), F.col("b").alias(dst)).select("src", "dst"))
    return left, rings, (into, ends, steps)


def _readmit(groups: DataFrame, entries: DataFrame, ends: DataFrame, steps: list[DataFrame], rounds: Rounds) -> DataFrame:
    """node, c of the nodes left out that lie between an edge from their end's component and that end, and of such ends."""
    of = lambda name: groups.select(F.col("node").alias(name), F.col("c").alias(f"c_{name}"))
    met = entries.join(of("a"), "a", "left").join(of("end"), "end", "left")
    met = met.filter("coalesce(c_a, a) = coalesce(c_end, end)").select(F.col("at").alias("node"), "end", F.coalesce("c_end", "end").alias("c"))
    ends_too = met.select(F.col("end").alias("node"), "c")
    marked = rounds.put("marked", met.select("node").distinct())
    for step in steps:
        marked = rounds.put("marked", marked.unionByName(step.join(marked, "node", "left_semi").select(F.col("to").alias("node"))).distinct())
    inside = marked.join(ends, "node").join(of("end"), "end", "left").select("node", F.coalesce("c_end", "end").alias("c"))
    return rounds.put(f"readmitted-{rounds.n}", inside.unionByName(ends_too))


def _pivots(left: DataFrame, rounds: Rounds, k: int) -> tuple[DataFrame, DataFrame]:
    """One search: the edges that stay, and node, c of the components found."""
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    own = rounds.put("own", nodes.withColumn("c", F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("at"))))
    color = rounds.put("color", _spread(own, left, "src", "dst", rounds))
    ends = [color.select(F.col("node").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst")]
    kept = rounds.put("kept", left.join(ends[0], "src").join(ends[1], "dst").filter("c_src = c_dst").select("src", "dst"))
    # backwards, what reaches the label's own node gets its hash, which is the least of all with that label
    back = _spread(own, kept, "dst", "src", rounds)
    found = back.join(color.withColumnRenamed("c", "color"), "node").filter("c = color").select("node", F.col("c.at").alias("c"))
    found = rounds.put(f"found-{k}", found)
    gone = found.select("node")
    rest = kept.join(gone, kept["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti")
    return rounds.put("left", rest.select("src", "dst")), found


def _spread(labels: DataFrame, edges: DataFrame, src: str, dst: str, rounds: Rounds) -> DataFrame:
    """The least label that reaches each node along edges. labels: node, c, where c.at is the node that a label is of.

    A node that holds a label is reached from that label's node, and so by all that reaches it: besides the labels of its
    neighbours it takes the one that its own label's node has by now. Labels are hashes, so the least one of a stretch is
    anywhere on it, and a round makes stretches longer by a share of their length.
    """
    edges = edges.select(src, dst)
    while True:
        near = edges.join(labels, edges[src] == labels["node"]).select(F.col(dst).alias("node"), "c", F.lit(False).alias("own"))
        jump = labels.select("node", F.col("c.at").alias("via")).join(labels.select(F.col("node").alias("via"), "c"), "via").select("node", "c", F.lit(False).alias("own"))
        every = labels.select("node", "c", F.lit(True).alias("own")).union(near).union(jump)
        new = every.groupBy("node").agg(F.min("c").alias("c"), F.min(F.when(F.col("own"), F.col("c"))).alias("old"))
        new = rounds.put(f"labels-{src}", new)
        labels = new.select("node", "c")
        if new.filter("c <> old").isEmpty():
            return labels


def cycles(edges: DataFrame, max_len: int = 4) -> DataFrame:
    """Elementary cycles of at most max_len nodes as arrays that start at their least node.

    Nodes that nothing leads to, or that lead nowhere, leave first, three times over (edges within components, by sccs, may be
    given instead). A cycle of n nodes is a way of n / 2 steps, rounded up, from its
    least node to a middle one and a way back: both are tables, grown step by step once, and meet by both ends. So ways grow
    with the degree to the power of half the length.
    """
    rounds = Rounds(edges.sparkSession)
    links = rounds.put("links", edges.select("src", "dst").distinct())
    own = links.filter("src = dst").select(F.array("src").alias("cycle"))
    steps = links.filter("src <> dst")
    for _ in range(3):
        through = steps.select("src").distinct().join(steps.select(F.col("dst").alias("src")), "src", "left_semi")
        steps = rounds.put("steps", steps.join(through, "src", "left_semi").join(through.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
    out = [own]
    # ways of k steps from a start to an end over nodes greater than the start; there: with edges, back: against them
    ways = {("there", 1): steps.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("dst").alias("way"))}
    ways["back", 1] = steps.filter("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("end"), F.array("src").alias("way"))
    turned = {"there": steps, "back": steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    for n in range(2, max_len + 1):
        there, back = (n + 1) // 2, n // 2
        for side, k in (("there", there), ("back", back)):
            if (side, k) not in ways:
                longer = ways[side, k - 1].join(turned[side], F.col("end") == F.col("src")).filter("dst > start and not array_contains(way, dst)")
                ways[side, k] = rounds.put(f"{side}-{k}", longer.select("start", F.col("dst").alias("end"), F.concat("way", F.array("dst")).alias("way")))
        met = ways["there", there].join(ways["back", back].withColumnRenamed("way", "home"), ["start", "end"])
        rest = F.slice("home", 1, back - 1) if back > 1 else F.slice("home", 1, 0)
        met = met.filter(~F.arrays_overlap("way", rest)) if back > 1 else met
        out.append(met.select(F.concat(F.array("start"), "way", F.reverse(rest)).alias("cycle")))
    return reduce(DataFrame.unionByName, out)
