"""Strongly connected components and ways against loops."""

import random
import time
from collections import Counter

import pytest

from codestrata.operators import graph


def components(edges):
    """Kosaraju's two passes, without recursion."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in sorted({x for e in edges for x in e}):
        stack = [(root, iter(out.get(root, ())))] if root not in seen else []
        seen.add(root)
        while stack:
            for b in stack[-1][1]:
                if b not in seen:
                    seen.add(b)
                    stack.append((b, iter(out.get(b, ()))))
                    break
            else:
                order.append(stack.pop()[0])
    of = {}
    for root in reversed(order):
        stack = [root]
        while stack:
            a = stack.pop()
            if a not in of:
                of[a] = root
                stack += back.get(a, ())
    least, n = {}, Counter(of.values())
    for a, root in of.items():
        least[root] = min(a, least.get(root, a))
    own = {a for a, b in edges if a == b}
    return {a: least[root] for a, root in of.items() if n[root] > 1 or a in own}


def found(spark, edges, kind="long"):
    return {r["node"]: r["component"] for r in graph.sccs(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).collect()}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges, base = [], 0
    for n, m in ((1, 1), (2, 3), (6, 8), (12, 15), (30, 40), (40, 60), (60, 90), (40, 160)):
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(m)]
        base += n
    assert found(spark, edges) == components(edges)
    assert found(spark, []) == {} and found(spark, [(3, 3), (3, 4)]) == {3: 3}


def test_components_of_dense_cores_and_trees_that_hang_on_them(spark):
    rng = random.Random(6)
    edges = []
    for k in range(6):  # cores with two ways in and out, in a row, each with ways round from node to node
        at = 1000 * k
        edges += [(at + i, at + (i * 3 + 1) % 9) for i in range(9)] + [(at + i, at + (i + 2) % 9) for i in range(9)] + [(at + 8, at + 1000), (at + 8, at + 1003)]
        for j in range(5):
            way = [at + rng.randrange(9), *range(at + 100 + 10 * j, at + 100 + 10 * j + rng.randint(1, 8)), at + rng.randrange(9)]
            edges += zip(way, way[1:])
            edges.append((at + 500 + j, way[len(way) // 2]))
    assert found(spark, edges) == components(edges)


@pytest.mark.parametrize("kind", ["ring", "chain of pairs", "ladder"])
def test_components_of_long_graphs_end(spark, kind):
    n = 10_000
    if kind == "ring":
        edges = [(i, (i + 1) % n) for i in range(n)] + [(i, n + i) for i in range(0, n, 7)]
    elif kind == "chain of pairs":
        edges = [e for i in range(0, 2000, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))]
    else:
        edges = [e for i in range(400) for e in ((i, i + 1), (i + 1, i))] + [(1000 + i, 1000 + (i + k) % 300) for i in range(300) for k in (1, 2)]
    began = time.perf_counter()
    assert found(spark, edges) == components(edges)
    print(kind, round(time.perf_counter() - began, 1), "seconds")


def test_ways_end_or_run_into_rings(spark):
    links = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(3000, 2003), (3001, 3000), (4000, 4000), (4001, 4000)]
    ends, _ = graph.jumps(spark.createDataFrame(links, "node long, to long"))
    got = {r["node"]: (r["end"], r["ring"]) for r in ends.collect()}
    assert len(got) == len(links)
    assert all(got[i] == (1000, None) for i in range(1000))
    assert all(got[i][1] == 2000 for i in (*range(2000, 2007), 3000, 3001)) and got[4000] == got[4001] == (4000, 4000)
    assert graph.jumps(spark.createDataFrame([], "node long, to long"))[0].count() == 0


@pytest.mark.parametrize(("direction", "depth", "most"), [("callees", 3, 200), ("both", 2, 7), ("callers", 50, 200)])
def test_searches_from_many_roots(spark, direction, depth, most):
    rng = random.Random(depth)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(330)] + [(400 + i, 401 + i) for i in range(20)]
    roots = [*range(0, 300, 2), 400, 420, 999]
    near = {}
    for a, b in edges:
        for x, y in [(a, b)] * (direction != "callers") + [(b, a)] * (direction != "callees"):
            near.setdefault(x, set()).add(y)
    want = set()
    for root in roots:
        at, depth_of = {root}, {root: 0}
        for d in range(1, depth + 1):
            at = {y for x in at for y in near.get(x, ())} - depth_of.keys()
            depth_of |= dict.fromkeys(at, d)
        reached = sorted((d, x) for x, d in depth_of.items() if d)
        want |= {(root, x, d, len(reached) >= most) for d, x in reached[:most]}
    frame = spark.createDataFrame(edges, "src long, dst long")
    rows = graph.traverse(frame, spark.createDataFrame([(r,) for r in roots * 2], "root long"), direction, depth, most).collect()
    assert {(r["root"], r["node"], r["depth"], r["truncated"]) for r in rows} == want and len(rows) == len(want)
    assert graph.traverse(frame.limit(0), frame.select(frame["src"].alias("root"))).count() == 0


def test_cycles_by_halves(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(26)} | {(20, 21), (21, 22), (22, 20), (30, 30), (22, 0)}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want, stack = set(), [(a,) for a in out]
    while stack:
        way = stack.pop()
        for b in out.get(way[-1], ()):
            if b == way[0]:
                want.add(way)
            elif b > way[0] and b not in way and len(way) < 7:
                stack.append((*way, b))
    frame = spark.createDataFrame(sorted(edges), "src int, dst int")
    for n in (3, 7):
        got = [tuple(r["cycle"]) for r in graph.cycles(frame, n).collect()]
        assert set(got) == {w for w in want if len(w) <= n} and len(got) == len(set(got))


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    pairs = set()
    for a in out:
        stack, seen = list(out[a]), set()
        while stack:
            b = stack.pop()
            if b not in seen:
                seen.add(b)
                stack += out.get(b, ())
        pairs |= {(a, b) for b in seen}
    return pairs


def test_reachability_of_random_graphs(spark, monkeypatch):
    """Trees, second ways up, rings, loops, repeated and null ends; siblings in several runs."""
    monkeypatch.setattr(graph, "SIBLINGS", 16)
    rng = random.Random(9)
    edges, base = [(7000, 7000), (7001, 7001), (7001, 7002), (7002, 7001)], 0
    for n, m in ((2, 2), (6, 6), (15, 14), (30, 34), (50, 50), (40, 70)):
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(m)]
        base += n
    edges += [(500 + k, 500 + rng.randrange(k)) for k in range(1, 80)] + [(600 + k, 600) for k in range(1, 90)] + [(601, 650), (600, 505)]
    given = [*edges, *edges[:9], (None, 3), (4, None)]
    index = graph.reach_index(spark.createDataFrame(given, "src long, dst long"))
    nodes = index.labels.select("node")
    want = closure(edges)
    assert sorted(map(tuple, graph.reached(index, nodes, nodes).collect())) == sorted(want)
    some, others = nodes.filter("node % 3 = 0"), nodes.filter("node % 5 < 2")
    assert sorted(map(tuple, graph.reached(index, some, others).collect())) == sorted((a, b) for a, b in want if a % 3 == 0 and b % 5 < 2)
    # a row a node, and a row for each edge that the forest leaves out
    ends = {x for e in edges for x in e}
    assert index.labels.count() == len(ends) and index.labels.count() + index.others.count() <= len(ends) + len(set(edges))


def test_reachability_of_nothing_and_of_a_long_chain(spark):
    index = graph.reach_index(spark.createDataFrame([], "src string, dst string"))
    assert graph.reached(index, index.labels.select("node"), index.labels.select("node")).collect() == []
    chain = graph.reach_index(spark.range(1, 1001).selectExpr("id AS src", "id - 1 AS dst"))
    top = spark.createDataFrame([(0,), (990,)], "node long")
    got = Counter(r["dst"] for r in graph.reached(chain, chain.labels.select("node"), top).collect())
    assert got == {0: 1000, 990: 10} and chain.others.isEmpty()


def test_intervals_within_others_of_a_target_leave(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 3)
    rows = [(0, 0, 0, 0, 40, False, False), (0, 1, 0, 2, 30, False, True), (0, 2, 0, 17, 18, False, True), (0, 3, 0, 41, 42, False, True), (0, 3, 0, 41, 42, True, False), (0, 4, 1, 5, 6, False, True), (9, 2, 0, 17, 18, False, True), (9, 5, 0, 16, 20, False, True)]
    spans = spark.createDataFrame(rows, "dst long, via long, path long, start_line long, end_line long, loop boolean, new boolean")
    got = graph._outermost(spans, graph.Rounds(spark)).select("dst", "via", "loop", "new").collect()
    assert sorted(map(tuple, got)) == [(0, 0, False, False), (0, 3, True, False), (0, 4, False, True), (9, 5, False, True)]


def test_rounds_are_not_broadcast(spark):
    """A table of a round is small as files and large in memory, so a join with it must not send it to the driver."""
    rounds = graph.Rounds(spark)
    a = rounds.put("a", spark.range(1000).selectExpr("id AS src", "id % 7 AS dst"))
    b = graph.checkpoint(spark.range(7).selectExpr("id AS dst", "id AS far"))
    both = a.join(b.groupBy("dst").count(), "dst", "left").unionByName(a.join(b.filter("far > 3"), "dst", "left_semi").selectExpr("dst", "src", "0L AS count"))
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.count() == 1000 + sum(i % 7 > 3 for i in range(1000))
