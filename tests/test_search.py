"""Searches for many names at once, points in intervals of any length, and nodes by the nodes around and within them."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import code, graph, joins
from codestrata.sources import facts


def test_many_queries_are_those_of_a_loop(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB_1éÉ") for _ in range(n))
    names = [word(rng.randint(0, 9)) for _ in range(300)] + ["same"] * 3 + [None]
    queries = [word(rng.randint(0, 5)) for _ in range(120)] + names[:20] + ["SAME", "same", "nowhere", None]
    defs = spark.createDataFrame(list(enumerate(names)), "sym int, name string")
    got = joins.search_many(defs, spark.createDataFrame([(q,) for q in queries], "q string")).select("q", "sym", "name", "match").collect()
    want = set()
    for q in {q for q in queries if q}:
        exact = {(q, i, n, "exact") for i, n in enumerate(names) if n == q}
        want |= exact or {(q, i, n, "part") for i, n in enumerate(names) if n is not None and q.lower() in n.lower()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert joins.search_many(defs.filter(F.lit(False)), spark.createDataFrame([("a",)], "q string")).count() == 0


def test_ten_thousand_queries_do_not_meet_every_definition(spark):
    defs = spark.range(20_000).select(F.col("id").alias("sym"), F.concat(F.lit("name_"), F.hex(F.xxhash64("id"))).alias("name"))
    queries = spark.range(10_000).select(F.lower(F.substring(F.hex(F.xxhash64("id")), 2, 9)).alias("q"))
    found = joins.search_many(defs, queries)
    assert found.select("q").distinct().count() == queries.distinct().count()
    assert found.filter("not contains(lower(name), q)").count() == 0


def test_points_meet_intervals_of_any_length_once(spark):
    rng = random.Random(8)
    spans = [("p", i, a, a + rng.choice([0, 1, 2, 7, 63, 64, 500, 10**6])) for i, a in enumerate(rng.randrange(3000) for _ in range(150))] + [("q", 900, 5, 5), ("p", 901, 9, 3)]
    points = [("p", i, rng.randrange(4000)) for i in range(200)] + [("q", 300, 5), ("q", 301, 6), ("r", 302, 5)]
    intervals = spark.createDataFrame(spans, "path string, nid int, start_line int, end_line int")
    got = [(r["pid"], r["nid"]) for r in joins.enclosing(spark.createDataFrame(points, "path string, pid int, line int"), intervals).collect()]
    want = {(i, n) for p, i, x in points for q, n, a, b in spans if p == q and a <= x <= b}
    assert set(got) == want and len(got) == len(want)
    assert joins.enclosing(spark.createDataFrame(points, "path string, pid int, line int"), intervals.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 10_000_000), (0, 9_999_999), (12_345, 10_012_344), (7, 7)], "s long, e long").select("s", "e", joins.aligned_blocks(F.col("s"), F.col("e")).alias("x")).collect()
    assert all(len(r["x"]) <= 48 and sum(1 << b["k"] for b in r["x"]) == r["e"] - r["s"] + 1 for r in long)


def sources(rng):
    """A random module of nested classes, functions, conditions and calls."""
    lines = []

    def block(depth, indent):
        for _ in range(rng.randrange(1, 4)):
            head = rng.choice(["class A:", "def g():", "if x:", "for y in z:", "try:", None, None, None]) if depth < 5 else None
            if head is None:
                lines.append(" " * indent + rng.choice(["f(1)", "f(g(f(2)))", "x = [g(y) for y in f(3)]", "assert f(x)", "pass"]))
                continue
            lines.append(" " * indent + head)
            block(depth + 1, indent + 1)
            if head == "try:":
                lines.append(" " * indent + "except E:")
                block(depth + 1, indent + 1)

    block(0, 0)
    return "\n".join(lines) + "\n"


def test_shapes_against_loops_over_parents(spark):
    rng = random.Random(4)
    files = [("r", f"m{k}.py", sources(rng)) for k in range(40)] + [("r", "empty.py", ""), ("r", "bad.py", "def ("), ("r2", "m0.py", "f(1)\n")]
    found = graph.checkpoint(facts.extract_facts(spark.createDataFrame(files, "repo string, path string, content string"), ("node", "call")))
    kinds = ("ClassDef", "FunctionDef", "If", "Try", "Call", "ExceptHandler", "Assert", "For")
    trees = {}
    for repo, path, text in files:
        if path != "bad.py":
            tree = ast.parse(text)
            trees[repo, path] = tree, {c: p for p in ast.walk(tree) for c in ast.iter_child_nodes(p)}

    def loop(shape):
        """Matching nodes of every file."""
        kind, conditions = shape
        out = {n for tree, _ in trees.values() for n in ast.walk(tree) if type(n).__name__ == kind}
        for axis, other in conditions:
            hits = loop(other)

            def near(n, up):
                around = []
                while n in up:
                    n = up[n]
                    around.append(n)
                return around

            ups = {n: near(n, up) for tree, up in trees.values() for n in ast.walk(tree)}
            plain = axis.removeprefix("not ")
            if plain in ("inside", "child of"):
                met = {n for n in out if hits & set(ups[n][: None if plain == "inside" else 1])}
            else:
                met = {a for h in hits for a in ups[h][: None if plain == "has" else 1]}
            out = out & met if plain == axis else out - met
        return out

    def shaped(shape):
        kind, conditions = shape
        return code.Shape(F.col("kind") == kind, tuple((axis, shaped(other)) for axis, other in conditions))

    def random_shape(depth):
        axes = [("not " if rng.random() < 0.4 else "") + rng.choice(code.AXES) for _ in range(rng.randrange(1, 3) if depth < 2 else 0)]
        return rng.choice(kinds), tuple((a, random_shape(depth + 1)) for a in axes)

    filled = 0
    for shape in [("Call", (("inside", ("ExceptHandler", (("inside", ("ClassDef", ())),))),)), *(random_shape(0) for _ in range(8))]:
        hits = loop(shape)
        want = sorted((repo, path, n.lineno - 1, n.col_offset) for (repo, path), (tree, _) in trees.items() for n in ast.walk(tree) if n in hits)
        assert sorted(map(tuple, code.structural_search(found, shaped(shape)).collect())) == want, shape
        filled += bool(want)
    assert filled >= 4
    for axis in ("near", "not"):
        with pytest.raises(ValueError):
            code.structural_search(found, code.Shape("assert", ((axis, "assert"),)))


def test_blocks_of_small_tables_are_not_broadcast(spark):
    """Files of a few MB may hold millions of intervals, each of many blocks."""
    points = spark.sql(f"SELECT 'a' AS path, id AS pid, IF(id = 1, 5, {1 << 39}) AS line FROM range(1, 3)")
    spans = spark.sql(f"SELECT 'a' AS path, id AS nid, CASE id WHEN 7 THEN 5 WHEN 8 THEN 0 ELSE 6 END AS start_line, CASE id WHEN 7 THEN 5 WHEN 8 THEN {1 << 39} ELSE 4 END AS end_line FROM range(7, 10)")
    met = joins.enclosing(points, spans)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pid"], r["nid"]) for r in met.collect()) == [(1, 7), (1, 8), (2, 8)]


def test_only_nodes_that_facts_come_from_are_told(monkeypatch):
    told = []
    tell = facts._Reader.tell
    monkeypatch.setattr(facts._Reader, "tell", lambda self, nid, node, *rest: (told.append(type(node).__name__), tell(self, nid, node, *rest))[1])
    text = "import os\ndef f(a: 'os.X', b=1):\n    if a:\n        return os.getpid() + g(a, 'x', b)\n"
    rows = {tags: facts.file_facts("r", "m.py", text, tags) for tags in (("def",), ("def", "use"), facts.TAGS)}
    assert rows["def",] == [r for r in rows[facts.TAGS] if r["tag"] == "def"]
    assert rows["def", "use"] == [r for r in rows[facts.TAGS] if r["tag"] in ("def", "use")]
    again = told.index("Module", 1)
    assert told[:again] == ["Module", "FunctionDef"]
    # the constant that tells something is the one in an annotation
    assert told[again : told.index("Module", again + 1)].count("Constant") == 1


def test_many_patterns_are_those_of_one_each_and_sort_nothing(spark):
    files = [("r", f"m{k}.py", sources(random.Random(k))) for k in range(10)]
    found = graph.checkpoint(facts.extract_facts(spark.createDataFrame(files, "repo string, path string, content string"), ("node", "call"), columns=code.SEARCHED))
    patterns = {"calls": "call:f", "asserts in loops": code.Shape("assert", (("inside", F.col("kind") == "For"),)), "lone": code.Shape(F.col("kind") == "If", (("not has", "call:g"),))}
    got = code.structural_searches(found, patterns)
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(name, *r) for name, p in patterns.items() for r in code.structural_search(found, p).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    with pytest.raises(ValueError):
        code.structural_searches(found, {})
