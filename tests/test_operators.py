"""Rules of single operators on small rows."""

import pytest
from pyspark.sql import functions as F

from codestrata.functions import scalars
from codestrata.operators import aggs, code, edits, filters, graph, merge
from codestrata.sources import corpus, facts
from codestrata.streaming import findings as live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_severity_must_be_known(spark):
    df = spark.createDataFrame([(" Error",)], "severity string")
    assert filters.by_severity(df, "ERROR").count() == 1
    with pytest.raises(ValueError):
        filters.by_severity(df, "fatal")


@pytest.mark.parametrize("limit, n, cut", [(None, 3, False), (5, 3, False), (3, 3, False), (2, 2, True), (1, 1, True)])
def test_limits(spark, limit, n, cut):
    got = filters.top(spark.range(3), ["id"], limit).collect()
    assert len(got) == n and all(r["truncated"] == cut for r in got)


@pytest.mark.parametrize("limit", [0, -1])
def test_bad_limits(spark, limit):
    with pytest.raises(ValueError):
        filters.top(spark.range(3), ["id"], limit)


def test_scalars(spark):
    assert one(spark, scalars.uri_path(F.lit("file:///a%20b+c"))) == "/a b+c"
    assert one(spark, scalars.uri_path(F.lit("http://x/a"))) is None
    assert one(spark, scalars.quoted_name(F.lit("name 'a' is"))) == "a"
    assert one(spark, scalars.quoted_name(F.lit("name 'a' is"), True)) is None
    assert one(spark, scalars.severity_name(F.lit(9))) == "information"
    assert one(spark, scalars.symbol_kind(F.lit(12))) == "function"
    assert one(spark, scalars.symbol_kind(F.lit(99))) == "symbol"
    assert one(spark, scalars.import_module(F.lit("from a.b import c"))) == "a.b"
    assert one(spark, scalars.half_up(F.lit(1), F.lit(8), 2)) == 0.13
    assert one(spark, scalars.is_identifier(F.lit("class"))) is False
    assert one(spark, scalars.name_column(F.lit("x = abc"), F.lit("abc"))) == 4


def test_edits(spark):
    files = spark.createDataFrame([("a", "one\ntwo\n"), ("b", "same")], "path string, content string")
    rows = [("a", 0, 0, 0, 3, "1", 0), ("a", 1, 0, 1, 0, "x", 1), ("a", 1, 0, 1, 0, "y", 2)]
    schema = "path string, start_line int, start_col int, end_line int, end_col int, new_text string, seq int"
    got = {r["path"]: r for r in edits.apply_edits(files, spark.createDataFrame(rows, schema), "path", "content").collect()}
    assert got["a"]["content"] == "1\nyxtwo\n" and got["b"]["content"] == "same"
    overlap = [("a", 0, 0, 0, 3, "1", 0), ("a", 0, 2, 1, 0, "x", 1)]
    bad = edits.apply_edits(files, spark.createDataFrame(overlap, schema), "path", "content").filter("rejected").collect()
    assert [r["content"] for r in bad] == ["one\ntwo\n"]


def test_offsets_round_trip(spark):
    files = spark.createDataFrame([("a", "ab\r\nc\n")], "path string, content string")
    places = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 7, 0)], "path string, line int, col int")
    got = {(r["line"], r["col"]): r["offset"] for r in edits.to_offset(places, files, "path", "content").collect()}
    assert got == {(0, 1): 1, (1, 0): 4, (2, 0): 6, (7, 0): None}
    back = edits.to_position(spark.createDataFrame([("a", 4)], "path string, offset int"), files, "path", "content").first()
    assert (back["line"], back["col"]) == (1, 0)


def test_names():
    with pytest.raises(ValueError):
        edits.check_name("class")
    assert edits.check_name("g_1") == "g_1"


def test_roots(spark):
    paths = spark.createDataFrame([("/a/b/c.py",), ("/a/bc/d.py",), ("/m/x/y.py",), ("/z.py",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    got = {r["path"]: r["root"] for r in merge.assign_root(paths, roots, spark.createDataFrame([("/m",)], "root string")).collect()}
    assert got == {"/a/b/c.py": "/a/b", "/a/bc/d.py": "/a", "/m/x/y.py": "/m", "/z.py": None}


def test_traverse_cap_and_depth(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(1, 9), (9, 0)], "src int, dst int")
    roots = spark.createDataFrame([(0,)], "root int")
    got = graph.traverse(e, roots, "callees", 2, 3).collect()
    assert [r["node"] for r in got] == [1, 2, 3] and all(r["truncated"] for r in got)
    near, far = ({r["node"] for r in graph.traverse(e, roots, "both", d).collect()} for d in (1, 2))
    assert near <= far
    with pytest.raises(ValueError):
        graph.traverse(e, roots, "up")


def test_source_tree_keeps_underscored_names(spark, tmp_path):
    for name in ("p/__init__.py", "p/_private.py", "p/m.py", ".venv/x.py", "p/__pycache__/y.py", "top.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    got = sorted(r["path"] for r in corpus.read_tree(spark, str(tmp_path)).collect())
    assert got == ["p/__init__.py", "p/_private.py", "p/m.py", "top.py"]


def test_facts_of_bad_and_wide_files(spark):
    bad = facts.file_facts("r", "a.py", "def (")
    assert [b["tag"] for b in bad] == ["failure"] and bad[0]["line"] == 0
    wide = [f for f in facts.file_facts("r", "b.py", "é = 'ü'; y = 1\n") if f["tag"] == "use" and f["name"] == "y"]
    assert wide[0]["col"] == 9
    assert facts.file_facts("r", "c.py", None)[0]["tag"] == "failure"


def test_stream_equals_table(spark, tmp_path):
    schema = "path string, version long, payload string"
    one = '[{"line":1,"severity":"error","message":"m%d"}]'
    rows = [("a", 2, one % 2), ("a", 1, one % 1), ("b", 1, one % 1), ("b", 2, "[]"), ("c", 1, "broken")]
    table = spark.createDataFrame(rows, schema)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.latest_findings(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(str, live.latest_findings(table).collect()))
    assert sorted(map(str, spark.table("latest").collect())) == want and len(want) == 2


def test_stream_facts_skips_known_versions(spark, tmp_path):
    schema = "repo string, path string, content string"
    spark.createDataFrame([("r", "a.py", "x = 1\n"), ("r", "a.py", "x = 1\n"), ("r", "b.py", "def f(): pass\n")], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.stream_facts(stream, str(tmp_path / "out"), str(tmp_path / f"c{_}"), facts.extract_facts).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/facts")).filter("tag = 'def'")
    assert sorted(r["name"] for r in got.collect()) == ["f", "x"]


SOURCE = '''import os.path
import pkg.tools as tools
from . import near
from .near import helper as aid, other
from subprocess import run

limit = 3


def outer(a, *rest, size=limit):
    total = 0

    class Inner(Base):
        total = 5

        @property
        def value(self):
            return total + limit + a

    def nested():
        return rest, total, missing

    try:
        tools.make(a)
        near.helper(os.path.join(a))
    except KeyError as error:
        raise ValueError(error)
    except (OSError, IOError):
        pass
    return [x for x in nested()], aid, lambda q: q + size


async def again(b: int) -> "Inner":
    async with b as c:
        yield c
    other(outer(b))
'''
TOOLS = "def make(x):\n    return eval(x)\n\n\nclass Base:\n    pass\n"
NEAR = "def helper(x):\n    return x\n\n\ndef other(y):\n    global state\n    state = y\n"


@pytest.fixture(scope="module")
def code_facts(spark):
    files = spark.createDataFrame([("r", "pkg/main.py", SOURCE), ("r", "pkg/tools.py", TOOLS), ("r", "pkg/near.py", NEAR)], "repo string, path string, content string")
    return facts.extract_facts(files).cache()


def at(text, path="pkg/main.py", nth=0):
    """Line and column of a piece of source, by its place among equal ones."""
    source = {"pkg/main.py": SOURCE, "pkg/tools.py": TOOLS, "pkg/near.py": NEAR}[path]
    k = -1
    for _ in range(nth + 1):
        k = source.index(text, k + 1)
    return source.count("\n", 0, k), k - source.rfind("\n", 0, k) - 1


def test_names_lead_to_the_nearest_scope(code_facts):
    got = {(r["path"], r["line"], r["col"]): (r["def_path"], r["def_line"], r["def_col"]) for r in code.goto_definition(code_facts).collect()}

    def leads(use, to, shift=0, to_shift=0, to_path="pkg/main.py", nth=0, to_nth=0):
        line, col = at(use, nth=nth)
        to_line, to_col = at(to, to_path, to_nth)
        assert got[("pkg/main.py", line, col + shift)] == (to_path, to_line, to_col + to_shift), use

    leads("size=limit", "limit = 3", 5)
    leads("total + limit", "total = 0")  # not the class's own total
    leads("total + limit", "limit = 3", 8)
    leads("+ a\n", "outer(a", 2, 6)
    leads("return rest", "*rest", 7, 1)
    leads("rest, total", "total = 0", 6)
    leads("tools.make", "make(x)", 6, 0, "pkg/tools.py")
    leads("near.helper(", "helper(x)", 5, 0, "pkg/near.py")
    leads("aid, lambda", "helper(x)", 0, 0, "pkg/near.py")
    leads("other(outer", "other(y)", 0, 0, "pkg/near.py")
    leads("outer(b)", "outer(a")
    leads("(error)", "except KeyError as error", 1)
    leads("q + size", "lambda q", 0, 7)
    leads("q + size", "size=limit", 4)
    names = {r["name"] for r in code.unresolved_names(code_facts).collect()}
    assert names == {"missing", "Base"}  # Base is defined in a module that is not imported from


def test_references_with_declaration_total_and_limit(code_facts):
    one = lambda **options: sorted((r["path"], r["line"], r["col"], r["total"], r["truncated"]) for r in code.find_references(code_facts, **options).filter("def_path = 'pkg/near.py' and name in ('helper', 'aid')").collect())
    uses = [("pkg/main.py", *at("helper as aid")), ("pkg/main.py", at("near.helper(")[0], at("near.helper(")[1] + 5), ("pkg/main.py", *at("aid, lambda"))]
    assert one() == sorted((*u, 3, False) for u in uses)
    assert one(include_declaration=True) == sorted((*u, 4, False) for u in [*uses, ("pkg/near.py", 0, 4)])
    assert one(limit=2) == [(*u, 3, True) for u in sorted(uses)[:2]]
    with pytest.raises(ValueError):
        code.find_references(code_facts, limit=0)


@pytest.mark.parametrize("pattern, places", [
    ("call:eval", [("pkg/tools.py", "eval(x)", 0)]), ("attr_call:anything.helper", [("pkg/main.py", "near.helper(", 0)]), ("STAR_IMPORT", []),
    ("except:KeyError", [("pkg/main.py", "except KeyError", 0)]), ("except", [("pkg/main.py", "except KeyError", 0), ("pkg/main.py", "except (OSError", 0)]), ("except:OSError", []),
    ("decorator:property", [("pkg/main.py", "property", 0)]), ("assert", []), ("global", [("pkg/near.py", "global", 0)]), ("Raise", [("pkg/main.py", "raise", 0)]), ("yield", [("pkg/main.py", "yield", 0)]),
])
def test_structural_shorthands(code_facts, pattern, places):
    got = [(r["path"], r["line"], r["col"]) for r in code.structural_search(code_facts, pattern).collect()]
    assert got == [(p, *at(text, p, n)) for p, text, n in places]


def test_unknown_patterns_and_kinds(code_facts):
    for bad in ("nonsense", "call:", "attr_call:x", "assert:x"):
        with pytest.raises(ValueError):
            code.structural_search(code_facts, bad)
    with pytest.raises(ValueError):
        code.type_users(code_facts, ["made_up"])
    assert code.structural_search(code_facts, F.col("kind") == "Lambda").count() == 1


def test_rename_reaches_every_use_and_nothing_else(spark, code_facts):
    files = spark.createDataFrame([("pkg/main.py", SOURCE), ("pkg/tools.py", TOOLS), ("pkg/near.py", NEAR)], "path string, content string")
    renames = spark.createDataFrame([("r", "pkg.near", "helper", "aide"), ("r", "pkg.main", "limit", "bound"), ("r", "pkg.main", "outer", "whole"), ("r", "pkg.main", "again", "later")], "repo string, module string, old string, new string")
    found = code.rename_edits(code_facts, renames).withColumn("seq", F.lit(0))
    got = {r["path"]: r["content"] for r in edits.apply_edits(files, found, "path", "content").collect()}
    want = SOURCE.replace("limit", "bound").replace("outer", "whole").replace("import helper as aid", "import aide as aid").replace("near.helper", "near.aide").replace("def again", "def later")
    assert got["pkg/main.py"] == want and got["pkg/near.py"] == NEAR.replace("helper", "aide") and got["pkg/tools.py"] == TOOLS
    with pytest.raises(Exception, match="usable"):
        code.rename_edits(code_facts, spark.createDataFrame([("r", "pkg.near", "helper", "class")], renames.schema)).collect()


def test_security_rules(spark):
    calls = ["eval(a)", "x.eval(a)", "os.system(a)", "os.popen(a)", "pickle.load(a)", "p.pickle.load(a)", "yaml.load(a)", "marshal.loads(a)", "subprocess.check_output(a, shell=True)", "subprocess.run(a, shell=1)", "subprocess.Popen(a, shell=False)", "__import__(a)", "compile(a)"]
    files = spark.createDataFrame([("r", "a.py", "\n".join(f"  {c}".strip() for c in calls))], "repo string, path string, content string")
    got = {r["line"]: (r["rule_id"], r["severity"], r["snippet"]) for r in code.call_rules(facts.extract_facts(files, ("call",))).collect()}
    ids = {0: "SEC001", 2: "SEC010", 3: "SEC011", 4: "SEC021", 6: "SEC022", 7: "SEC023", 8: "SEC030", 11: "SEC004", 12: "SEC003"}
    assert {k: v[0] for k, v in got.items()} == ids and all(v[2] == calls[k] for k, v in got.items()) and got[12][1] == "medium"


def test_folds(spark):
    text = "import a\nfrom b import (\n    c,\n)\nx = 1\nimport d\nif x:\n    import e\n    import f\nimport g\n\nimport h\n"
    files = spark.createDataFrame([("r", "a.py", text)], "repo string, path string, content string")
    got = sorted((r["fold"], r["first"], r["last"]) for r in code.folding_ranges(facts.extract_facts(files, ("node",))).collect())
    assert got == [("imports", 0, 3), ("imports", 9, 11), ("region", 6, 8)]


def test_conformance_and_protocols(spark):
    text = "class A:\n    def m(self, x) -> int: ...\n    def _p(self): ...\n    def __init__(self, k: str): ...\n    def own(cls): ...\nclass B:\n    def m(self, x, y): ...\n    def _p(self): ...\n    def __init__(self, k): ...\n"
    found = code.class_methods(facts.extract_facts(spark.createDataFrame([("r", "a.py", text)], "repo string, path string, content string"), ("def", "param")))
    got = {r["method"]: (r["common"], r["mismatched"], r["only_in"]) for r in aggs.interface_conformance(found, ["A", "B"]).collect()}
    assert got == {"m": (True, True, None), "_p": (True, False, None), "__init__": (True, False, None), "own": (False, False, "A")}
    assert aggs.protocol_text(found, ["A", "B"], "P").first()["text"] == "class P(Protocol):\n    def __init__(self, k): ...\n    def m(self, x) -> int: ...\n"
    assert aggs.protocol_text(found, ["A", "C"]).first()["text"] == "class GeneratedProtocol(Protocol):\n    pass\n"


def test_layers_by_whole_components(spark):
    v = spark.createDataFrame([("src/ui/a.py",), ("app.db.x",), ("app.dbx",), ("app.ui.db",)], "v string")
    assert {r["v"]: r["layer"] for r in graph.assign_layers(v, [["ui", "web"], ["db"]]).collect()} == {"src/ui/a.py": 0, "app.db.x": 1, "app.ui.db": 0}


def test_components_of_cycles_and_tails(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (8, 1), (9, 9)] + [(i, i + 1) for i in range(100, 160)] + [(160, 100)]
    got = {r["node"]: r["component"] for r in graph.sccs(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, **dict.fromkeys(range(100, 161), 100)}


def test_snapshots_with_null_content(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "x")], "k int, t string")
    new = spark.createDataFrame([(1, None), (2, None), (3, "b"), (5, None)], "k int, t string")
    got = {r["k"]: r["status"] for r in merge.snapshot_diff(old, new, "k", "t").collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "changed", 4: "removed", 5: "added"}
    lines = {(r["text"], r["d"]) for r in merge.line_changes(spark.createDataFrame([(1, "a\na\nb")], "k int, t string"), spark.createDataFrame([(1, "a\nc\nb\nc")], "k int, t string"), "k", "t").collect()}
    assert lines == {("a", -1), ("c", 2)}


def test_written_versions(spark, tmp_path):
    files = spark.createDataFrame([("a", "1")], "path string, content string")
    corpus.write_files(files, str(tmp_path / "w"), 1, apply=True)
    corpus.write_files(files.withColumn("content", F.lit("2")), str(tmp_path / "w"), 2, apply=True)
    (tmp_path / "w/v=00000003").mkdir()  # a writer that died
    assert corpus.read_files(spark, str(tmp_path / "w")).first()["content"] == "2" and corpus.read_files(spark, str(tmp_path / "w"), 1).first()["content"] == "1"
    with pytest.raises(FileNotFoundError):
        corpus.read_files(spark, str(tmp_path / "w"), 3)
    with pytest.raises(Exception, match="exists"):
        corpus.write_files(files, str(tmp_path / "w"), 2, apply=True)
    assert corpus.write_files(files, str(tmp_path / "none"), 1).count() == 1 and not (tmp_path / "none").exists()


def test_edits_take_time_in_proportion(spark):
    n = 20_000
    text = "\r\n".join(f"line {i} é" for i in range(n))
    files = spark.createDataFrame([("a", text), ("b", None), ("c", "x")], "path string, content string")
    rows = spark.range(n).selectExpr("'a' path", "cast(id as int) start_line", "0 start_col", "cast(id as int) end_line", "4 end_col", "'LINE' new_text", "cast(id as int) seq")
    got = {r["path"]: (r["content"], r["rejected"]) for r in edits.apply_edits(files, rows, "path", "content").collect()}
    assert got == {"a": (text.replace("line", "LINE"), False), "b": (None, False), "c": ("x", False)}
    back = edits.to_position(edits.to_offset(rows.selectExpr("path", "start_line line", "3 col"), files, "path", "content").select("path", "offset"), files, "path", "content").agg(F.count_distinct("line"), F.max("col")).first()
    assert tuple(back) == (n, 3)


def test_more_scalars(spark):
    assert one(spark, scalars.symbol_kind(F.lit(22))) == "enumMember" and one(spark, scalars.symbol_kind(F.lit(26))) == "typeParameter"
    assert one(spark, scalars.import_modules(F.lit("import os, a.b as c"))) == ["os", "a.b"] and one(spark, scalars.import_modules(F.lit("x"))) == []
    assert one(spark, scalars.is_identifier(F.lit("größe"))) and not one(spark, scalars.is_identifier(F.lit("1x")))
    assert [one(spark, scalars.unknown_type(F.lit(t))) for t in ("list[ unknown]", " Any", "int")] == [True, True, False]
    assert [one(spark, scalars.dead_confidence(F.lit(n), F.lit("no references"))) for n in ("Log", "test_x", "__x__", "x")] == ["low", "low", "low", "medium"]
    assert one(spark, scalars.dead_confidence(F.lit("log"), F.lit("unused diagnostic"))) == "high" and one(spark, scalars.severity_code(F.lit(" Hint"))) == 4


def test_deep_trees_are_divided(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "SLICES", 5)
    names = [f"{a}/{b}/{c}.py" for a in "ab" for b in "xyz" for c in "mn"] + ["top.py", "a/mid.py", "a/x/.tox/no.py", "a/x/deep/more/z.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    reader = corpus._TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) >= 5 and sorted(p for part in parts for _, p, _ in reader.read(part)) == sorted(n for n in names if ".tox" not in n)


def test_merge_keeps_the_least_row_of_a_key_and_null_queries(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "q string, k int, note string")
    one, two = rows(("a", 1, "p"), (None, 1, "p")), rows(("a", 1, "s"), ("a", 2, "z"), ("a", 2, "y"), (None, 3, "s"), ("b", 1, None), ("b", 1, "s"))
    got = {tuple(r) for r in merge.merge_prioritized(one, two, ["q", "k"], "q").collect()}
    assert got == {("a", 1, "p", "combined"), ("a", 2, "y", "combined"), (None, 1, "p", "combined"), (None, 3, "s", "combined"), ("b", 1, None, "secondary")}
    keys = merge.merge_prioritized(one.drop("note"), two.drop("note").limit(0), ["q", "k"], "q")
    assert {tuple(r) for r in keys.collect()} == {("a", 1, "primary"), (None, 1, "primary")}


def test_coverage_with_and_without_lists(spark):
    defs, refs = spark.createDataFrame([(1,), (2,), (3,)], "sym int"), spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (3, None), (9, "a"), (None, "a")], "sym int, ref_file string")
    assert sorted(map(tuple, aggs.test_coverage(defs, refs).collect())) == [(1, 2, ["a", "b"], True), (2, 0, None, False), (3, 0, [], True)]
    assert sorted(map(tuple, aggs.test_coverage(defs, refs, listed=False).collect())) == [(1, 2, True), (2, 0, False), (3, 0, True)]
    assert sorted(map(tuple, aggs.covering_files(defs, refs).collect())) == [(1, "a"), (1, "b")]
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "i int, t string")
    assert sorted(map(tuple, aggs.duplicates(texts, "t", "i").select("n", "first", "item").collect())) == [(2, 1, 1), (2, 1, 2)]
