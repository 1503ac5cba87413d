"""Scopes, re-exports, stars and renames on small corpora."""

import ast

import pytest
from pyspark.sql import functions as F

from codestrata.operators import code, edits, graph
from codestrata.sources import facts

TAGS = ("def", "param", "use", "import", "attr", "export")
RENAME = "repo string, module string, old string, new string"


def extracted(spark, files, tags=TAGS, repo="r"):
    return facts.extract_facts(spark.createDataFrame([(repo, p, t) for p, t in files.items()], "repo string, path string, content string"), tags).cache()


def defined(spark, files):
    """(path, name, line) -> (def_path, def_line) of every read with a definition."""
    return {(r["path"], r["name"], r["line"], r["col"]): (r["def_path"], r["def_line"]) for r in code.goto_definition(extracted(spark, files)).collect()}


def renamed(spark, files, *asked):
    found = code.rename_edits(extracted(spark, files), spark.createDataFrame([("r", *a) for a in asked], RENAME)).withColumn("seq", F.lit(0))
    texts = spark.createDataFrame(list(files.items()), "path string, content string")
    got = edits.apply_edits(texts, found, "path", "content").collect()
    assert not any(r["rejected"] for r in got)
    return {r["path"]: r["content"] for r in got}


CHAIN = {
    "m.py": "def f():\n    return 1\n",
    "n.py": "from m import f\n",
    "o.py": "from n import f\nf()\n",
    "p.py": "from m import *\nf()\n",
    "q.py": "import n\nn.f()\n",
    "u.py": "try:\n    import fast as f\nexcept ImportError:\n    from m import f\nprint(f())\n",
    "v.py": "def go():\n    from o import f\n    return f\n",
    "w.py": "from n import f as h\nh()\n",
    "x.py": "from p import *\ng = f\n",
}


def test_reads_lead_through_reexports_and_stars(spark):
    got = defined(spark, CHAIN)
    for at in (("o.py", "f", 1, 0), ("p.py", "f", 1, 0), ("q.py", "f", 1, 2), ("v.py", "f", 2, 11), ("w.py", "h", 1, 0), ("x.py", "f", 1, 4)):
        assert got[at] == ("m.py", 0), at
    assert got["u.py", "f", 4, 6] == ("u.py", 1)
    rows = {(r["path"], r["line"]) for r in code.find_references(extracted(spark, CHAIN)).filter("def_path = 'm.py'").collect()}
    assert rows == {("n.py", 0), ("o.py", 0), ("o.py", 1), ("p.py", 1), ("q.py", 1), ("u.py", 3), ("v.py", 1), ("v.py", 2), ("w.py", 0), ("w.py", 1), ("x.py", 1)}


def test_rename_follows_reexports_and_stars_and_stops_where_names_are_shared(spark):
    got = renamed(spark, CHAIN, ("m", "f", "ff"))
    assert got["m.py"] == "def ff():\n    return 1\n" and got["n.py"] == "from m import ff\n" and got["o.py"] == "from n import ff\nff()\n"
    assert got["p.py"] == "from m import *\nff()\n" and got["q.py"] == "import n\nn.ff()\n" and got["x.py"] == "from p import *\ng = ff\n"
    assert got["u.py"] == CHAIN["u.py"].replace("from m import f", "from m import ff as f")
    assert got["v.py"] == "def go():\n    from o import ff\n    return ff\n" and got["w.py"] == "from n import ff as h\nh()\n"
    # every name leads to the same place as before
    was, now = defined(spark, CHAIN), defined(spark, got)
    assert sorted((p, line, d) for (p, _, line, _), d in was.items()) == sorted((p, line, d) for (p, _, line, _), d in now.items())


def test_renames_keep_export_lists_and_taken_names(spark):
    files = {
        "m.py": "__all__ = ['f', \"k\"]\ndef f(): pass\nk = 1\n", "a.py": "from m import f\nff = 2\nf()\n", "b.py": "from a import f\nf()\n", "c.py": "from m import *\nprint(f, k)\n",
        "d.py": "__all__ = ['f']\nfrom m import f\n", "e.py": "from d import *\nf()\n", "g.py": "from m import (f,\n  k as f2)\nclass A:\n  x = f\n  def f(self): return f\n",
    }
    got = renamed(spark, files, ("m", "f", "ff"))
    assert got["m.py"] == "__all__ = ['ff', \"k\"]\ndef ff(): pass\nk = 1\n" and got["a.py"] == "from m import ff as f\nff = 2\nf()\n" and got["b.py"] == files["b.py"]
    assert got["c.py"] == "from m import *\nprint(ff, k)\n" and got["d.py"] == "__all__ = ['ff']\nfrom m import ff\n" and got["e.py"] == "from d import *\nff()\n"
    assert got["g.py"] == "from m import (ff,\n  k as f2)\nclass A:\n  x = ff\n  def f(self): return ff\n" or got["g.py"].startswith("from m import (ff,")
    with pytest.raises(Exception, match="taken"):
        renamed(spark, files, ("m", "f", "k"))
    with pytest.raises(Exception, match="usable"):
        renamed(spark, files, ("m", "f", "class"))


def test_rings_and_long_chains_of_imports(spark):
    files = {f"c{i}.py": f"from c{i + 1} import f\n" for i in range(60)} | {"c60.py": "f = 1\n", "end.py": "from c0 import f\nf\n"}
    files |= {"r1.py": "from r2 import z\nz\n", "r2.py": "from r1 import z\nz\n", "s1.py": "from s2 import *\na = 1\nb\n", "s2.py": "from s1 import *\nb = 2\na\n"}
    got = defined(spark, files)
    assert got["end.py", "f", 1, 0] == ("c60.py", 0)
    assert got["r1.py", "z", 1, 0] == ("r1.py", 0) and got["r2.py", "z", 1, 0] == ("r2.py", 0)
    assert got["s1.py", "b", 2, 0] == ("s2.py", 1) and got["s2.py", "a", 2, 0] == ("s1.py", 1)


def test_packages_submodules_and_roots(spark):
    files = {
        "pkg/__init__.py": "from . import sub\nfrom .sub import go as run\n", "pkg/sub.py": "def go(): pass\n", "t.py": "import pkg.sub\nfrom pkg import sub as s, run\nimport pkg\npkg.sub.go()\ns.go()\nrun()\npkg.run()\n",
        "a.py": "here = 1\n", "src/a.py": "there = 2\n", "lib/b/__init__.py": "x = 1\n", "lib/b.py": "x = 2\n", "y.py": "from a import here, there\nfrom b import x\nhere\nthere\nx\n",
    }
    got = defined(spark, files)
    assert got["t.py", "go", 3, 8] == got["t.py", "go", 4, 2] == got["t.py", "run", 5, 0] == got["t.py", "run", 6, 4] == ("pkg/sub.py", 0)
    assert got["y.py", "here", 2, 0] == ("a.py", 0) and got["y.py", "there", 3, 0] == ("y.py", 0) and got["y.py", "x", 4, 0] == ("lib/b/__init__.py", 0)


SCOPES = """\
x = 0
def g(y):
    z = [x for x in y]
    return x
match z:
    case [a, *b]:
        print(a, b)
    case {"k": c, **rest} as whole:
        print(c, rest, whole)
def k[T](t: T, u=T) -> T:
    return T
class G[U](list[U]):
    def m(self) -> U: return [U for q in self]
def setter():
    global made
    made = 1
def outer():
    n = 0
    def step():
        nonlocal n
        n += 1
    return any((last := i) for i in g), last, n
print(made)
try: pass
except OSError as err: print(err)
class C:
    p = [1]
    q = [p for _ in p]
type Pair[V] = tuple[V, missing]
"""


def test_scopes_of_every_kind(spark):
    files = {"s.py": SCOPES}
    got = {(r["name"], r["line"]): r["def_line"] for r in code.goto_definition(extracted(spark, files)).orderBy("col").collect()}
    assert got["x", 3] == 0 and got["a", 6] == 5 and got["b", 6] == 5 and got["c", 8] == got["rest", 8] == got["whole", 8] == 7
    assert got["T", 10] == 9 and got["U", 12] == 11 and got["U", 11] == 11 and got["made", 22] == 15 and got["last", 21] == 21 and got["n", 21] == 17
    assert got["err", 24] == 24 and got["V", 28] == 28
    lost = [(r["name"], r["line"]) for r in code.unresolved_names(extracted(spark, files)).orderBy("line").collect()]
    assert lost == [("T", 9), ("z", 4), ("p", 27), ("missing", 28)] or sorted(lost) == sorted([("z", 4), ("T", 9), ("p", 27), ("missing", 28)])
    compile(SCOPES, "s", "exec")


def test_a_star_of_a_foreign_module_may_bring_any_name(spark):
    lost = code.unresolved_names(extracted(spark, {"a.py": "from far import *\nx\n", "b.py": "x\n"})).collect()
    assert [(r["path"], r["name"]) for r in lost] == [("b.py", "x")]


def test_deep_and_long_files_beside_others(spark):
    deep = "f(" + "+".join(["1"] * 5000) + ")\n"
    files = {
        "deep.py": deep, "deeper.py": "x = " + "(" * 150 + "1" + ")" * 150 + "\n", "worse.py": "-" * 60_000 + "1\n", "attrs.py": "a" + ".b" * 1500 + "\n", "huge.py": "x = " + "9" * 5000 + "\n", "null.py": "a\0b\n",
        "line.py": "x = [" + ", ".join(f"é{i}" for i in range(100_000)) + "]\n", "good.py": "def f(a, b: 'int' = 1) -> list[ int ]:\n    return a.b . c(b, *a, k = b, **a)\n", "empty.py": "",
    }
    rows = extracted(spark, files, facts.TAGS)
    assert {r["path"] for r in facts.syntax_errors(rows).collect()} >= {"worse.py", "null.py"}
    good = facts.of(rows, "call").filter("path = 'good.py'").first()
    assert good["args"] == ["b", "*a", "k=b", "**a"] and good["text"] == "a.b"
    assert facts.of(rows, "def").filter("path = 'good.py'").first()["returns"] == "list[ int ]"
    last = facts.of(rows, "use").filter("path = 'line.py'").orderBy(F.desc("col")).first()
    assert last["name"] == "é99999" and SCOPES and files["line.py"][last["col"] :].startswith("é99999]")
    failed = {r["path"] for r in facts.of(rows, "failure").collect()}
    assert not failed & {p for p in files if rows.filter(F.col("path") == p).filter("tag = 'node'").count()}
    assert ast.parse(files["good.py"])


def test_shapes_of_bodies_ignore_names_only():
    told = lambda text: facts.shape(ast.parse(text).body)
    assert told("a = b + c(d)") == told("x = y + z(w)") and told("lambda a: a") == told("lambda b: c")
    assert len({told(t) for t in ("a = 1", "a = 2", "a = '1'", "a += 1", "a.b = 1", "a.c = 1", "del a", "a", "def f(): pass", "def g(): pass", "[a, b]", "[a], b")}) == 12


def test_names_in_annotations(spark):
    """Types inside others, in strings and behind modules; values, prose and strings that are no plain literals are none."""
    m = "class C:\n    class D: pass\nclass E(C): pass\n"
    n = (
        "import m\nfrom m import C as K, E\nfrom typing import Annotated, Literal\n"
        "def f(ä: 'm.C', b: Annotated[K, 'E'], c: Literal['E', 'no name'], *d: \"dict[K, list[E]]\", e: 'not a type', g: '' = '', **h: (K | None)) -> 'E':\n"
        "    z: 'K'; y: K = 'E'; x: r'E'; self.w: E; v: \"list['E']\"\n"
    )
    files = spark.createDataFrame([("r", "m.py", m), ("r", "n.py", n)], "repo string, path string, content string")
    found = graph.checkpoint(facts.extract_facts(files))
    got = sorted((r["name"], r["cls"], r["def_line"]) for r in code.type_definition(found).filter("path = 'n.py'").collect())
    assert got == [("b", "C", 0), ("d", "C", 0), ("d", "E", 2), ("h", "C", 0), ("y", "C", 0), ("z", "C", 0), ("ä", "C", 0)]
    lines = n.split("\n")
    for r in facts.of(found, "use").filter("path = 'n.py' and kind = 'read' and role = 'annotation'").collect():
        assert lines[r["name_line"]][r["name_col"] :].startswith(r["name"])
    assert {r["name"] for r in code.unresolved_names(found).collect()} == {"self"}
    renames = spark.createDataFrame([("r", "m", "C", "Cc")], "repo string, module string, old string, new string")
    edited = {r["path"]: r["content"] for r in edits.apply_edits(files, code.rename_edits(found, renames).withColumn("seq", F.lit(0)), "path", "content").collect()}
    assert edited == {"m.py": m.replace("class C", "class Cc").replace("(C)", "(Cc)"), "n.py": n.replace("m.C", "m.Cc").replace("import C ", "import Cc ")}


def test_copies_in_many_repos_and_narrow_facts(spark):
    """A file of one content in many repos is parsed once, and gives every repo its facts; reads know the scope that binds them."""
    text = "import os\nlimit = 1\nlimit = 2\ndef f(a):\n    def g():\n        return a + limit + len(os.sep)\n    return g\n"
    repos = [f"r{k:02}" for k in range(2 * facts.TOGETHER + 1)]
    rows = [(r, "m.py", text) for r in repos] + [("s", "m.py", "x = y\n"), (None, "m.py", text), ("bad", "m.py", "def (")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    columns = ("repo", "tag", "kind", "name", "near", "places")
    out = facts.extract_facts(files, ("def", "param", "use", "import", "failure"), columns=columns)
    assert tuple(out.columns) == tuple(c for c in (f.split()[0] for f in facts.FIELDS.split(",")) if c in columns)
    got = {}
    for r in out.collect():
        got.setdefault(r["repo"], []).append((r["tag"], r["kind"], r["name"], r["near"], r["places"]))
    one = sorted(got["r00"], key=str)
    assert all(sorted(got[r], key=str) == one for r in [*repos, None]) and len(got) == len(repos) + 3
    reads = {name: near for tag, kind, name, near, _ in one if tag == "use" and kind == "read"}
    assert reads["limit"] == reads["len"] == reads["os"] == 0 and reads["a"] > 0 and reads["g"] == reads["a"]
    assert [k for tag, kind, n, _, k in one if kind == "write" and k] == [2]
    assert got["s"] and [t[0] for t in got["bad"]] == ["failure"]
    with pytest.raises(ValueError):
        facts.extract_facts(files, ("def",), columns=("nothing",))


def test_calls_lead_to_functions_of_other_files(spark):
    """A call graph reads only what links files, and each call by name, module, star or scope leads where its name does."""
    text = {
        "p/m.py": "def f():\n    return f()\ndef g(f):\n    f()\n    h()\ndef h():\n    def inner(): f()\n    inner()\n",
        "p/all.py": "from p.m import *\nfrom p.m import f as ff\n",
        "app.py": "import p.m, os\nimport p.m as pm\nfrom p.all import *\ndef main():\n    p.m.f(); pm.g(1); ff(); h(); os.getpid(); eval('1'); main.x()\n    def g(): pass\n    g()\nf()\n",
        "own.py": "from p.m import f\nf = 1\ndef a():\n    b()\ndef b(): f()\n",
        "kept.py": "from p.m import f\ndef k():\n    global f\n    f()\n    def inner(h=f()):\n        f = h\n        f()\n",
        "empty.py": "",
    }
    files = spark.createDataFrame([("r", path, content) for path, content in text.items()], "repo string, path string, content string")
    found = {outer: graph.checkpoint(facts.extract_facts(files, code.CALLING, columns=code.CALLED, outer=outer)) for outer in (True, False)}
    got = {outer: sorted(tuple(r) for r in code.call_edges(f).select("src", "dst").collect()) for outer, f in found.items()}
    m = {("f", "f"), ("g", "h"), ("h", "inner"), ("inner", "f")}
    want = {*((f"p/m.py:{a}", f"p/m.py:{b}") for a, b in m), *(("app.py:main", f"p/m.py:{b}") for b in "fgh"), ("app.py:main", "app.py:g"), ("own.py:a", "own.py:b"), ("own.py:b", "p/m.py:f"), ("kept.py:k", "p/m.py:f"), ("kept.py:inner", "p/m.py:f")}
    assert got == {True: sorted(want), False: sorted(want)}
    given = {(r["path"], r["tag"], r["name"]) for r in found[True].collect()}
    assert not any(tag in ("param", "use", "attr") and path != "own.py" for path, tag, _ in given)
    assert ("empty.py", "file", None) in given and ("app.py", "called", "x") not in given
