"""Operators over the fact table (see sources.facts): searches, resolution, graphs and codemods."""

from __future__ import annotations

import builtins
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.scalars import is_identifier, is_test_file, is_test_ref
from codestrata.operators import graph, windows
from codestrata.operators.filters import check_limit
from codestrata.sources.facts import of

FILE = ["repo", "path"]


#: Shorthands without an argument and the node kinds that they find.
PLAIN = {"assert": "Assert", "global": "Global", "raise": "Raise", "yield": "Yield", "except": "ExceptHandler"}


class Shape(NamedTuple):
    """Nodes of a pattern that lie so to others: `where` has pairs of an axis and a pattern or Shape, all of which must hold."""

    pattern: str | Column
    where: tuple = ()


#: Where the other node is: around a node, right around it, within it, right within it. With "not " before, no such node is there.
AXES = ("inside", "child of", "has", "parent of")


def structural_search(facts: DataFrame, pattern: str | Column | Shape) -> DataFrame:
    """Nodes or calls that match a shorthand (in any case of letters), a predicate on nodes or a Shape, in order of place.

    call:f finds calls by a plain name, attr_call:x.f calls of any object's f, except:E handlers of the plain name E,
    decorator:d plain decorators; star_import, except, assert, global, raise and yield stand alone. Shapes nest:
    Shape("call:open", (("inside", Shape("except", (("inside", F.col("kind") == "ClassDef"),))),)) finds calls of open within
    handlers within classes.
    """
    where = [*FILE, "line", "col"]
    return _matched(facts, pattern).select(*where).orderBy(*where)


def structural_searches(facts: DataFrame, patterns: dict[str, str | Column | Shape]) -> DataFrame:
    """structural_search for several patterns by name: pattern (the name), repo, path, line, col, in no order, so nothing is sorted.

    The facts are read once: what some part of a pattern matches by itself is stored, and nothing else is looked at again."""
    if not patterns:
        raise ValueError("no patterns")
    kept = graph.checkpoint(facts.filter(reduce(lambda a, b: a | b, [x for p in patterns.values() for x in _parts(p)])))
    return reduce(DataFrame.unionByName, [_matched(kept, p).select(F.lit(name).alias("pattern"), *FILE, "line", "col") for name, p in patterns.items()])


#: Columns of facts that structural_search reads.
SEARCHED = ("tag", "repo", "path", "line", "col", "nid", "parent", "last", "kind", "name", "attr", "role")


def _matched(facts: DataFrame, pattern: str | Column | Shape) -> DataFrame:
    if isinstance(pattern, Shape):
        found = _matched(facts, pattern.pattern)
        for axis, other in pattern.where:
            found = _lying(found, axis, _matched(facts, other))
        return found
    return facts.filter(_said(pattern)).select(*FILE, "line", "col", "nid", "parent", "last")


def _parts(pattern: str | Column | Shape) -> list[Column]:
    """The conditions on single facts that a pattern is made of."""
    if isinstance(pattern, Shape):
        return [x for part in (pattern.pattern, *(other for _, other in pattern.where)) for x in _parts(part)]
    return [_said(pattern)]


def _said(pattern: str | Column) -> Column:
    """The condition on a single fact that a shorthand or a predicate on nodes stands for."""
    node, call = F.col("tag") == "node", F.col("tag") == "call"
    if isinstance(pattern, Column):
        return node & pattern
    head, _, arg = pattern.strip().partition(":")
    head = head.lower()
    named = bool(re.fullmatch(r"\w+\.\w+" if head == "attr_call" else r"\w+", arg))
    if head == "call" and named:
        return call & (F.col("name") == arg)
    if head == "attr_call" and named:
        return call & (F.col("attr") == arg.partition(".")[2])
    if head == "except" and named:
        return node & (F.col("kind") == "ExceptHandler") & (F.col("attr") == arg)
    if head == "decorator" and named:
        return node & (F.col("kind") == "Name") & (F.col("name") == arg) & (F.col("role") == "decorator")
    if head == "star_import" and not arg:
        return (F.col("tag") == "import") & (F.col("name") == "*")
    if head in PLAIN and not arg:
        return node & (F.col("kind") == PLAIN[head])
    raise ValueError(f"unknown pattern {pattern!r}")


def _lying(found: DataFrame, axis: str, other: DataFrame) -> DataFrame:
    """The found nodes that have one of the other nodes on an axis, or none of them.

    Nodes are either apart or one within the other. So a node is within one of the others just if some node before it ends
    at it or later, and has one within it just if the next one comes before its own end: a running maximum or minimum over a
    file's nodes in order, without a pair of nodes ever being made.
    """
    plain = axis.removeprefix("not ")
    if plain not in AXES:
        raise ValueError(f"unknown axis {axis!r}")
    if plain in ("child of", "parent of"):
        mine, theirs = ("parent", "nid") if plain == "child of" else ("nid", "parent")
        keys = other.select(*FILE, F.col(theirs).alias(mine)).distinct()
        return found.join(keys, [*FILE, mine], "left_semi" if plain == axis else "left_anti")
    both = found.withColumn("_other", F.lit(False)).unionByName(other.select(*found.columns).withColumn("_other", F.lit(True)))
    before = Window.partitionBy(*FILE).orderBy("nid" if plain == "inside" else F.desc("nid")).rangeBetween(Window.unboundedPreceding, -1)
    if plain == "inside":
        met = F.max(F.when(F.col("_other"), F.col("last"))).over(before) >= F.col("nid")
    else:
        met = F.min(F.when(F.col("_other"), F.col("nid"))).over(before) <= F.col("last")
    met = F.coalesce(met, F.lit(False))
    return both.withColumn("_met", met).filter(~F.col("_other") & (F.col("_met") == F.lit(plain == axis))).select(*found.columns)


def public_names(facts: DataFrame) -> DataFrame:
    """Top-level names of each file: its export list, else names without a leading underscore (annotated assignments left out)."""
    defs = of(facts, "def").filter("is_top and not (kind = 'variable' and annotated) and name <> '__all__'").select(*FILE, "module", "name", "kind").distinct()
    exports = of(facts, "export").select(*FILE, "name").distinct()
    listed = exports.select(*FILE).distinct()
    return defs.join(exports, [*FILE, "name"], "left_semi").unionByName(defs.join(listed, FILE, "left_anti").filter("not startswith(name, '_')"))


def absolutize(imports: DataFrame) -> DataFrame:
    """imports with target: the module that a relative import names, by level."""
    parts = F.split("module", r"\.")
    package = F.endswith("path", F.lit("__init__.py")).cast("int")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level") + package, F.lit(0))), ".")
    return imports.withColumn("target", F.when(F.col("level") > 0, F.concat_ws(".", F.nullif(up, F.lit("")), F.nullif("text", F.lit("")))).otherwise(F.col("text")))


def dependency_graph(facts: DataFrame) -> DataFrame:
    """repo, src (module), dst: the imported module's own name if a file has it, else as written; resolved says which. Facts needed: file, import."""
    imports = absolutize(of(facts, "import"))
    modules = vertices(facts).withColumnRenamed("v", "m")
    # `from p import m` may name a module
    wide = imports.withColumn("deep", F.when(F.col("kind") == "from", F.concat_ws(".", "target", "name")))
    wide = wide.join(modules.select("repo", F.col("m").alias("deep"), F.lit(True).alias("_d")), ["repo", "deep"], "left")
    wide = wide.join(modules.select("repo", F.col("m").alias("target"), F.lit(True).alias("_t")), ["repo", "target"], "left")
    return wide.select("repo", F.col("module").alias("src"), F.when(F.col("_d"), F.col("deep")).otherwise(F.col("target")).alias("dst"), (F.coalesce("_d", F.lit(False)) | F.coalesce("_t", F.lit(False))).alias("resolved"))


def dependency_files(facts: DataFrame) -> DataFrame:
    """repo, src, dst: files that import each other, each module by its home (module_homes), so that a module that is there
    in two roots is read from the first one. Facts needed: file, import."""
    imports, homes = absolutize(of(facts, "import")), module_homes(facts).withColumnRenamed("home", "dst")
    wide = imports.withColumn("deep", F.when(F.col("kind") == "from", F.concat_ws(".", "target", "name")))
    wide = wide.join(homes.select("repo", F.col("module").alias("deep"), F.col("dst").alias("sub")), ["repo", "deep"], "left")
    wide = wide.select("repo", "path", "sub", F.col("target").alias("module")).join(homes, ["repo", "module"], "left")
    return wide.select("repo", F.col("path").alias("src"), F.coalesce("sub", "dst").alias("dst")).filter("dst is not null").distinct()


def vertices(facts: DataFrame) -> DataFrame:
    """The modules of the corpus: repo, v."""
    return of(facts, "file").select("repo", F.col("module").alias("v")).distinct()


def unused_imports(facts: DataFrame) -> DataFrame:
    imports = of(facts, "import").filter("text <> '__future__' and coalesce(name, '') <> '*'")
    last = imports.groupBy(*FILE, F.col("asname").alias("name")).agg(F.max_by("text", "nid").alias("source"), F.max_by("line", "nid").alias("line"))
    used = of(facts, "use").filter("kind = 'read'").select(*FILE, "name").distinct()
    return last.join(used, [*FILE, "name"], "left_anti").join(of(facts, "export").select(*FILE, "name").distinct(), [*FILE, "name"], "left_anti")


def bindings(facts: DataFrame) -> DataFrame:
    """The first place where each scope binds a name: repo, path, module, scope, name, place (line, col, kind), what an import
    names (target, orig), and n, the number of its places.

    Definitions, parameters, assignments (also by for, with, except, match, := and type parameters) and imports bind; kinds:
    def, param, write, import.
    """
    own = [*FILE, "module", "scope", "name"]
    use, imported = F.col("tag") == "use", F.col("tag") == "import"
    place = F.struct(F.when(use, F.col("line")).otherwise(F.col("name_line")).alias("line"), F.when(use, F.col("col")).otherwise(F.col("name_col")).alias("col"), F.when(use, "write").otherwise(F.col("tag")).alias("kind"))
    name, orig = F.when(imported, F.col("asname")).otherwise(F.col("name")), F.when(imported, F.coalesce("name", F.lit("")))
    firsts = absolutize(facts.filter("places > 0")).select(*FILE, "module", "scope", name.alias("name"), place.alias("place"), F.when(imported, F.col("target")).alias("target"), orig.alias("orig"), "places")
    # a file has one such row a name and scope; only a file that is there twice has more
    best = firsts.repartition(*own).groupBy(*own).agg(F.min(F.struct("place", "target", "orig")).alias("b"), F.max("places").cast("long").alias("n"))
    return best.select(*own, "b.place", "b.target", "b.orig", "n")


def module_homes(facts: DataFrame) -> DataFrame:
    """repo, module, home: the file that an import of each module reads. Roots go in order (the repository, src, lib), and in
    each a package before a module."""
    files = facts.filter("tag <> 'failure'").select("repo", "module", "path").distinct()
    rank = F.when(F.startswith("path", F.lit("src/")), 1).when(F.startswith("path", F.lit("lib/")), 2).otherwise(0)
    return files.groupBy("repo", "module").agg(F.min(F.struct(rank.alias("root"), (~F.endswith("path", F.lit("__init__.py"))).alias("plain"), "path"))["path"].alias("home"))


class Names(NamedTuple):
    """Names of a corpus: bindings (with a row of kind star for each name that a star brings, which the file does not bind itself),
    each with the place in another file that it leads to (far: path, line, col, kind) or the module's file that it means (of);
    homes; imports: every name imported by from or import, with the place it leads to at once (to_path, to_name; to_name is
    empty for a module) and in the end (end_path, end_name; far); tops: where names at the top of files are (far)."""

    bound: DataFrame
    homes: DataFrame
    imports: DataFrame
    tops: DataFrame


def names(facts: DataFrame) -> Names:
    """Resolves imports through re-exports and stars, of any length: stars are expanded until no file gets a new name, links
    from name to name are followed by doubled steps, and links that run in a ring lead nowhere.

    Of several stars that bring one name the last decides, and a name that the file binds itself goes before. A star brings
    what the module's export list names, or else its names without a leading underscore, those from its own stars among them.
    Facts needed: def, param, use, import; and export for stars and renames.
    """
    bound, homes = graph.checkpoint(bindings(facts)), graph.checkpoint(module_homes(facts))
    stars = _star_names(facts, bound.filter("scope = 0"), homes)
    if stars is not None:
        bound = graph.checkpoint(bound.unionByName(stars))
    top = bound.filter("scope = 0").select("repo", F.col("path").alias("to_path"), F.col("name").alias("to_name"))
    imports = absolutize(of(facts, "import")).filter("coalesce(name, '') <> '*'").select(*FILE, "scope", F.col("asname").alias("name"), F.coalesce("name", F.lit("")).alias("orig"), "role", "target", F.col("name_line").alias("line"), F.col("name_col").alias("col"))
    if stars is not None:
        imports = imports.unionByName(stars.select(*FILE, "scope", "name", "orig", F.lit("star").alias("role"), "target", "place.line", "place.col"))
    # import a.b binds a, import a.b as x binds x to a.b
    first = F.when((F.col("orig") == "") & (F.col("role") == ""), F.split("target", r"\.")[0]).otherwise(F.col("target"))
    met = imports.withColumn("m", first).join(homes.select("repo", F.col("module").alias("m"), F.col("home").alias("to_path")), ["repo", "m"], "left")
    # what can meet nothing (real is false) goes by its path, so that it does not gather under one key
    met = met.withColumns({"to_name": F.col("orig"), "real": F.col("to_path").isNotNull() & (F.col("orig") != "")}).withColumn("at", F.when(F.col("real"), F.col("to_path")).otherwise(F.col("path")))
    met = met.join(top.select("repo", F.lit(True).alias("real"), F.col("to_path").alias("at"), "to_name", F.lit(True).alias("there")), ["repo", "real", "at", "to_name"], "left")
    deep = homes.select("repo", F.lit(True).alias("real"), F.col("module").alias("deep"), F.col("home").alias("sub"))
    met = met.withColumn("real", F.col("orig") != "").withColumn("deep", F.when(F.col("real"), F.concat_ws(".", "target", "orig")).otherwise(F.col("path"))).join(deep, ["repo", "real", "deep"], "left")
    # from p import m: a name of p, or else the module p.m; a package that imports m from itself means the module
    name_of = F.col("there") & ~(F.col("sub").isNotNull() & (F.col("to_path") == F.col("path")))
    to = F.when(F.col("orig") == "", F.struct("to_path", F.lit("").alias("to_name"))).when(name_of, F.struct("to_path", "to_name")).otherwise(F.struct(F.col("sub").alias("to_path"), F.lit("").alias("to_name")))
    met = graph.checkpoint(met.withColumn("to", to).select(*FILE, "scope", "name", "orig", "role", "target", "line", "col", "to.to_path", "to.to_name"))
    node = lambda path, name: F.struct("repo", F.col(path).alias("path"), F.col(name).alias("name"))
    firsts = bound.filter("scope = 0 and place.kind in ('import', 'star')").select(*FILE, "scope", "name", "place.line", "place.col")
    links = met.filter("to_path is not null").join(firsts, [*FILE, "scope", "name", "line", "col"], "left_semi").select(node("path", "name").alias("node"), node("to_path", "to_name").alias("to")).dropDuplicates(["node"])
    ends = graph.jumps(links)[0]
    ends = ends.select("node.repo", F.col("node.path").alias("to_path"), F.col("node.name").alias("to_name"), F.when(F.col("ring").isNull(), F.col("end")).alias("end"), F.lit(True).alias("on"))
    lost = met.filter("to_path is null")  # most are of modules outside the corpus
    met = met.filter("to_path is not null").join(ends, ["repo", "to_path", "to_name"], "left")
    end = [F.when(F.col("on"), F.col(f"end.{k}")).otherwise(F.col(f"to_{k}")).alias(f"end_{k}") for k in ("path", "name")]
    met = met.select(*FILE, "scope", "name", "orig", "role", "target", "line", "col", "to_path", "to_name", *end)
    tops = bound.filter("scope = 0 and place.kind <> 'star'").select("repo", F.col("path").alias("end_path"), F.col("name").alias("end_name"), F.struct(F.col("path"), "place.line", "place.col", "place.kind").alias("far"))
    met = met.join(tops, ["repo", "end_path", "end_name"], "left")
    imports = graph.checkpoint(met.unionByName(lost.withColumns({c: F.lit(None).cast(met.schema[c].dataType) for c in ("end_path", "end_name", "far")})))
    # what a binding leads to is told once, with the binding, so that a read meets it there
    leads = imports.groupBy(*FILE, "scope", "name", "line", "col").agg(F.min("far").alias("far"), F.min(F.when(F.col("end_name") == "", F.col("end_path"))).alias("of"))
    away = F.col("place.kind").isin("import", "star")
    told = bound.filter(away).withColumns({"line": F.col("place.line"), "col": F.col("place.col")}).join(leads, [*FILE, "scope", "name", "line", "col"], "left")
    here = bound.filter(~away).withColumns({c: F.lit(None).cast(leads.schema[c].dataType) for c in ("far", "of")})
    return Names(graph.checkpoint(told.select(*bound.columns, "far", "of").unionByName(here)), homes, imports, tops)


def _star_names(facts: DataFrame, top: DataFrame, homes: DataFrame) -> DataFrame | None:
    """Bindings of kind star: names that stars bring to files which don't bind them; None without stars."""
    stars = absolutize(of(facts, "import").filter("name = '*'")).join(homes.withColumnRenamed("module", "target"), ["repo", "target"])
    stars = graph.checkpoint(stars.filter("home <> path").select(*FILE, "module", "target", "home", F.col("name_line").alias("line"), F.col("name_col").alias("col")))
    if stars.isEmpty():
        return None
    rounds = graph.Rounds(facts.sparkSession)
    sources = stars.select("repo", F.col("home").alias("path")).distinct()
    have = rounds.put("have-0", top.select(*FILE, "name"))
    new, brought, k = have, [], 0
    while not new.isEmpty():
        k += 1
        given = new.join(sources, FILE, "left_semi").select("repo", F.col("path").alias("home"), "name")
        brought.append(rounds.put(f"brought-{k}", stars.join(_passed(facts, given), ["repo", "home"])))
        new = rounds.put("new", brought[-1].select(*FILE, "name").distinct().join(have, [*FILE, "name"], "left_anti"))
        have = rounds.put(f"have-{k % 2}", have.unionByName(new).distinct())
    every = reduce(lambda a, b: a.unionByName(b), brought).join(top, [*FILE, "name"], "left_anti")
    last = every.groupBy(*FILE, "module", "name").agg(F.max(F.struct("line", "col", "target")).alias("s"))
    place = F.struct("s.line", "s.col", F.lit("star").alias("kind")).alias("place")
    return last.select(*FILE, "module", F.lit(0).alias("scope"), "name", place, "s.target", F.col("name").alias("orig"), F.lit(1).cast("long").alias("n"))


def _passed(facts: DataFrame, given: DataFrame) -> DataFrame:
    """Of the names (repo, home, name) those that a star brings: listed ones, or without a list those with no leading underscore."""
    exports = of(facts, "export").select("repo", F.col("path").alias("home"), "name").distinct()
    listed = given.join(exports, ["repo", "home", "name"], "left_semi")
    return listed.unionByName(given.join(exports.select("repo", "home").distinct(), ["repo", "home"], "left_anti").filter("not startswith(name, '_')"))


USE = [*FILE, "name", "line", "col"]
#: Columns of facts that names are resolved by; call_edges needs the facts of CALLING, by the columns of CALLED.
NAMED = ("tag", "repo", "path", "module", "scope", "kind", "name", "asname", "level", "line", "col", "role", "text", "name_line", "name_col", "near", "places")
CALLING = ("file", "def", "param", "write", "import", "export", "called")
CALLED = (*NAMED, "caller")


def _members(met: DataFrame, known: Names, own: list[str]) -> DataFrame:
    """Of attributes read (own, repo, name, head, text), each with the import that binds its head (target, orig, of), those that are names at
    the top of a module: own, via_path (that module's file) and far."""
    # import p.m binds p and is read as p.m.f; import p.m as x and from p import m are read as x.f and m.f
    plain = (F.col("orig") == "") & (F.split("target", r"\.")[0] == F.col("head"))
    kept = list(dict.fromkeys(["repo", "name", *own]))
    modules = known.homes.select("repo", F.col("home").alias("of"), "module")
    renamed = met.filter(~plain).join(modules, ["repo", "of"]).select(*kept, F.concat("module", F.expr("substring(text, length(head) + 1)")).alias("owner"))
    owners = known.homes.select("repo", F.col("module").alias("owner"), F.col("home").alias("via_path"))
    met = met.filter(plain).select(*kept, F.col("text").alias("owner")).unionByName(renamed).join(owners, ["repo", "owner"])
    onward = known.imports.filter("scope = 0").groupBy("repo", F.col("path").alias("via_path"), "name").agg(F.min_by(F.struct("end_path", "end_name"), F.struct("line", "col")).alias("e"))
    met = met.join(onward, ["repo", "via_path", "name"], "left").select(*kept, "via_path", F.coalesce("e.end_path", "via_path").alias("end_path"), F.coalesce("e.end_name", "name").alias("end_name"))
    return met.join(known.tops, ["repo", "end_path", "end_name"]).select(*own, "via_path", "far")


def _resolved(facts: DataFrame, known: Names) -> DataFrame:
    """resolve_names' rows with the binding through which each is read: via_path, via_scope, via_name."""
    bound = known.bound.select(*FILE, "name", "scope", "place", "target", "orig", "far", "of")
    uses = of(facts, "use").filter("kind = 'read'").select(*USE, F.col("near").alias("scope"))
    local = uses.join(bound.select(*FILE, "name", "scope", "place", "far"), [*FILE, "name", "scope"], "left")
    to = {"def_path": F.when(F.col("place").isNotNull(), F.coalesce("far.path", "path")), "def_line": F.coalesce("far.line", "place.line"), "def_col": F.coalesce("far.col", "place.col"), "kind": F.when(F.col("far.kind").isNotNull() & (F.col("far.kind") != "import"), "def").when(F.col("place.kind") == "star", "import").otherwise(F.col("place.kind"))}
    local = local.select(*USE, *[c.alias(k) for k, c in to.items()], F.col("path").alias("via_path"), F.when(F.col("place").isNotNull(), F.col("scope")).alias("via_scope"), F.col("name").alias("via_name"))
    reads = of(facts, "attr").select(*FILE, "name", F.col("name_line").alias("line"), F.col("name_col").alias("col"), "text", F.split("text", r"\.")[0].alias("head"), F.col("near").alias("scope"))
    heads = bound.filter("place.kind in ('import', 'star')").select(*FILE, F.col("name").alias("head"), "scope", "target", "orig", "of")
    members = _members(reads.join(heads, [*FILE, "head", "scope"]), known, USE)
    kind = F.when(F.col("far.kind") == "import", "import").otherwise("def")
    members = members.select(*USE, F.col("far.path").alias("def_path"), F.col("far.line").alias("def_line"), F.col("far.col").alias("def_col"), kind.alias("kind"), "via_path", F.lit(0).alias("via_scope"), F.col("name").alias("via_name"))
    return local.unionByName(members)


def resolve_names(facts: DataFrame) -> DataFrame:
    """Every name read with its definition: repo, path, name, line, col, def_path, def_line, def_col, kind (def, param, write or
    import); the nearest scope that binds the name decides, and an import leads to the definition in the corpus that it
    comes from, through re-exports and stars (names). Names that no scope binds have nulls.

    Reads of attributes (m.f) are in it where m is an imported module of the corpus and f is a name at its top.
    Facts needed: def, param, use, import, attr, export.
    """
    return _resolved(facts, names(facts)).drop("via_path", "via_scope", "via_name")


#: Names that modules and classes have besides the builtins.
GIVEN = ("__file__", "__path__", "__class__", "__module__", "__qualname__", "__annotations__", "__dict__")


def unresolved_names(facts: DataFrame) -> DataFrame:
    """Names read that no scope around them binds and that are no builtins; none in files with a star of a module outside the
    corpus, which may bring any name."""
    # what a string in an annotation says may be defined nowhere
    facts = facts.filter("not (tag = 'use' and coalesce(text, '') = 'quoted')")
    known = names(facts)
    far = absolutize(of(facts, "import").filter("name = '*'")).join(known.homes.withColumnRenamed("module", "target"), ["repo", "target"], "left_anti")
    rows = _resolved(facts, known).filter(F.col("def_path").isNull() & ~F.col("name").isin(*dir(builtins), *GIVEN))
    return rows.join(far.select(*FILE).distinct(), FILE, "left_anti").select(*USE)


def goto_definition(facts: DataFrame) -> DataFrame:
    """resolve_names' rows that have a definition."""
    return resolve_names(facts).filter(F.col("def_path").isNotNull())


def find_references(facts: DataFrame, include_declaration: bool = False, limit: int | None = None) -> DataFrame:
    """Reads and imports of each definition by place: repo, def_path, def_line, def_col, path, name, line, col, total (of the definition),
    truncated. At most `limit` rows a definition, in order of place; the definition itself only if asked for. Imports and
    reads through re-exports and stars count.
    """
    check_limit(limit)
    known = names(facts)
    at = ["repo", "def_path", "def_line", "def_col"]
    rows = _resolved(facts, known).filter("def_path is not null and kind <> 'import'").select(*at, "path", "name", "line", "col")
    named = known.imports.filter("orig <> '' and role <> 'star' and far.kind <> 'import'")
    named = named.select("repo", F.col("far.path").alias("def_path"), F.col("far.line").alias("def_line"), F.col("far.col").alias("def_col"), "path", F.col("orig").alias("name"), "line", "col")
    rows = rows.unionByName(named)
    if include_declaration:
        rows = rows.unionByName(known.bound.filter("place.kind not in ('import', 'star')").select("repo", F.col("path").alias("def_path"), F.col("place.line").alias("def_line"), F.col("place.col").alias("def_col"), "path", "name", F.col("place.line").alias("line"), F.col("place.col").alias("col")))
    rows = rows.distinct()
    total = rows.groupBy(*at).agg(F.count("*").alias("total"))
    rows = rows.join(total, at)
    if limit is None:
        return rows.withColumn("truncated", F.lit(False))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy("path", "line", "col")))
    return ranked.filter(F.col("_n") <= limit).drop("_n").withColumn("truncated", F.col("total") > limit)


def reference_counts(facts: DataFrame) -> DataFrame:
    """Uses and files of each top-level definition that is used."""
    rows = find_references(facts)
    return rows.groupBy("repo", "def_path", "def_line", "name").agg(F.count("*").alias("uses"), F.count_distinct("path").alias("files"))


def highlights(facts: DataFrame, name: Column) -> DataFrame:
    """The places of a name in each file with kind read or write. name: a column of the name wanted."""
    return of(facts, "use").filter((F.col("name") == name) & F.col("name_col").isNotNull()).select(*USE, "kind")


def sub_definitions(facts: DataFrame) -> DataFrame:
    """Definitions directly inside each class or function."""
    defs = of(facts, "def")
    outer = defs.filter("kind <> 'variable'").select(*FILE, F.col("nid").alias("scope"), F.col("name").alias("owner"))
    return defs.join(outer, [*FILE, "scope"]).select(*FILE, "owner", "name", "kind")


def all_names(facts: DataFrame, all_scopes: bool = True, references: bool = False) -> DataFrame:
    defs = of(facts, "def").filter(F.lit(all_scopes) | F.col("is_top")).select(*FILE, "name", "line", "col", F.lit(True).alias("is_definition"))
    return defs.unionByName(of(facts, "use").select(*FILE, "name", "line", "col", F.lit(False).alias("is_definition"))) if references else defs


def _led(facts: DataFrame, imported: bool = True) -> DataFrame:
    """The place that each read (or imported) name leads to: repo, path, name_line, name_col, def_path, def_line, def_col."""
    known = names(facts)
    rows = _resolved(facts, known).filter("def_path is not null").select(*FILE, F.col("line").alias("name_line"), F.col("col").alias("name_col"), "def_path", "def_line", "def_col")
    named = known.imports.filter("orig <> '' and role <> 'star' and far is not null")
    named = named.select(*FILE, F.col("line").alias("name_line"), F.col("col").alias("name_col"), F.col("far.path").alias("def_path"), F.col("far.line").alias("def_line"), F.col("far.col").alias("def_col"))
    return (rows.unionByName(named) if imported else rows).dropDuplicates([*FILE, "name_line", "name_col"])


def _classes(facts: DataFrame) -> DataFrame:
    """Classes by the place of their name: repo, def_path, def_line, def_col, cls."""
    return of(facts, "def").filter("kind = 'class'").select("repo", F.col("path").alias("def_path"), F.col("name_line").alias("def_line"), F.col("name_col").alias("def_col"), F.col("name").alias("cls"))


AT = ["repo", "def_path", "def_line", "def_col"]


def class_edges(facts: DataFrame) -> DataFrame:
    """Class to base: repo, src, src_path, src_line, dst, dst_path, dst_line. A base is the class of the corpus that its name
    leads to, by scopes, imports and re-exports, so classes of one name in other modules or repos are others.
    Facts needed: def, param, use, import, attr, export, base."""
    bases = of(facts, "base").select(*FILE, F.col("name").alias("src"), F.col("line").alias("src_line"), "name_line", "name_col")
    met = bases.join(_led(facts), [*FILE, "name_line", "name_col"]).join(_classes(facts), AT)
    return met.select("repo", "src", F.col("path").alias("src_path"), "src_line", F.col("cls").alias("dst"), F.col("def_path").alias("dst_path"), F.col("def_line").alias("dst_line")).distinct()


def class_links(edges: DataFrame) -> DataFrame:
    """class_edges as src, dst for graph operators: each end a struct of repo, path, line and name."""
    end = lambda x: F.struct("repo", F.col(f"{x}_path").alias("path"), F.col(f"{x}_line").alias("line"), F.col(x).alias("name")).alias(x)
    return edges.select(end("src"), end("dst")).distinct()


def find_implementations(facts: DataFrame, index: graph.ReachIndex, method: str) -> DataFrame:
    """Subtypes that define method themselves: repo, base, base_path, cls, cls_path. index: graph.reach_index of class_links."""
    defs = of(facts, "def")
    outer = defs.filter("kind = 'class'").select(*FILE, F.col("nid").alias("scope"), "line", F.col("name").alias("owner"))
    own = defs.filter((F.col("name") == method) & (F.col("kind") == "function")).select(*FILE, "scope").join(outer, [*FILE, "scope"])
    own = own.select(F.struct("repo", "path", "line", F.col("owner").alias("name")).alias("node")).distinct()
    pairs = graph.reached(index, own, index.labels.select("node"))
    return pairs.select("src.repo", F.col("dst.name").alias("base"), F.col("dst.path").alias("base_path"), F.col("src.name").alias("cls"), F.col("src.path").alias("cls_path")).distinct()


def type_definition(facts: DataFrame) -> DataFrame:
    """The classes that the annotation of each parameter and annotated variable names, alone or within others (m.C, list[C],
    C | None, "C"): repo, path, name, line, col, cls, def_path, def_line. A class is the one that the name leads to, by scopes,
    imports and re-exports. Facts needed: def, param, use, import, attr, export, typed."""
    noted = of(facts, "typed").select(*FILE, "name", "line", "col", "name_line", "name_col")
    met = noted.join(_led(facts), [*FILE, "name_line", "name_col"]).join(_classes(facts), AT)
    return met.select(*FILE, "name", "line", "col", "cls", "def_path", "def_line").distinct()


#: Kinds of references to a class.
TYPE_KINDS = ("annotation", "subclass", "instantiation", "other")


def type_users(facts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """References to each class of the corpus by place: repo, name, def_path, path, line, col, kind (annotation, subclass,
    instantiation, other, in that precedence; imports are other), of the kinds asked for. A reference is a name that leads to
    the class by scopes, imports and re-exports. Facts needed: def, param, use, import, attr, export."""
    if kinds is not None and (unknown := set(kinds) - set(TYPE_KINDS)):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    kind = F.when(F.col("role") == "annotation", "annotation").when(F.col("role") == "base", "subclass").when(F.col("role") == "call", "instantiation").otherwise("other")
    said = facts.filter("tag in ('use', 'attr') and kind = 'read'").select(*FILE, "name_line", "name_col", kind.alias("kind"))
    met = _led(facts).join(_classes(facts), AT).join(said, [*FILE, "name_line", "name_col"], "left")
    rows = met.select("repo", F.col("cls").alias("name"), "def_path", "path", F.col("name_line").alias("line"), F.col("name_col").alias("col"), F.coalesce("kind", F.lit("other")).alias("kind"))
    return rows.filter(F.col("kind").isin(*kinds)) if kinds is not None else rows


def type_user_counts(facts: DataFrame) -> DataFrame:
    """References to each class (repo, name, def_path) by kind, 0 where none."""
    classes = _classes(facts).select("repo", F.col("cls").alias("name"), "def_path").distinct()
    n = type_users(facts).groupBy("repo", "name", "def_path").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in TYPE_KINDS])
    return classes.join(n, ["repo", "name", "def_path"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in TYPE_KINDS})


def constructor_sites(facts: DataFrame) -> DataFrame:
    """Calls of classes of the corpus: repo, path, cls, def_path, line, col, args. The called name leads to the class.
    Facts needed: def, param, use, import, attr, export, call."""
    calls = of(facts, "call").select(*FILE, "line", "col", "args", "name_line", "name_col")
    met = calls.join(_led(facts, imported=False), [*FILE, "name_line", "name_col"]).join(_classes(facts), AT)
    return met.select(*FILE, "cls", "def_path", "line", "col", "args").dropDuplicates([*FILE, "cls", "line", "col"])


def call_edges(facts: DataFrame) -> DataFrame:
    """repo, src, dst: each function and the functions that it calls, as path:name, by the definitions that names lead to.
    Facts needed: those of CALLING, of which extract_facts may leave out all but the outer ones."""
    known, calls = names(facts), of(facts, "called").withColumn("src", F.concat_ws(":", "path", "caller"))
    own = calls.filter("kind = 'function'").select("repo", "src", F.concat_ws(":", "path", "name").alias("dst"))
    brought = known.bound.filter("place.kind in ('import', 'star')").select(*FILE, F.col("name").alias("head"), F.col("scope").alias("near"), "target", "orig", "of", "far")
    away = calls.filter("kind in ('import', 'star')").withColumn("head", F.split(F.coalesce("text", "name"), r"\.")[0]).select(*FILE, "src", "name", "text", "head", "near")
    met = graph.checkpoint(away.join(brought, [*FILE, "head", "near"]).filter("text is not null or far is not null"))
    far = met.filter("text is null").select("repo", "src", "far").unionByName(_members(met.filter("text is not null"), known, ["repo", "src"]).drop("via_path"))
    callee = of(facts, "def").filter("kind = 'function'").select("repo", F.col("path").alias("def_path"), F.col("name_line").alias("def_line"), F.col("name_col").alias("def_col"), F.concat_ws(":", "path", "name").alias("dst"))
    far = far.filter("far.kind = 'def'").select("repo", "src", F.col("far.path").alias("def_path"), F.col("far.line").alias("def_line"), F.col("far.col").alias("def_col"))
    return far.join(callee, AT).select("repo", "src", "dst").unionByName(own).distinct()


def symbol_refs(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and references of a corpus, as dead_code and test_coverage take them.

    defs: sym (repo, path, name), name, decorated, in_test, for every name defined at the top of a file; refs: sym, ref_file,
    external (0/1), in_test, for every other name of the corpus that leads there, imports too. Facts needed as for class_edges.
    """
    tops = of(facts, "def").filter("is_top").withColumn("sym", F.struct("repo", "path", "name")).groupBy("sym").agg(F.max("decorated").alias("decorated"))
    defs = tops.select("sym", "sym.name", F.coalesce("decorated", F.lit(False)).alias("decorated"), is_test_file(F.col("sym.path")).alias("in_test"))
    places = of(facts, "def").filter("is_top").select("repo", F.col("path").alias("def_path"), F.col("name_line").alias("def_line"), F.col("name_col").alias("def_col"), F.struct("repo", "path", "name").alias("sym"))
    met = _led(facts).join(places, AT)
    refs = met.select("sym", F.col("path").alias("ref_file"), (F.col("path") != F.col("def_path")).cast("int").alias("external"), is_test_ref(F.col("path")).alias("in_test"))
    return defs, refs


#: Rule, severity and message of calls by name, of calls of a module's functions, and of subprocess calls with shell=True.
CALLS = {
    ("", "eval"): ("SEC001", "high", "Use of eval() can execute arbitrary code"),
    ("", "exec"): ("SEC002", "high", "Use of exec() can execute arbitrary code"),
    ("", "compile"): ("SEC003", "medium", "Use of compile() may execute arbitrary code"),
    ("", "__import__"): ("SEC004", "medium", "Dynamic import via __import__()"),
    ("os", "system"): ("SEC010", "high", "os.system() is vulnerable to shell injection"),
    ("os", "popen"): ("SEC011", "high", "os.popen() is vulnerable to shell injection"),
    ("pickle", "loads"): ("SEC020", "high", "pickle.loads() can execute arbitrary code during deserialization"),
    ("pickle", "load"): ("SEC021", "high", "pickle.load() can execute arbitrary code during deserialization"),
    ("yaml", "load"): ("SEC022", "medium", "yaml.load() without SafeLoader can execute arbitrary code"),
    ("marshal", "loads"): ("SEC023", "high", "marshal.loads() can execute arbitrary code"),
}
SHELL = ("call", "run", "Popen", "check_call", "check_output")


def call_rules(facts: DataFrame) -> DataFrame:
    """Risky calls: repo, path, line, rule_id, severity, message, snippet (the stripped line of the call)."""
    table = [(o, f, *rule, False) for (o, f), rule in CALLS.items()]
    table += [("subprocess", f, "SEC030", "high", f"subprocess.{f}() with shell=True is vulnerable to injection", True) for f in SHELL]
    # broadcast: the rules
    rules = F.broadcast(facts.sparkSession.createDataFrame(table, "owner string, fn string, rule_id string, severity string, message string, shell boolean"))
    calls = of(facts, "call").filter("name is not null or kind = 'plain'").withColumns({"owner": F.coalesce("text", F.lit("")), "fn": F.coalesce("name", "attr")})
    return calls.join(rules, ["owner", "fn"]).filter(~F.col("shell") | F.array_contains("args", "shell=True")).select(*FILE, "line", "rule_id", "severity", "message", "snippet")


def class_methods(facts: DataFrame) -> DataFrame:
    """repo, path, cls, method, params (plain parameters but self and cls, joined by a comma), returns of every class's own methods."""
    defs = of(facts, "def")
    outer = defs.filter("kind = 'class'").select(*FILE, F.col("nid").alias("scope"), F.col("name").alias("cls"))
    plain = of(facts, "param").filter("role = ''").groupBy(*FILE, F.col("scope").alias("nid")).agg(F.sort_array(F.collect_list(F.struct("name_line", "name_col", "name"))).alias("p"))
    methods = defs.filter("kind = 'function'").join(outer, [*FILE, "scope"]).join(plain, [*FILE, "nid"], "left")
    params = F.array_join(F.transform(F.coalesce("p", F.expr("array()")), lambda x: x["name"]), ", ")
    return methods.select(*FILE, "cls", F.col("name").alias("method"), params.alias("params"), "returns")


EDIT = ["start_line", "start_col", "end_line", "end_col", "new_text"]


def rename_edits(facts: DataFrame, renames: DataFrame) -> DataFrame:
    """Edits (repo, path, range, new_text) that rename top-level functions, classes and variables in the whole corpus. renames:
    repo, module, old, new. A new name must be a usable one that the module does not mention yet, or it is an error.

    Renamed are all places that bind the name at the top of its module, its export list, reads of it by any way, and imports.
    An import `from m import f` becomes `from m import g`, and f is renamed in that file too, and wherever the file's own f is
    imported in turn or brought by a star, unless the scope binds f elsewhere as well or the file mentions g: then the import
    becomes `from m import g as f` and all else stays. Names given by `as` stay. Strings other than export lists stay.
    """
    known = names(facts)
    usable = F.when(is_identifier(F.col("new")), F.col("new")).otherwise(F.raise_error(F.concat(F.lit("not a usable name: "), F.coalesce("new", F.lit("null")))).cast("string"))
    asked = renames.select("repo", "module", F.col("old").alias("name"), usable.alias("new")).join(known.homes, ["repo", "module"])
    roots = known.tops.filter("far.kind <> 'import'").select("repo", F.col("end_path").alias("path"), F.col("end_name").alias("name"))
    roots = graph.checkpoint(asked.select("repo", F.col("home").alias("path"), "name", "new").distinct().join(roots, [*FILE, "name"]))
    uses = of(facts, "use").select(*FILE, F.col("name").alias("new"))
    taken = known.bound.filter("place.kind <> 'star'").select(*FILE, F.col("name").alias("new")).unionByName(uses).distinct()
    # imports of names that may change, by the rename that may change them
    wanted = roots.select("repo", F.col("name").alias("to_name"), "new").distinct()
    found = known.imports.filter("to_path is not null and orig <> ''").join(wanted, ["repo", "to_name"])
    single = known.bound.filter("n = 1").select(*FILE, "scope", "name", F.lit(True).alias("single"))
    found = found.join(single, [*FILE, "scope", "name"], "left").join(taken.withColumn("taken", F.lit(True)), [*FILE, "new"], "left")
    carries = (F.col("name") == F.col("to_name")) & (F.col("role") != "renamed") & F.coalesce("single", F.lit(False)) & F.col("taken").isNull()
    found = graph.checkpoint(found.withColumn("carries", F.coalesce(carries, F.lit(False)) | (F.col("role") == "star")))
    node = lambda path: F.struct("repo", F.col(path).alias("path"), F.col("to_name").alias("name"), "new")
    links = found.filter("carries and scope = 0").select(node("path").alias("node"), node("to_path").alias("to")).dropDuplicates(["node"])
    ends = graph.jumps(links)[0].filter("ring is null").select("node", "end.*").join(roots, [*FILE, "name", "new"], "left_semi").select("node.*")
    nodes = graph.checkpoint(roots.select(*FILE, "name", "new").unionByName(ends.select(*FILE, "name", "new")).distinct())
    brought = found.filter("role = 'star' and taken").select(*FILE, "name", "new")
    clash = roots.select(*FILE, "name", "new").join(taken, [*FILE, "new"], "left_semi").unionByName(brought.join(nodes, [*FILE, "name", "new"], "left_semi"))
    # every edit asks whether its rename clashes, so none is told if one does
    clashes = clash.groupBy("repo", "name", "new").agg(F.min("path").alias("at"))
    met = found.filter("role <> 'star'").join(nodes.select("repo", F.col("path").alias("to_path"), F.col("name").alias("to_name"), "new"), ["repo", "to_path", "to_name", "new"])
    told = F.when(F.col("carries") | (F.col("role") == "renamed"), F.col("new")).otherwise(F.concat_ws(" as ", "new", "to_name"))
    rows = met.select(*FILE, F.col("to_name").alias("name"), "line", "col", "new", told.alias("new_text"))
    via = nodes.select("repo", F.col("path").alias("via_path"), F.lit(0).alias("via_scope"), F.col("name").alias("via_name"), "new")
    inner = met.filter("carries and scope <> 0").select("repo", F.col("path").alias("via_path"), F.col("scope").alias("via_scope"), F.col("name").alias("via_name"), "new")
    reads = _resolved(facts, known).join(via.unionByName(inner).distinct(), ["repo", "via_path", "via_scope", "via_name"])
    rows = rows.unionByName(reads.select(*USE, "new", F.col("new").alias("new_text")))
    place = [*FILE, "name", F.col("name_line").alias("line"), F.col("name_col").alias("col")]
    writes = of(facts, "def").filter("kind <> 'variable' and scope = 0").select(*place).unionByName(of(facts, "use").filter("kind = 'write' and scope = 0").select(*place))
    writes = writes.join(roots.select(*FILE, "name", "new"), [*FILE, "name"]).unionByName(of(facts, "export").select(*place).join(nodes, [*FILE, "name"]))
    again = absolutize(of(facts, "import")).filter("kind = 'from' and role = '' and scope = 0").select(*place).join(roots.select(*FILE, "name", "new"), [*FILE, "name"])
    rows = rows.unionByName(writes.filter("line is not null").select(*USE, "new", F.col("new").alias("new_text")))
    rows = rows.unionByName(again.select(*USE, "new", F.concat_ws(" as ", "name", "new").alias("new_text"))).distinct()
    rows = rows.join(clashes, ["repo", "name", "new"], "left")
    text = F.when(F.col("at").isNull(), F.col("new_text")).otherwise(F.raise_error(F.concat(F.lit("the new name is taken: "), "new", F.lit(" in "), "at")).cast("string"))
    return rows.select(*FILE, F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), (F.col("col") + F.length("name")).alias("end_col"), text.alias("new_text"))


def star_edits(facts: DataFrame) -> DataFrame:
    """Edits that put the names which a file reads in place of the * of its star imports; a star of which nothing is read stays."""
    stars = of(facts, "import").filter("name = '*'").select(*FILE, "line", "name_line", "name_col")
    names = expand_star(facts).select(*FILE, "line", F.col("names").alias("new_text"))
    rows = stars.join(names, [*FILE, "line"])
    return rows.select(*FILE, F.col("name_line").alias("start_line"), F.col("name_col").alias("start_col"), F.col("name_line").alias("end_line"), (F.col("name_col") + 1).alias("end_col"), "new_text")


def absolute_edits(facts: DataFrame) -> DataFrame:
    """Edits that put the absolute module in place of a relative one."""
    rows = absolutize(of(facts, "import")).filter("level > 0 and mod_col is not null and target <> ''")
    return rows.select(*FILE, F.col("line").alias("start_line"), F.col("mod_col").alias("start_col"), F.col("line").alias("end_line"), F.col("mod_end").alias("end_col"), F.col("target").alias("new_text")).distinct()


def expand_star(facts: DataFrame) -> DataFrame:
    """The names that each `from m import *` should list: names that it brings, from m's own stars too, and the
    file reads but does not bind itself, sorted."""
    bound, homes = graph.checkpoint(bindings(facts)), graph.checkpoint(module_homes(facts))
    top = bound.filter("scope = 0")
    more = _star_names(facts, top, homes)
    have = top.select("repo", F.col("path").alias("home"), "name")
    have = have if more is None else have.unionByName(more.select("repo", F.col("path").alias("home"), "name"))
    stars = absolutize(of(facts, "import").filter("name = '*'")).select(*FILE, "target", "line").join(homes.withColumnRenamed("module", "target"), ["repo", "target"])
    used = of(facts, "use").filter("kind = 'read'").select(*FILE, "name").distinct().join(top, [*FILE, "name"], "left_anti")
    return stars.join(_passed(facts, have.distinct()), ["repo", "home"]).join(used, [*FILE, "name"]).groupBy(*FILE, "line", "target").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


#: Statements that fold.
FOLDING = ("FunctionDef", "AsyncFunctionDef", "ClassDef", "If", "For", "While", "With", "AsyncWith", "AsyncFor", "Try")


def folding_ranges(facts: DataFrame) -> DataFrame:
    """Compound statements of more than one line (region), and runs of imports at the top of a file (imports)."""
    nodes = of(facts, "node")
    regions = nodes.filter(F.col("kind").isin(*FOLDING) & (F.col("end_line") > F.col("line"))).select(*FILE, F.col("line").alias("first"), F.col("end_line").alias("last"), F.lit("region").alias("fold"))
    tops = nodes.filter("is_top").select(*FILE, "nid", "line", "end_line", F.col("kind").isin("Import", "ImportFrom").cast("int").alias("flag"))
    runs = windows.runs(tops, FILE, "nid", "flag", 1, ("line", "end_line")).filter("to > from")
    return regions.unionByName(runs.select(*FILE, F.col("from").alias("first"), F.col("to").alias("last"), F.lit("imports").alias("fold")))
