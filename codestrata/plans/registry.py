"""Queries over the given tables, one or more for each operator, with the SQL that checks them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from codestrata.functions import scalars
from codestrata.operators import aggs, code, edits, filters, graph, joins, merge, windows
from codestrata.plans import views as V
from codestrata.sources import corpus, facts
from codestrata.streaming import findings as live

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FIND = f"WITH f AS ({V.FINDINGS}) "
HALF = lambda num, den, p: f"CASE WHEN ({den}) > 0 THEN ((2 * ({num}) * {10**p} + ({den})) // (2 * ({den}))) / {10**p}.0 ELSE 0.0 END"


def _f(spark, d):
    return V.view(spark, d, V.FINDINGS)


# --- filters -------------------------------------------------------------------------------------------------------
@query(FIND + "SELECT path, seq FROM f WHERE lower(trim(severity)) = 'error'")
def f1_by_severity(spark, d):
    return filters.by_severity(_f(spark, d), " ERROR ").select("path", "seq")


@query(FIND + "SELECT path, seq, code FROM f WHERE code IS NULL OR code NOT IN ('c1','c3')")
def f2_suppress(spark, d):
    return filters.suppress(_f(spark, d), ["c1", "c3"]).select("path", "seq", "code")


@query(r"""WITH l AS (SELECT doc_id AS path, unnest(string_split_regex(text, '\r\n|\r|\n')) AS text, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS start_line FROM documents)
SELECT path, start_line FROM l WHERE NOT regexp_matches(text, 'token = ')""")
def f3_inline_suppress(spark, d):
    lines = _doc_lines(spark, d)
    return filters.inline_suppress(lines.select("path", F.col("line").alias("start_line")), lines, "token = ")


def _doc_lines(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


@query(FIND + "SELECT path, seq FROM f WHERE NOT (contains(message, 'click') OR contains(message, 'err'))")
def f4_drop_messages(spark, d):
    return filters.drop_messages(_f(spark, d), ["click", "err"]).select("path", "seq")


@query("SELECT p_partkey AS sym, p_name AS name FROM part WHERE lower(trim(p_type)) IN (SELECT lower(min(p_type)) FROM part) AND regexp_matches(p_name, '[a-m]')")
def f5_filter_symbols(spark, d):
    part = V.table(spark, d, "part")
    kind = part.agg(F.min("p_type").alias("k")).first()["k"]
    return filters.filter_symbols(part.select(F.col("p_partkey").alias("sym"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")), [kind or ""], "[a-m]").drop("kind")


@query("SELECT p_partkey AS sym, p_name AS name FROM part WHERE NOT (regexp_matches(p_name, '1$') OR regexp_matches(p_name, '[58]$'))")
def f6_exclude_names(spark, d):
    return filters.exclude_names(V.table(spark, d, "part").select(F.col("p_partkey").alias("sym"), F.col("p_name").alias("name")), ["1$", "[58]$"])


PATHS = "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'src/test_' || p_size || '.py' WHEN 1 THEN 'src/a_test.py' WHEN 2 THEN 'x/conftest.py' WHEN 3 THEN 'Tests/a.py' WHEN 4 THEN 'src/contest.py' ELSE 'src/.venv/a.py' END AS path FROM part"


@query(f"""WITH p AS ({PATHS}), q AS (SELECT *, string_split(path, '/')[-1] AS b FROM p)
SELECT k, (starts_with(b, 'test_') AND ends_with(b, '.py')) OR ends_with(b, '_test.py') OR b = 'conftest.py' AS a, contains(lower(b), 'test') OR contains(lower(path), 'tests') AS b FROM q""")
def f7_test_files(spark, d):
    return V.view(spark, d, PATHS).select("k", scalars.is_test_file(F.col("path")).alias("a"), scalars.is_test_ref(F.col("path")).alias("b"))


@query(FIND + "SELECT path, min(seq) AS seq, count(*) > 0 AS kept FROM f GROUP BY path, start_line, start_col, end_line, end_col, severity, message")
def f8_dedupe_findings(spark, d):
    return filters.dedupe_findings(_f(spark, d)).select("path", "seq", F.lit(True).alias("kept"))


@query("SELECT p_partkey AS k FROM part WHERE p_partkey <= 100 AND p_partkey + p_size >= 100")
def f9_at_position(spark, d):
    r = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("start_line"), F.lit(0).alias("start_col"), (F.col("p_partkey") + F.col("p_size")).alias("end_line"), F.lit(5).alias("end_col"))
    return filters.at_position(r, 100, 0).select("k")


# --- order, limits, sources ----------------------------------------------------------------------------------------
@query(FIND + "SELECT path, start_line, seq FROM f")
def l1_order_locations(spark, d):
    return filters.order_locations(_f(spark, d), "seq").select("path", "start_line", "seq")


@query(FIND + "SELECT path, seq, (SELECT count(*) FROM f) > 100 AS truncated FROM f ORDER BY path, seq LIMIT 100")
def l2_top(spark, d):
    return filters.top(_f(spark, d).select("path", "seq"), ["path", "seq"], 100)


@query(FIND + "SELECT path, seq, (SELECT count(*) FROM f) AS total_count, (SELECT count(*) FROM f) > 150 AS truncated FROM f ORDER BY path, seq LIMIT 100 OFFSET 50")
def l3_page(spark, d):
    return filters.page(_f(spark, d).select("path", "seq"), ["path", "seq"], 50, 100)


@query(f"WITH p AS ({PATHS}) SELECT k, path FROM p WHERE NOT contains(path, '.venv')")
def s1_source_files(spark, d):
    return corpus.source_files(V.view(spark, d, PATHS)).select("k", "path")


ROOTS = r"SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/?#]+)', 1) AS root FROM pages WHERE page_id % 2 = 0"


def _roots(spark, d):
    pages = V.table(spark, d, "pages")
    host = pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"))
    return host.union(pages.filter("page_id % 2 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[^/?#]+)", 1))).distinct()


@query(f"WITH r AS ({ROOTS}), u AS (SELECT DISTINCT url AS path FROM pages) SELECT path, (SELECT max_by(root, length(root)) FROM r WHERE u.path = root OR starts_with(u.path, root || '/')) AS root FROM u")
def s4_assign_root(spark, d):
    return merge.assign_root(V.table(spark, d, "pages").select(F.col("url").alias("path")).distinct(), _roots(spark, d))


@query(f"WITH p AS ({PATHS}) SELECT k, path FROM p WHERE path = 'src' OR starts_with(path, 'src/')")
def s5_within_root(spark, d):
    return merge.within_root(V.view(spark, d, PATHS), "src/")


def _new(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    changed = docs.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return changed.union(docs.filter("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 1000000))


@query(f"WITH n AS ({V.NEW}) SELECT coalesce(d.doc_id, n.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN d.text = n.text THEN 'unchanged' ELSE 'changed' END AS status FROM documents d FULL JOIN n ON d.doc_id = n.doc_id")
def s6_snapshot_diff(spark, d):
    return merge.snapshot_diff(V.table(spark, d, "documents"), _new(spark, d), "doc_id", "text")


@query("SELECT doc_id, text FROM documents")
def s7_write_files(spark, d):
    folder = f"{graph.shared_folder(spark)}/written-{uuid4().hex}"
    corpus.write_files(V.table(spark, d, "documents").select("doc_id", "text"), folder, 1, apply=True)
    return corpus.read_files(spark, folder)


# --- merges --------------------------------------------------------------------------------------------------------
A, B = "SELECT p_brand AS q, p_partkey AS k FROM part WHERE p_size < 20 AND p_brand <> 'Brand#11'", "SELECT p_brand AS q, p_partkey AS k FROM part WHERE p_size >= 15 AND p_size < 25"


@query(f"""WITH a AS ({A}), b AS ({B}), u AS (SELECT q, k, 1 AS p FROM a UNION ALL SELECT q, k, 0 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.q = b.q AND a.k = b.k))
SELECT q, k, CASE WHEN max(p) OVER (PARTITION BY q) = 0 THEN 'secondary' WHEN min(p) OVER (PARTITION BY q) = 0 THEN 'combined' ELSE 'primary' END AS source FROM u""")
def u1_merge_prioritized(spark, d):
    return merge.merge_prioritized(V.view(spark, d, A), V.view(spark, d, B), ["q", "k"], "q")


@query(f"WITH a AS ({A}), b AS ({B}) SELECT q, k FROM a UNION SELECT q, k FROM b WHERE q NOT IN (SELECT q FROM a)")
def u2_fallback_union(spark, d):
    return merge.fallback_union(V.view(spark, d, A), V.view(spark, d, B), "q")


@query(rf"""WITH n AS ({V.NEW}), x AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS t, 1 AS s FROM n UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')), -1 FROM documents),
g AS (SELECT doc_id, t, sum(s) AS s FROM x GROUP BY doc_id, t) SELECT doc_id, CAST(sum(greatest(s, 0)) AS BIGINT) AS added, CAST(sum(greatest(-s, 0)) AS BIGINT) AS removed FROM g GROUP BY doc_id""")
def u3_line_delta(spark, d):
    return merge.line_delta(V.table(spark, d, "documents"), _new(spark, d), "doc_id", "text")


# --- joins ---------------------------------------------------------------------------------------------------------
@query(r"""SELECT doc_id AS path, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS start_line, unnest(string_split_regex(text, '\r\n|\r|\n')) AS context FROM documents""")
def j1_add_context(spark, d):
    lines = _doc_lines(spark, d)
    return joins.add_context(lines.select("path", F.col("line").alias("start_line")), lines)


@query(f"WITH i AS ({V.INTERVALS}), p AS ({V.POINTS}), m AS (SELECT p.path, pid, nid, row_number() OVER (PARTITION BY p.path, pid ORDER BY end_line - start_line, nid) AS n FROM p JOIN i ON p.path = i.path AND start_line <= line AND line <= end_line) SELECT p.path, p.pid, nid FROM p LEFT JOIN m ON p.path = m.path AND p.pid = m.pid AND n = 1")
def j2_enclosing_scope(spark, d):
    return joins.enclosing_scope(V.view(spark, d, V.POINTS), V.view(spark, d, V.INTERVALS))


@query(f"WITH i AS ({V.INTERVALS}), p AS ({V.POINTS}) SELECT p.path, pid, string_agg(CAST(nid AS VARCHAR), ',' ORDER BY end_line - start_line, nid) AS nids FROM p JOIN i ON p.path = i.path AND start_line <= line AND line <= end_line GROUP BY p.path, pid")
def j3_selection_ranges(spark, d):
    out = joins.selection_ranges(V.view(spark, d, V.POINTS), V.view(spark, d, V.INTERVALS))
    return out.withColumn("nids", F.array_join(F.transform("nids", lambda x: x.cast("string")), ","))


NEST = f"""WITH i AS ({V.INTERVALS}), m AS (SELECT a.path, a.nid, b.nid AS parent_id, row_number() OVER (PARTITION BY a.path, a.nid ORDER BY (b.end_line - b.start_line) %s, b.nid %s) AS n FROM i a JOIN i b ON a.path = b.path AND a.nid <> b.nid
AND b.start_line <= a.start_line AND a.end_line <= b.end_line AND (b.end_line - b.start_line > a.end_line - a.start_line OR b.nid < a.nid)) SELECT i.path, i.nid, parent_id FROM i LEFT JOIN m ON i.path = m.path AND i.nid = m.nid AND n = 1"""


@query(NEST % ("", ""))
def j4_nest_outline_direct(spark, d):
    return joins.nest_outline(V.view(spark, d, V.INTERVALS), "direct")


@query(NEST % ("DESC", "DESC"))
def j4_nest_outline_outermost(spark, d):
    return joins.nest_outline(V.view(spark, d, V.INTERVALS), "outermost")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'never', 0")
def j12_zero_filled_kinds(spark, d):
    ev = V.table(spark, d, "events").select(F.col("event_type").alias("kind"))
    return joins.with_zero_kinds(ev, ev.distinct().union(spark.range(1).select(F.lit("never"))))


@query("SELECT o_orderkey AS file FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j14_unused(spark, d):
    imports = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.lit("x").alias("name"))
    return joins.unused(imports, V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit("x").alias("name")), "file", "name").select("file")


@query(f"""WITH r AS ({V.REFS}), c AS (SELECT sym, sum(external) AS e, sum(1 - external) AS o FROM r GROUP BY sym), p AS ({V.DEFS}),
t AS (SELECT sym, name, 'unused diagnostic' AS reason FROM p WHERE NOT in_test AND sym % 13 = 0),
a AS (SELECT p.sym, name, 'no references' AS reason FROM p LEFT JOIN c ON p.sym = c.sym WHERE NOT in_test AND NOT decorated AND coalesce(e, 0) = 0 AND coalesce(o, 0) <= 1 AND p.sym NOT IN (SELECT sym FROM t))
SELECT *, 'high' AS confidence FROM t UNION ALL SELECT *, CASE WHEN lower(name) IN ('logger', '_logger', 'log', '_log') OR name LIKE 'test#_%' ESCAPE '#' OR name LIKE 'Test%' OR name LIKE '#_#_%#_#_' ESCAPE '#' THEN 'low' ELSE 'medium' END FROM a""")
def j16_dead_code(spark, d):
    defs = V.view(spark, d, V.DEFS)
    return joins.dead_code(defs, V.view(spark, d, V.REFS), defs.filter("sym % 13 = 0").select("sym"))


@query("SELECT DISTINCT p_name AS name, p_brand AS module, 'from ' || p_brand || ' import ' || p_name AS statement FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 7)")
def j17_suggest_imports(spark, d):
    part = V.table(spark, d, "part")
    return joins.suggest_imports(part.filter("p_size = 7").select(F.col("p_name").alias("name")), part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("module")))


@query("""WITH q AS (SELECT DISTINCT p_name AS q FROM part WHERE p_partkey = 1 UNION SELECT '9'), e AS (SELECT q, p_partkey AS sym, p_name AS name, 'exact' AS "match" FROM part JOIN q ON p_name = q)
SELECT * FROM e UNION ALL SELECT q, p_partkey, p_name, 'part' FROM part JOIN q ON contains(lower(p_name), lower(q)) WHERE q NOT IN (SELECT q FROM e)""")
def j18_search_symbols(spark, d):
    part = V.table(spark, d, "part")
    first = part.filter("p_partkey = 1").first()
    return joins.search_symbols(part.select(F.col("p_partkey").alias("sym"), F.col("p_name").alias("name")), ([first["p_name"]] if first else []) + ["9"])


MANY = "SELECT CAST(s_suppkey AS STRING) AS q FROM supplier UNION SELECT p_name AS q FROM part WHERE p_partkey % 50 = 0 UNION SELECT upper(substring(p_name, 2, 4)) AS q FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_name || 'x' AS q FROM part WHERE p_partkey % 7 = 0"


@query(f"""WITH q AS ({MANY}), e AS (SELECT q, p_partkey AS sym, p_name AS name, 'exact' AS "match" FROM part JOIN q ON p_name = q)
SELECT * FROM e UNION ALL SELECT q, p_partkey, p_name, 'part' FROM part JOIN q ON contains(lower(p_name), lower(q)) WHERE q NOT IN (SELECT q FROM e)""")
def j18_search_many(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("sym"), F.col("p_name").alias("name"))
    return joins.search_many(part, V.view(spark, d, MANY), graph.checkpoint(joins.gram_index(part)))


# --- aggregations --------------------------------------------------------------------------------------------------
@query(FIND + """, g AS (SELECT path, lower(trim(severity)) AS s FROM f) SELECT path, count(*) FILTER (s = 'error') AS error, count(*) FILTER (s = 'warning') AS warning,
count(*) FILTER (s NOT IN ('error','warning','hint')) AS information, count(*) FILTER (s = 'hint') AS hint, count(*) AS total FROM g GROUP BY path""")
def a1_findings_summary(spark, d):
    return aggs.findings_summary(_f(spark, d))


@query(f"WITH g AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, {HALF('sum(c)', 'count(*)', 2)} AS average, max(c) AS greatest FROM g")
def a3_metrics_summary(spark, d):
    return aggs.metrics_summary(V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c")), "c")


@query(f"SELECT count(*) AS total, count(l.doc_id) AS covered, {HALF('100 * count(l.doc_id)', 'count(*)', 1)} AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def a4_coverage(spark, d):
    marked = V.table(spark, d, "labels").select("doc_id").distinct().withColumn("m", F.lit(True))
    return aggs.coverage_summary(V.table(spark, d, "documents").select("doc_id").join(marked, "doc_id", "left").withColumn("m", F.coalesce("m", F.lit(False))), "m")


@query("WITH g AS (SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) >= 2) SELECT h, n, first, doc_id AS item FROM g JOIN documents ON md5(text) = h")
def a5_duplicates(spark, d):
    return aggs.duplicates(V.table(spark, d, "documents"), "text", "doc_id")


@query("WITH l AS (SELECT doc_id AS path, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS text, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) - 1 AS line FROM documents), r AS (SELECT * FROM (VALUES "
       + ", ".join(f"('{i}', '{s}', '{p}')" for i, s, p in V.RULES) + ") t(rule_id, severity, pattern)) SELECT path, line, rule_id, severity, trim(text) AS snippet FROM l JOIN r ON regexp_matches(text, pattern)")
def a6_rule_scan(spark, d):
    return aggs.rule_scan(_doc_lines(spark, d), list(V.RULES))


@query(f"WITH r AS ({V.REFS}), c AS (SELECT sym, count(DISTINCT ref_file) AS n, list_sort(list(DISTINCT ref_file)) AS f FROM r GROUP BY sym) SELECT p_partkey AS sym, coalesce(n, 0) AS test_files, array_to_string(f, ',') AS files, n IS NOT NULL AS covered FROM part LEFT JOIN c ON p_partkey = sym")
def a7_test_coverage(spark, d):
    found = aggs.test_coverage(V.table(spark, d, "part").select(F.col("p_partkey").alias("sym")), V.view(spark, d, V.REFS))
    return found.withColumn("files", F.array_join(F.col("files").cast("array<string>"), ","))


@query(f"WITH r AS ({V.REFS}) SELECT count(*) AS total, count(*) FILTER (p_partkey IN (SELECT sym FROM r)) AS covered, {HALF('100 * count(*) FILTER (p_partkey IN (SELECT sym FROM r))', 'count(*)', 1)} AS pct FROM part")
def a7_coverage_percentage(spark, d):
    return aggs.coverage_summary(aggs.test_coverage(V.table(spark, d, "part").select(F.col("p_partkey").alias("sym")), V.view(spark, d, V.REFS), listed=False), "covered")


@query(f"WITH r AS ({V.REFS}) SELECT DISTINCT sym, ref_file FROM r WHERE sym IN (SELECT p_partkey FROM part)")
def a7_covering_files(spark, d):
    return aggs.covering_files(V.table(spark, d, "part").select(F.col("p_partkey").alias("sym")), V.view(spark, d, V.REFS))


CONFORM = """WITH c AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey < 3), m AS (SELECT k, 'm0' AS method, 'x' AS params FROM c UNION ALL SELECT k, 'm1', CASE WHEN k % 3 = 0 THEN 'x, y' ELSE 'x' END FROM c UNION ALL SELECT k, 'p_' || (k % 5), '' FROM c),
g AS (SELECT method, count(DISTINCT k) AS n, count(DISTINCT params) AS p, string_agg('C_' || k, ',' ORDER BY k) AS has FROM m GROUP BY method) """


@query(CONFORM + "SELECT method, n AS classes, n = 3 AS common, n = 3 AND p > 1 AS mismatched, CASE WHEN n < 3 THEN has END AS only_in FROM g")
def a9_interface_conformance(spark, d):
    return aggs.interface_conformance(code.class_methods(_class_facts(spark, d, "def", "param")), ["C_0", "C_1", "C_2"])


@query("SELECT 'class P(Protocol):' || chr(10) || '    def m0(self, x): ...' || chr(10) || '    def m1(self, x' || CASE WHEN s_suppkey % 3 = 0 THEN ', y' ELSE '' END || ')' || CASE WHEN s_suppkey % 2 = 0 THEN ' -> int' ELSE '' END || ': ...' || chr(10) AS text FROM supplier WHERE s_suppkey = 0")
def a10_protocol_text(spark, d):
    return aggs.protocol_text(code.class_methods(_class_facts(spark, d, "def", "param")), ["C_0", "C_1", "C_2"], "P")


# --- graphs --------------------------------------------------------------------------------------------------------
def _edges(spark, d):
    return V.view(spark, d, V.EDGES)


E_ = f"e AS ({V.EDGES})"
CLOSE = f"WITH RECURSIVE {E_}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) "


@query(CLOSE + ", s AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) SELECT node, least(min(other), node) AS component FROM s GROUP BY node")
def g3_sccs(spark, d):
    return graph.sccs(_edges(spark, d))


@query("SELECT p_partkey AS node, p_partkey - p_partkey % 500 AS component FROM part")
def g3_long_rings(spark, d):
    return graph.sccs(V.view(spark, d, V.RINGS))


@query(f"""WITH RECURSIVE {E_}, p AS (SELECT [src, dst] AS c FROM e WHERE dst > src UNION ALL SELECT list_append(c, e.dst) FROM p JOIN e ON c[-1] = e.src WHERE e.dst > c[1] AND NOT list_contains(c, e.dst) AND len(c) < 4)
SELECT array_to_string(c, ',') AS cycle FROM p JOIN e ON c[-1] = e.src AND e.dst = c[1] UNION ALL SELECT CAST(src AS VARCHAR) FROM e WHERE src = dst""")
def g3_cycles(spark, d):
    return graph.cycles(_edges(spark, d), 4).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query(f"""WITH RECURSIVE {E_}, p AS (SELECT [src, dst] AS c FROM e WHERE dst > src UNION ALL SELECT list_append(c, e.dst) FROM p JOIN e ON c[-1] = e.src WHERE e.dst > c[1] AND NOT list_contains(c, e.dst) AND len(c) < 7)
SELECT array_to_string(c, ',') AS cycle FROM p JOIN e ON c[-1] = e.src AND e.dst = c[1] UNION ALL SELECT CAST(src AS VARCHAR) FROM e WHERE src = dst""")
def g3_cycles_of_seven(spark, d):
    return graph.cycles(_edges(spark, d), 7).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query(f"""WITH {E_}, a AS (SELECT dst AS v, count(DISTINCT src) AS ca FROM e WHERE src <> dst GROUP BY dst), b AS (SELECT src AS v, count(DISTINCT dst) AS ce FROM e WHERE src <> dst GROUP BY src),
n AS (SELECT c_custkey AS v, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM customer LEFT JOIN a ON c_custkey = a.v LEFT JOIN b ON c_custkey = b.v) SELECT v, ca, ce, {HALF('ce', 'ca + ce', 3)} AS instability FROM n""")
def g4_coupling(spark, d):
    return graph.coupling(_edges(spark, d), V.table(spark, d, "customer").select(F.col("c_custkey").alias("v")))


@query(f"WITH {E_} SELECT src, dst, a.c_nationkey AS src_layer, b.c_nationkey AS dst_layer FROM e JOIN customer a ON src = a.c_custkey JOIN customer b ON dst = b.c_custkey WHERE a.c_nationkey > b.c_nationkey")
def g5_layer_violations(spark, d):
    return graph.layer_violations(_edges(spark, d), V.table(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.col("c_nationkey").alias("layer")))


@query(f"""WITH RECURSIVE {E_}, w AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS depth FROM customer UNION SELECT root, e.dst, depth + 1 FROM w JOIN e ON node = e.src WHERE depth < 3)
SELECT root, node, CAST(min(depth) AS INT) AS depth, false AS truncated FROM w WHERE node <> root GROUP BY root, node""")
def g6_traverse(spark, d):
    return graph.traverse(_edges(spark, d), V.table(spark, d, "customer").select(F.col("c_custkey").alias("root")), "callees", 3)


# --- windows -------------------------------------------------------------------------------------------------------
@query(f"WITH r AS ({V.RUNS}), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - row_number() OVER (PARTITION BY user_id, is_import ORDER BY seq) AS g FROM r) SELECT user_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM g WHERE is_import = 1 GROUP BY user_id, g HAVING count(*) >= 2")
def w1_runs(spark, d):
    return windows.runs(V.view(spark, d, V.RUNS), ["user_id"], "seq", "is_import")


@query(f"""WITH t AS ({V.TOKENS}), a AS (SELECT *, sum(d_line) OVER (PARTITION BY user_id ORDER BY seq) AS line FROM t), b AS (SELECT *, sum(d_col) OVER (PARTITION BY user_id, line ORDER BY seq) AS col FROM a)
SELECT user_id, seq, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, CAST(col + greatest(len, 0) AS BIGINT) AS end_col, coalesce({windows.TOKEN_TYPES!r}[type_idx + 1], 'unknown') AS type,
array_to_string(list_filter({windows.MODIFIERS!r}, lambda x, i: bits & (1 << (i - 1)) <> 0), ',') AS modifiers FROM b""")
def w2_delta_decode(spark, d):
    return windows.delta_decode(V.view(spark, d, V.TOKENS), "user_id")


# --- edits ---------------------------------------------------------------------------------------------------------
LINES = r"string_split_regex(text, '\r\n|\r|\n')"


@query(f"""WITH l AS (SELECT doc_id, unnest({LINES}) AS t, unnest(list_concat(regexp_extract_all(text, '\\r\\n|\\r|\\n'), [''])) AS s, generate_subscripts({LINES}, 1) - 1 AS line FROM documents)
SELECT doc_id, CAST(line AS INT) AS line, 0 AS col, CAST(coalesce(sum(length(t) + length(s)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS "offset" FROM l WHERE length(t) > 0 OR s <> ''""")
def e1_to_offset(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    at = docs.select("doc_id", F.posexplode(F.split("text", edits.BREAK, -1)).alias("line", "t"), F.lit(0).alias("col"))
    return edits.to_offset(at.select("doc_id", "line", "col"), docs, "doc_id", "text").filter("offset is not null")


@query(f"SELECT doc_id, CAST(length(text) // 2 AS INT) AS \"offset\", CAST(len(regexp_extract_all(substr(text, 1, length(text) // 2), '\\n')) AS INT) AS line, CAST(length(string_split(substr(text, 1, length(text) // 2), chr(10))[-1]) AS INT) AS col FROM documents WHERE NOT contains(text, chr(13))")
def e1_to_position(spark, d):
    docs = V.table(spark, d, "documents").filter("not contains(text, '\r')").select("doc_id", "text")
    return edits.to_position(docs.select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("offset")), docs, "doc_id", "text")


@query(f"SELECT doc_id, CAST(len({LINES}) - 1 AS INT) AS end_line, CAST(length({LINES}[-1]) AS INT) AS end_col FROM documents")
def e1_end_position(spark, d):
    return edits.end_position(V.table(spark, d, "documents"), "doc_id", "text")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN text ELSE 'X' || substr(text, 2) || 'YZ' END AS text, false AS rejected FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE length(text) > 1")
def e2_apply_edits(spark, d):
    docs = V.table(spark, d, "documents").filter("length(text) > 1")
    ends = edits.end_position(docs, "doc_id", "text").join(V.table(spark, d, "labels").select("doc_id"), "doc_id")
    # two inserts at the end come out in reverse order
    tail = ends.select("doc_id", F.col("end_line").alias("start_line"), F.col("end_col").alias("start_col"), "end_line", "end_col", F.explode(F.array(F.struct(F.lit("Z").alias("t"), F.lit(1).alias("n")), F.struct(F.lit("Y").alias("t"), F.lit(2).alias("n")))).alias("x"))
    every = V.view(spark, d, V.EDITS).unionByName(tail.select("doc_id", "start_line", "start_col", "end_line", "end_col", F.col("x.t").alias("new_text"), F.col("x.n").alias("seq")))
    return edits.apply_edits(docs.select("doc_id", "text"), every, "doc_id", "text")


@query("SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS path, CAST(event_id % 9 AS INT) AS start_line, 0 AS start_col, CAST(event_id % 9 AS INT) AS end_line, 1 AS end_col, event_type AS new_text FROM events")
def e3_normalize_edits(spark, d):
    edit = F.struct(F.concat(F.lit("u"), "user_id").alias("path"), (F.col("event_id") % 9).cast("int").alias("start_line"), F.lit(0).alias("start_col"), (F.col("event_id") % 9).cast("int").alias("end_line"), F.lit(1).alias("end_col"), F.col("event_type").alias("new_text"))
    by_path = F.create_map(F.concat(F.lit("u"), "user_id"), F.array(edit))
    return edits.normalize_edits(V.table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(edit))).otherwise(F.to_json(by_path)).alias("payload")))


@query("SELECT 'u' || CAST(user_id AS VARCHAR) AS path, event_id AS start_line, 4 AS start_col, event_id AS end_line, 4 AS end_col, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END || event_type || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END AS new_text FROM events WHERE event_id % 4 <> 0")
def e4_hints_to_edits(spark, d):
    return edits.hints_to_edits(V.table(spark, d, "events").selectExpr("'u' || user_id AS path", "event_id AS line", "4 AS col", "event_type AS label", "event_id % 2 = 0 AS pad_left", "event_id % 3 = 0 AS pad_right", "CASE WHEN event_id % 4 = 0 THEN 'parameter' ELSE 'type' END AS kind"))


@query("WITH t AS (SELECT p_name || CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'a' END AS path FROM part) SELECT path, target, n > 1 AS collision FROM (SELECT path, lower(path) AS target, count(*) OVER (PARTITION BY lower(path)) AS n FROM t) WHERE path <> target")
def e8_module_rename_plan(spark, d):
    return edits.module_rename_plan(V.table(spark, d, "part").selectExpr("p_name || CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'a' END AS path"))


@query(f"WITH l AS ({V.LOG}) SELECT path, max(seq) AS seq, max_by(content, seq) AS content FROM l WHERE batch % 2 = 0 AND seq NOT IN (SELECT seq FROM l WHERE batch % 2 = 0 ORDER BY seq DESC LIMIT 20) GROUP BY path")
def e9_change_log(spark, d):
    log = V.view(spark, d, V.LOG)
    return edits.as_of(edits.committed(log, log.select("batch").distinct().filter("batch % 2 = 0")), "path", 20)


STACKS = "SELECT user_id AS project, i AS seq, CASE i % 7 WHEN 2 THEN 'undo' WHEN 3 THEN 'redo' WHEN 4 THEN 'undo' WHEN 6 THEN 'undo' ELSE 'do' END AS op, event_id AS change FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) x"


@query(f"""WITH RECURSIVE l AS ({STACKS}), w AS (SELECT project, CAST(-1 AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS back FROM (SELECT DISTINCT project FROM l) p UNION ALL
SELECT w.project, l.seq, CASE op WHEN 'do' THEN list_append(done, change) WHEN 'undo' THEN done[:-2] ELSE list_append(done, back[-1]) END, CASE op WHEN 'do' THEN [] WHEN 'undo' THEN list_append(back, done[-1]) ELSE back[:-2] END FROM w JOIN l ON l.project = w.project AND l.seq = w.seq + 1),
e AS (SELECT project, max_by(done, seq) AS done, max_by(back, seq) AS back FROM w GROUP BY project)
SELECT project, unnest(done) AS change, generate_subscripts(done, 1) AS level, 'done' AS state FROM e UNION ALL SELECT project, unnest(back), len(done) + len(back) + 1 - generate_subscripts(back, 1), 'redoable' FROM e""")
def e9_undo_redo(spark, d):
    return edits.change_stacks(V.view(spark, d, STACKS)).select("project", "change", "level", "state")


# --- streams -------------------------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS path, event_id AS version, event_type, event_id % 4 AS k FROM events WHERE event_id % 5 <> 0)
SELECT path, max(version) AS version, CASE WHEN max_by(k, version) = 0 THEN '' ELSE max_by(event_type, version) END AS messages FROM m GROUP BY path""")
def x1_latest_findings(spark, d):
    one = F.array(F.struct(F.lit(1).alias("line"), F.lit("error").alias("severity"), F.col("event_type").alias("message")))
    payload = F.when(F.col("event_id") % 5 == 0, "broken").when(F.col("event_id") % 4 == 0, "[]").otherwise(F.to_json(one))
    messages = V.table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("version"), payload.alias("payload"))
    return live.latest_findings(messages).select("path", "version", F.array_join(F.transform("findings", lambda x: x["message"]), ",").alias("messages"))


# --- code facts over modules rendered from part and supplier --------------------------------------------------------
def _stored(files, *tags, columns=None, outer=False):
    """Facts of these tags (and columns, if not all), from one parse of each file."""
    return graph.checkpoint(facts.extract_facts(files, tags, columns=columns, outer=outer))


def _facts(spark, d, *tags, columns=None, outer=False):
    return _stored(V.rendered(spark, d), *tags, columns=columns, outer=outer)


def _class_facts(spark, d, *tags):
    return _stored(V.rendered_classes(spark, d), *tags)


def _scope_facts(spark, d, *tags):
    return _stored(V.rendered_scopes(spark, d), *tags)


NAMES = ("def", "param", "use", "import", "attr", "export")
# start and back: the lines of the function and of its return
K = """WITH o AS (SELECT p_partkey AS k, p_size % 4 AS d, p_partkey // 3 AS j, (SELECT count(*) FROM part) AS n FROM part),
p AS (SELECT *, 2 + (k > 0)::INT + (k % 5 = 0 AND k + 1 < n)::INT + (k % 4 = 0)::INT AS start FROM o), q AS (SELECT *, start + 1 + d + (d > 0)::INT + (k % 6 = 0)::INT AS back FROM p) """
# h: the line of _hidden
C = "WITH s AS (SELECT s_suppkey AS k, s_suppkey // 2 AS b, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS x, (s_suppkey > 0)::INT + (s_suppkey % 10 = 0)::INT + (s_suppkey % 4 = 0)::INT AS h FROM supplier) "
M, M2, MS = "'pkg/m_' || k || '.py'", "'pkg2/c_' || k || '.py'", "'app/s_' || k || '.py'"


@query("SELECT tag, n FROM (SELECT 'file' AS tag, count(*) AS n FROM part UNION ALL SELECT 'def', count(*) FROM part UNION ALL SELECT 'param', 2 * count(*) FROM part UNION ALL SELECT 'import', count(*) + count(*) FILTER (p_partkey > 0) + count(*) FILTER (p_partkey % 5 = 0 AND p_partkey + 1 < (SELECT count(*) FROM part)) + count(*) FILTER (p_partkey % 4 = 0) FROM part UNION ALL SELECT 'attr', count(*) FROM part UNION ALL SELECT 'call', 2 * count(*) + count(*) FILTER (p_partkey % 6 = 0) FROM part)")
def s2_extract_facts(spark, d):
    return facts.extract_facts(V.rendered(spark, d), ("file", "def", "param", "import", "attr", "call")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT 'pkg/m_' || p_partkey || '.py' AS path, 0 AS line FROM part WHERE p_partkey % 9 = 0")
def s3_syntax_errors(spark, d):
    broken = V.rendered(spark, d).withColumn("content", F.when(F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 9 == 0, "def (").otherwise(F.col("content")))
    return facts.syntax_errors(facts.extract_facts(broken, ("failure",))).select("path", "line")


@query(K + f"SELECT {M} AS path, 'f_' || k AS name, CAST(1 + d AS BIGINT) AS cyclomatic, CAST(d * (d + 1) // 2 AS BIGINT) AS cognitive, CAST(d AS BIGINT) AS nesting, CAST(2 + d + (d > 0)::INT + (k % 6 = 0)::INT AS BIGINT) AS loc, CAST(2 AS BIGINT) AS n_params FROM p")
def a2_function_metrics(spark, d):
    return aggs.function_metrics(_facts(spark, d, "node")).select("path", "name", "cyclomatic", "cognitive", "nesting", "loc", "n_params")


@query(K + f"SELECT {M} AS path, k % 3 = 0 AS returns, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS annotated, 2 AS params FROM p")
def a4_type_coverage(spark, d):
    f = _facts(spark, d, "def", "param")
    params = facts.of(f, "param").filter("role = ''").groupBy("path").agg(F.count_if("annotated").alias("annotated"), F.count("*").alias("params"))
    return facts.of(f, "def").filter("kind = 'function'").select("path", F.col("annotated").alias("returns")).join(params, "path")


@query(K + f"SELECT {M} AS path, 'f_' || k AS name, start AS line, k % 3 <> 0 AS no_return, CASE WHEN k % 2 = 0 THEN 'b' ELSE 'a,b' END AS params FROM p")
def a4_missing_annotations(spark, d):
    return aggs.missing_annotations(_facts(spark, d, "def", "param")).select("path", "name", "line", "no_return", "params")


@query(K + f"SELECT count(*) AS functions, count(*) FILTER (k % 3 = 0) AS returns, 2 * count(*) AS params, count(*) FILTER (k % 2 = 0) AS annotated, {HALF('100 * (count(*) FILTER (k % 3 = 0) + count(*) FILTER (k % 2 = 0))', '3 * count(*)', 1)} AS pct FROM p")
def a4_annotation_summary(spark, d):
    return aggs.annotation_summary(_facts(spark, d, "def", "param"))


@query(K + f", g AS (SELECT d, k % 6 = 0 AS e, count(*) AS n FROM p WHERE 2 + d + (d > 0)::INT + (k % 6 = 0)::INT >= 3 GROUP BY d, k % 6 = 0 HAVING count(*) >= 2) SELECT g.n, {M} AS item FROM p JOIN g ON p.d = g.d AND (k % 6 = 0) = e")
def a5_duplicate_functions(spark, d):
    # the callee's name is blanked like every other, so a body's shape depends on its nesting and its eval alone
    bodies = facts.extract_facts(V.rendered(spark, d), ("body",)).withColumn("n_lines", F.col("end_line") - F.col("line") + 1)
    return aggs.duplicates(graph.checkpoint(bodies.select("path", "text", "n_lines")), "text", "path", 3, "n_lines").select("n", "item")


@query(K + f"""SELECT {M} AS path, back - 1 AS line, 'SEC001' AS rule_id, 'high' AS severity, 'Use of eval() can execute arbitrary code' AS message, 'eval(''1'')' AS snippet FROM q WHERE k % 6 = 0 UNION ALL SELECT {MS}, 20, r, s, m, 'return ' || c FROM (SELECT s_suppkey AS k FROM supplier) x
JOIN (VALUES (0, 'SEC020', 'high', 'pickle.loads() can execute arbitrary code during deserialization', 'pickle.loads(self)'), (1, 'SEC030', 'high', 'subprocess.run() with shell=True is vulnerable to injection', 'subprocess.run(self, shell=True)'), (3, 'SEC022', 'medium', 'yaml.load() without SafeLoader can execute arbitrary code', 'yaml.load(self)'), (4, 'SEC002', 'high', 'Use of exec() can execute arbitrary code', 'exec(self)')) t(i, r, s, m, c) ON k % 6 = i""")
def a6_call_rules(spark, d):
    files = V.rendered(spark, d).union(V.rendered_scopes(spark, d))
    return code.call_rules(facts.extract_facts(files, ("call",))).select("path", "line", "rule_id", "severity", "message", "snippet")


@query(C + f"SELECT {M2} AS path, 'C_' || k AS name FROM s UNION ALL SELECT {M2}, 'make_' || k FROM s WHERE k % 4 <> 0")
def a8_public_api(spark, d):
    return code.public_names(_class_facts(spark, d, "def", "export")).select("path", "name")


@query(C + f"""SELECT 'star_import' AS pattern, {M2} AS path, (k > 0)::INT AS line FROM s WHERE k % 10 = 0 UNION ALL SELECT 'call:inner', {MS}, 10 FROM s UNION ALL SELECT 'attr_call:any.loads', {MS}, 20 FROM s WHERE k % 6 IN (0, 5) UNION ALL SELECT 'except:OSError', {MS}, 11 FROM s WHERE k % 2 = 1
UNION ALL SELECT 'Except', {MS}, 11 FROM s UNION ALL SELECT 'assert', {MS}, 19 FROM s UNION ALL SELECT 'RAISE', {MS}, 12 FROM s""")
def f10_structural_search(spark, d):
    f = facts.extract_facts(V.rendered_classes(spark, d).union(V.rendered_scopes(spark, d)), ("node", "call", "import"), columns=code.SEARCHED)
    patterns = ("star_import", "call:inner", "attr_call:any.loads", "except:OSError", "Except", "assert", "RAISE", "yield", "global", "decorator:mark")
    return code.structural_searches(f, {p: p for p in patterns}).select("pattern", "path", "line")


@query(K + f"""SELECT 'if in if' AS pattern, {M} AS path, start + i AS line FROM p, range(2, 4) t(i) WHERE i <= d UNION ALL SELECT 'outer if', {M}, start + 1 FROM p WHERE d >= 2 UNION ALL SELECT 'lone if', {M}, start + 1 FROM p WHERE d = 1
UNION ALL SELECT 'eval beside if', {M}, back - 1 FROM q WHERE k % 6 = 0 AND d > 0 UNION ALL SELECT 'import without eval', {M}, 0 FROM p WHERE k % 6 <> 0
UNION ALL SELECT pattern, {MS}, line FROM (SELECT s_suppkey AS k FROM supplier) x JOIN (VALUES ('raise in OSError', 12, 2, 1), ('call in try', 10, 1, 0), ('method', 18, 1, 0), ('plain function', 7, 1, 0), ('class that asserts', 15, 1, 0)) t(pattern, line, m, r) ON k % m = r
UNION ALL SELECT 'loads in class that asserts', {MS}, 20 FROM (SELECT s_suppkey AS k FROM supplier) x WHERE k % 6 IN (0, 5)""")
def f10_structural_conditions(spark, d):
    f = facts.extract_facts(V.rendered(spark, d).union(V.rendered_scopes(spark, d)), ("node", "call"), columns=code.SEARCHED)
    kind, shape = lambda x: F.col("kind") == x, code.Shape
    branch, asserting = kind("If"), shape(kind("ClassDef"), (("has", "assert"),))
    module = lambda axis: shape(kind("Module"), ((axis, "call:eval"), ("not has", kind("AsyncFunctionDef"))))
    patterns = {
        "if in if": shape(branch, (("inside", branch),)),
        "outer if": shape(branch, (("not inside", branch), ("has", branch))),
        "lone if": shape(branch, (("not inside", branch), ("not parent of", branch))),
        "eval beside if": shape("call:eval", (("inside", shape(kind("FunctionDef"), (("has", branch),))),)),
        "import without eval": shape(kind("Import") & (F.col("line") == 0), (("child of", module("not has")),)),
        "raise in OSError": shape("raise", (("child of", "except:OSError"),)),
        "call in try": shape("call:inner", (("inside", kind("Try")), ("not inside", kind("ClassDef")))),
        "method": shape(kind("FunctionDef"), (("child of", kind("ClassDef")),)),
        "plain function": shape(kind("FunctionDef"), (("not child of", kind("ClassDef")), ("inside", kind("AsyncFunctionDef")))),
        "class that asserts": asserting,
        "loads in class that asserts": shape("attr_call:any.loads", (("inside", asserting),)),
    }
    return code.structural_searches(f, patterns).select("pattern", "path", "line")


@query(K + "SELECT 'pkg.m_' || k AS src, 'os' AS dst, false AS resolved FROM p UNION ALL SELECT 'pkg.m_' || k, 'json', false FROM p WHERE k % 4 = 0 UNION ALL SELECT 'pkg.m_' || k, 'pkg.m_' || j, true FROM p WHERE k > 0 UNION ALL SELECT 'pkg.m_' || k, 'pkg.m_' || (k + 1), true FROM p WHERE k % 5 = 0 AND k + 1 < n")
def g1_g2_dependency_graph(spark, d):
    return code.dependency_graph(_facts(spark, d, "file", "import")).select("src", "dst", "resolved")


AT_ROOT = "(SELECT k, CASE WHEN k % 10 = 5 THEN 'src/' ELSE '' END AS root FROM p UNION ALL SELECT k, 'src/' FROM p WHERE k % 10 = 0)"


@query(K + f", f AS {AT_ROOT}, e AS (SELECT k, j FROM p WHERE k > 0 UNION SELECT k, k + 1 FROM p WHERE k % 5 = 0 AND k + 1 < n) SELECT root || 'pkg/m_' || e.k || '.py' AS src, CASE WHEN j % 10 = 5 THEN 'src/' ELSE '' END || 'pkg/m_' || j || '.py' AS dst FROM e JOIN f ON f.k = e.k")
def g1_roots_in_order(spark, d):
    """Every tenth module lies in src alone, and another tenth in src too."""
    files = V.rendered(spark, d)
    k = F.regexp_extract("path", "([0-9]+)[.]py", 1).cast("long") % 10
    inner = F.concat(F.lit("src/"), "path")
    files = files.withColumn("path", F.when(k == 5, inner).otherwise(F.col("path"))).union(files.filter(k == 0).withColumn("path", inner))
    return code.dependency_files(_stored(files, "file", "import")).select("src", "dst")


@query("SELECT 'pkg.m_' || p_partkey AS v FROM part")
def g2_vertices(spark, d):
    return code.vertices(facts.extract_facts(V.rendered(spark, d), ("file",))).select("v")


LAYER = "CASE WHEN {0} IN (0, 3, 4) THEN 0 WHEN {0} IN (1, 9, 10, 11) THEN 1 WHEN {0} IN (2, 5, 30) THEN 2 END"


@query(K + f", e AS (SELECT k AS a, j AS b FROM p WHERE k > 0 UNION SELECT k, k + 1 FROM p WHERE k % 5 = 0 AND k + 1 < n) SELECT 'pkg.m_' || a AS src, 'pkg.m_' || b AS dst, {LAYER.format('a')} AS src_layer, {LAYER.format('b')} AS dst_layer FROM e WHERE {LAYER.format('a')} > {LAYER.format('b')}")
def g5_declared_layers(spark, d):
    f = _facts(spark, d, "file", "import")
    layers = [[f"m_{i}" for i in names] for names in ((0, 3, 4), (1, 9, 10, 11), (2, 5, 30))]
    return graph.layer_violations(code.dependency_graph(f).select("src", "dst").distinct(), graph.assign_layers(code.vertices(f), layers))


@query(K.replace("WITH", "WITH RECURSIVE", 1) + ", w AS (SELECT k AS root, k AS node, 0 AS depth FROM p UNION ALL SELECT root, node // 3, depth + 1 FROM w WHERE depth < 3) SELECT 'pkg/m_' || root || '.py:f_' || root AS root, 'pkg/m_' || node || '.py:f_' || node AS node, min(depth) AS depth FROM w WHERE node <> root GROUP BY w.root, w.node")
def g6_call_hierarchy(spark, d):
    f = _facts(spark, d, *code.CALLING, columns=code.CALLED, outer=True)
    edges = graph.checkpoint(code.call_edges(f).select("src", "dst"))
    return graph.traverse(edges, edges.select(F.col("src").alias("root")).distinct(), "callees", 3).select("root", "node", "depth")


@query(K + f"SELECT {M} AS path, 'json' AS name FROM p WHERE k % 4 = 0 UNION ALL SELECT {M}, 'f_' || (k + 1) FROM p WHERE k % 5 = 0 AND k + 1 < n AND k + 1 <> j")
def j14_unused_imports(spark, d):
    return code.unused_imports(_facts(spark, d, "import", "use", "export")).select("path", "name")


@query(K + f"SELECT {M} AS path, 'g' AS name FROM p WHERE k % 8 = 0 UNION ALL SELECT 'app/s_' || s_suppkey || '.py', 'name' FROM supplier")
def j15_unresolved_names(spark, d):
    more = V.rendered(spark, d).withColumn("content", F.concat("content", F.when(F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 8 == 0, "print(g)\n").otherwise("")))
    return code.unresolved_names(_stored(more.union(V.rendered_scopes(spark, d)), *NAMES)).select("path", "name")


@query(K + f"""SELECT {M} AS path, 'a' AS name, start + i AS line, {M} AS def_path, start AS def_line, 'param' AS kind FROM q, range(1, 4) t(i) WHERE i <= d UNION ALL SELECT {M}, unnest(['a', 'b']), back, {M}, start, 'param' FROM q
UNION ALL SELECT {M}, 'os', back, {M}, 0, 'import' FROM q UNION ALL SELECT 'pkg/m_' || q.k || '.py', 'f_' || q.j, q.back, 'pkg/m_' || q.j || '.py', f.start, 'def' FROM q JOIN p f ON f.k = q.j""")
def j7_goto_definition(spark, d):
    return code.goto_definition(_facts(spark, d, *NAMES, columns=code.NAMED)).select("path", "name", "line", "def_path", "def_line", "kind")


@query(C + f"""SELECT {MS} AS path, name, line, {MS} AS def_path, def_line FROM s, (VALUES ('limit', 6, 4), ('path', 8, 7), ('limit', 8, 6), ('inner', 10, 7), ('path', 10, 6), ('app', 10, 0), ('near', 10, 1), ('near', 14, 1), ('limit', 19, 4), ('self', 20, 18)) t(name, line, def_line)
UNION ALL SELECT {MS}, 'self', 20, {MS}, 18 FROM s WHERE k % 6 = 5 UNION ALL SELECT {MS}, CASE k % 6 WHEN 0 THEN 'pickle' WHEN 3 THEN 'yaml' ELSE 'subprocess' END, 20, {MS}, 2 FROM s WHERE k % 6 < 4
UNION ALL SELECT {MS}, 'load_' || x, 10, 'app/s_' || x || '.py', 6 FROM s UNION ALL SELECT {MS}, 'Keep_' || x, 10, 'app/s_' || x || '.py', 15 FROM s""")
def j7_scopes(spark, d):
    return code.goto_definition(_scope_facts(spark, d, *NAMES)).select("path", "name", "line", "def_path", "def_line")


REFERENCES = """, r AS (SELECT j AS f, k, back AS line FROM q UNION ALL SELECT j, k, 1 FROM q WHERE k > 0 UNION ALL SELECT k + 1, k, 1 + (k > 0)::INT FROM q WHERE k % 5 = 0 AND k + 1 < n UNION ALL SELECT k, k, start FROM q),
t AS (SELECT *, count(*) OVER (PARTITION BY f) AS total, row_number() OVER (PARTITION BY f ORDER BY 'pkg/m_' || k || '.py', line) AS i FROM r) """


@query(K + REFERENCES + f"SELECT 'pkg/m_' || f || '.py' AS def_path, 'f_' || f AS name, {M} AS path, line, total, total > 3 AS truncated FROM t WHERE i <= 3")
def j8_find_references(spark, d):
    found = code.find_references(_facts(spark, d, *NAMES, columns=code.NAMED), include_declaration=True, limit=3)
    return found.filter("startswith(name, 'f_')").select("def_path", "name", "path", "line", "total", "truncated")


@query(K + REFERENCES + ", u AS (SELECT * FROM t JOIN p ON p.k = t.f WHERE NOT (t.k = t.f AND line = start)) SELECT 'pkg/m_' || f || '.py' AS def_path, 'f_' || f AS name, count(*) AS uses, count(DISTINCT u.k) AS files FROM u GROUP BY f")
def j8_reference_counts(spark, d):
    return code.reference_counts(_facts(spark, d, *NAMES, columns=code.NAMED)).filter("startswith(name, 'f_')").select("def_path", "name", "uses", "files")


@query(C + f"SELECT {M2} AS path, h + 9 AS line, 'write' AS kind FROM s UNION ALL SELECT {M2}, h + 10 + (k % 10 = 0)::INT, 'read' FROM s")
def j9_highlights(spark, d):
    return code.highlights(_class_facts(spark, d, "use"), F.lit("obj")).select("path", "line", "kind")


@query(C + "SELECT 'C_' || k AS owner, unnest(['m0', 'm1', 'p_' || (k % 5)]) AS name FROM s UNION ALL SELECT 'make_' || k, 'obj' FROM s")
def j5_sub_definitions(spark, d):
    return code.sub_definitions(_class_facts(spark, d, "def")).select("owner", "name")


@query(C + f"SELECT {M2} AS path, unnest(['_hidden', 'C_' || k, 'm0', 'm1', 'p_' || (k % 5), 'make_' || k, 'obj']) AS name FROM s UNION ALL SELECT {M2}, '__all__' FROM s WHERE k % 4 = 0")
def j6_all_names(spark, d):
    return code.all_names(_class_facts(spark, d, "def")).select("path", "name")


@query(C + f"""SELECT {M2} AS path, name, false AS is_definition FROM s, (VALUES ('_hidden'), ('x'), ('x'), ('self'), ('obj'), ('obj'), ('v')) t(name) UNION ALL SELECT {M2}, unnest(['C_' || k, 'C_' || k, 'C_' || k]), false FROM s UNION ALL SELECT {M2}, 'C_' || b, false FROM s WHERE k > 0
UNION ALL SELECT {M2}, unnest(['make_' || x, 'v']), false FROM s WHERE k % 10 = 0 UNION ALL SELECT {M2}, '__all__', false FROM s WHERE k % 4 = 0 UNION ALL SELECT {M2}, 'int', false FROM s WHERE k % 2 = 0""")
def j6_names_with_references(spark, d):
    return code.all_names(_class_facts(spark, d, "def", "use"), references=True).filter("not is_definition").select("path", "name", "is_definition")


@query(C.replace("WITH", "WITH RECURSIVE") + ", r AS (SELECT k AS cls, b AS base FROM s WHERE k > 0 UNION SELECT cls, s.b FROM r JOIN s ON base = k WHERE k > 0) SELECT 'C_' || base AS base, 'C_' || cls AS cls FROM r")
def j10_find_implementations(spark, d):
    f = _class_facts(spark, d, *NAMES, "base")
    return code.find_implementations(f, graph.reach_index(code.class_links(code.class_edges(f))), "m0").select("base", "cls")


@query(C + f"SELECT {M2} AS path, 'v' AS name, 'C_' || k AS cls FROM s")
def j11_type_definition(spark, d):
    return code.type_definition(_class_facts(spark, d, *NAMES, "typed")).select("path", "name", "cls")


@query(f"SELECT path, name, CASE WHEN own THEN 'T_' || k ELSE 'T_' || x END AS cls, 'pkg3/t_' || CASE WHEN own THEN k ELSE x END || '.py' AS def_path FROM ({V.TYPED}), (VALUES ('a', false), ('b', false), ('c', true), ('d', false), ('g', true), ('own', true)) t(name, own)")
def j11_named_types(spark, d):
    return code.type_definition(_stored(V.rendered_typed(spark, d), *NAMES, "typed")).select("path", "name", "cls", "def_path")


@query(C + "SELECT 'C_' || k AS name, 2 AS annotation, (SELECT count(*) FROM s c WHERE c.k >= 1 AND c.b = s.k) AS subclass, 1 AS instantiation, (SELECT count(*) FROM s c WHERE c.k >= 1 AND c.b = s.k) AS other FROM s")
def j12_type_user_counts(spark, d):
    return code.type_user_counts(_class_facts(spark, d, *NAMES)).select("name", "annotation", "subclass", "instantiation", "other")


@query(C + f"SELECT 'C_' || k AS name, {M2} AS path, h + 8 AS line, 'annotation' AS kind FROM s, range(2) UNION ALL SELECT 'C_' || b, {M2}, h + 1, 'subclass' FROM s WHERE k > 0 UNION ALL SELECT 'C_' || b, {M2}, 0, 'other' FROM s WHERE k > 0")
def j12_type_users(spark, d):
    return code.type_users(_class_facts(spark, d, *NAMES), ["annotation", "subclass", "other"]).select("name", "path", "line", "kind")


@query(C + "SELECT 'C_' || k AS cls, 'v;size=' || k AS args FROM s")
def j13_constructor_sites(spark, d):
    return code.constructor_sites(_class_facts(spark, d, *NAMES, "call")).select("cls", F.array_join("args", ";").alias("args"))


@query(C.replace("WITH", "WITH RECURSIVE") + ", r AS (SELECT k AS root, k AS node, 0 AS depth FROM s UNION ALL SELECT root, s.b, depth + 1 FROM r JOIN s ON node = k WHERE k > 0 AND depth < 3) SELECT 'C_' || root AS root, 'C_' || node AS node, depth FROM r WHERE depth > 0 AND root <> node")
def g7_type_hierarchy(spark, d):
    f = _class_facts(spark, d, *NAMES, "base")
    links = graph.checkpoint(code.class_links(code.class_edges(f)))
    roots = links.select(F.col("src").alias("root")).union(links.select("dst")).distinct()
    return graph.type_hierarchy(links, roots).select("root.name", "node.name", "depth").toDF("root", "node", "depth")


@query(f"WITH RECURSIVE e AS ({V.BASES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def g7_reachability(spark, d):
    """All supertypes of all classes by the index, rings and second bases included."""
    index = graph.reach_index(V.view(spark, d, V.BASES))
    nodes = index.labels.select("node")
    return graph.reached(index, nodes, nodes)


def _edited(files, found):
    """path and text of files after edits."""
    numbered = found.withColumn("seq", F.lit(0))
    return edits.apply_edits(files, numbered, "path", "content").select("path", F.col("content").alias("text"), "rejected")


@query(rf"SELECT path, regexp_replace(content, '\bf_2\b', 'g_2', 'g') AS text, false AS rejected FROM ({V.MODULES})")
def e5_rename_text(spark, d):
    files = V.rendered(spark, d)
    renames = spark.createDataFrame([("r0", "pkg.m_2", "f_2", "g_2")], "repo string, module string, old string, new string")
    return _edited(files, code.rename_edits(_stored(files, *NAMES), renames))


L = f"WITH l AS ({V.LINKED}) "


def _linked_facts(spark, d):
    return _stored(V.rendered_linked(spark, d), *NAMES)


@query(L + "SELECT path, 'f_' || b AS name, CASE WHEN k = b + 7 THEN 4 ELSE 1 END AS line, 'lnk/d_' || CASE WHEN k < b + 7 THEN b ELSE b + 7 END || '.py' AS def_path, CASE WHEN k < b + 7 THEN 0 ELSE 1 END AS def_line FROM l WHERE k <> b")
def j7_reexports(spark, d):
    return code.goto_definition(_linked_facts(spark, d)).select("path", "name", "line", "def_path", "def_line")


@query(L + "SELECT path, CASE WHEN b % 20 = 0 AND k < b + 7 THEN replace(content, 'f_' || b, 'g_' || b) WHEN b % 20 = 0 AND k = b + 7 THEN replace(content, 'import f_' || b, 'import g_' || b || ' as f_' || b) ELSE content END AS text, false AS rejected FROM l")
def e5_rename_reexports(spark, d):
    firsts = V.table(spark, d, "supplier").filter("s_suppkey % 20 = 0")
    renames = firsts.selectExpr("'r0' AS repo", "'lnk.d_' || s_suppkey AS module", "'f_' || s_suppkey AS old", "'g_' || s_suppkey AS new")
    return _edited(V.rendered_linked(spark, d), code.rename_edits(_linked_facts(spark, d), renames))


@query(rf"""SELECT path, replace(regexp_replace(content, '\bT_1\b', 'Kind', 'g'), 'Literal["Kind"]', 'Literal["T_1"]') AS text, false AS rejected FROM ({V.TYPED})""")
def e5_rename_in_strings(spark, d):
    """A class's new name in annotations, those in strings included, but not in literals."""
    files = V.rendered_typed(spark, d)
    renames = spark.createDataFrame([("r0", "pkg3.t_1", "T_1", "Kind")], "repo string, module string, old string, new string")
    return _edited(files, code.rename_edits(_stored(files, *NAMES), renames))


@query(L + "SELECT path, CASE WHEN k <> b AND k <> b + 7 THEN replace(content, '*', 'f_' || b) ELSE content END AS text, false AS rejected FROM l")
def e6_expand_reexported_star(spark, d):
    return _edited(V.rendered_linked(spark, d), code.star_edits(_linked_facts(spark, d)))


@query(L + "SELECT 'f_' || a.b AS name, count(c.k) AS files, array_to_string(list(c.path ORDER BY c.path) FILTER (c.k IS NOT NULL), ',') AS paths, count(c.k) > 0 AS covered FROM l a LEFT JOIN l c ON c.k BETWEEN a.b + 1 AND a.b + 7 WHERE a.k = a.b GROUP BY a.b")
def a7_code_coverage(spark, d):
    """Files other than its own that come to use each function, through all that hands it on."""
    defs, refs = code.symbol_refs(_linked_facts(spark, d))
    found = aggs.test_coverage(graph.checkpoint(defs), refs.filter("external = 1"))
    return found.select("sym.name", F.col("test_files").cast("long").alias("files"), F.array_join("files", ",").alias("paths"), "covered")


@query(K + f"SELECT {M} AS path, 'f_' || k AS name, 'no references' AS reason, 'medium' AS confidence FROM p WHERE k NOT IN (SELECT j FROM p WHERE k > 0) AND NOT (k > 0 AND (k - 1) % 5 = 0)")
def j16_code_dead(spark, d):
    defs, refs = code.symbol_refs(_facts(spark, d, *NAMES))
    return joins.dead_code(defs, refs).select("sym.path", "name", "reason", "confidence")


@query(C.replace("WITH", "WITH RECURSIVE") + ", r AS (SELECT k AS cls, b AS base FROM s WHERE k > 0 UNION SELECT cls, s.b FROM r JOIN s ON base = k WHERE k > 0) SELECT 'r0' AS repo, 'C_' || base AS base, 'C_' || cls AS cls FROM r UNION ALL SELECT 'r1', 'C_' || base, 'C_' || cls FROM r WHERE cls % 2 = 0")
def j10_two_repos(spark, d):
    """Classes of one name in two repos; in the second only even ones have the method."""
    files = V.rendered_classes(spark, d)
    odd = F.regexp_extract("path", "([0-9]+)[.]py", 1).cast("long") % 2 == 1
    other = files.select(F.lit("r1").alias("repo"), "path", F.when(odd, F.replace("content", F.lit("def m0"), F.lit("def n0"))).otherwise(F.col("content")).alias("content"))
    f = _stored(files.union(other), *NAMES, "base")
    return code.find_implementations(f, graph.reach_index(code.class_links(code.class_edges(f))), "m0").select("repo", "base", "cls")


@query(rf"SELECT path, CASE WHEN k = 1 THEN replace(replace(replace(t, 'limit: int', 'bound: int'), 'limit=limit', 'limit=bound'), 'assert limit', 'assert bound') ELSE t END AS text, false AS rejected FROM (SELECT k, path, regexp_replace(content, '\bload_1\b', 'fetch', 'g') AS t FROM ({V.SCOPES}))")
def e5_rename_in_scopes(spark, d):
    files = V.rendered_scopes(spark, d)
    renames = spark.createDataFrame([("r0", "app.s_1", "load_1", "fetch"), ("r0", "app.s_1", "limit", "bound")], "repo string, module string, old string, new string")
    return _edited(files, code.rename_edits(_stored(files, *NAMES), renames))


@query(f"SELECT path, replace(content, 'import *', 'import make_' || ((k + 1) % (SELECT count(*) FROM supplier))) AS text, false AS rejected FROM ({V.CLASSES})")
def e6_expand_star(spark, d):
    files = V.rendered_classes(spark, d)
    return _edited(files, code.star_edits(_stored(files, "def", "export", "use", "import")))


@query(f"SELECT path, replace(content, 'from .c_', 'from pkg2.c_') AS text, false AS rejected FROM ({V.CLASSES})")
def e7_absolutize(spark, d):
    files = V.rendered_classes(spark, d)
    return _edited(files, code.absolute_edits(_stored(files, "import")))


@query(C + f"""SELECT {M2} AS path, h + lo AS first, h + hi + more * (k % 10 = 0)::INT AS last, 'region' AS fold FROM s, (VALUES (1, 7, 0), (2, 3, 0), (4, 5, 0), (6, 7, 0), (8, 10, 1)) t(lo, hi, more) UNION ALL SELECT {M2}, 0, 1, 'imports' FROM s WHERE k > 0 AND k % 10 = 0""")
def w1_folding_ranges(spark, d):
    return code.folding_ranges(_class_facts(spark, d, "node")).select("path", "first", "last", "fold")


@query("SELECT repo, CAST(sum(p_size % 4 + 4) AS BIGINT) AS n FROM part, (SELECT unnest(['r0', 'r1']) AS repo) GROUP BY repo")
def u4_several_repos(spark, d):
    f = _stored(V.rendered(spark, d, ("r0", "r1")), *NAMES, columns=code.NAMED)
    return code.goto_definition(f).groupBy("repo").agg(F.count("*").alias("n"))


# --- streams of files and column expressions -----------------------------------------------------------------------
@query(K + f"SELECT {M} AS path, 'f_' || k AS name FROM p UNION ALL SELECT {M}, unnest(['f_' || k, 'x']) FROM p WHERE k % 4 = 0")
def x2_stream_facts(spark, d):
    """Two runs over the files; in the second every fourth is changed and the others come again as they were."""
    folder = f"{graph.shared_folder(spark)}/stream-{uuid4().hex}"
    files = V.rendered(spark, d)
    changed = files.withColumn("content", F.concat("content", F.when(F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 4 == 0, "x = 1\n").otherwise("")))
    for version in (files, changed):
        version.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(files.schema).parquet(f"{folder}/in")
        live.stream_facts(stream, f"{folder}/out", f"{folder}/checkpoint", lambda df: facts.extract_facts(df, ("def",))).awaitTermination()
    return spark.read.parquet(f"{folder}/out/facts").select("path", "name")


@query("SELECT 'u' || CAST(user_id AS VARCHAR) AS path, count(*) FILTER (event_id % 5 <> 0 OR coalesce(last, 0) % 5 <> 0) AS versions, max(event_id) AS last, max_by(event_id % 3, event_id) AS name FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events WHERE event_id % 7 <> 0) x GROUP BY user_id HAVING max_by(event_id % 5, event_id) <> 0")
def x2_file_versions(spark, d):
    """Versions of one file a user that change, bring back or delete it; a deletion of what is not there changes nothing."""
    folder = f"{graph.shared_folder(spark)}/stream-{uuid4().hex}"
    n = F.col("event_id")
    text = F.when(n % 5 != 0, F.concat(F.lit("v_"), (n % 3).cast("string"), F.lit(" = 1\n# "), n.cast("string")))
    log = V.table(spark, d, "events").filter("event_id % 7 <> 0").select(F.lit("r0").alias("repo"), F.concat(F.lit("u"), "user_id").alias("path"), n.alias("version"), text.alias("content"))
    log.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
    live.stream_versions(stream, f"{folder}/out", f"{folder}/checkpoint", lambda df: facts.extract_facts(df, ("def",))).awaitTermination()
    versions = spark.read.parquet(f"{folder}/out/versions").groupBy("path").agg(F.count("*").alias("versions"))
    now = live.current_facts(spark, f"{folder}/out").select("path", F.col("version").alias("last"), F.substring_index("name", "_", -1).cast("long").alias("name"))
    return now.join(versions, "path").select("path", "versions", "last", "name")


CODES = "CAST(event_id % 30 AS INT)"


@query(f"""SELECT event_id AS k, CASE {CODES} WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 4 THEN 'hint' ELSE 'information' END AS severity, CASE event_type WHEN 'error' THEN 1 ELSE 3 END AS code, coalesce({list(scalars.KINDS)!r}[nullif({CODES}, 0)], 'symbol') AS kind,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE '/d e/' || event_id || '+.py' END AS path, event_type AS quoted, CASE WHEN event_id % 2 = 0 THEN event_type END AS quoted_double, CASE event_id % 3 WHEN 0 THEN 'a.b' WHEN 1 THEN 'os,json.x' ELSE '' END AS modules,
event_type NOT IN ('') AND event_id % 2 = 0 AS identifier, event_id % 4 <> 3 AS unknown, CASE WHEN event_id % 2 = 0 THEN 4 ELSE 0 END AS col FROM events""")
def v1_scalars(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    quote = F.when(n % 2 == 0, '"').otherwise("'")
    statement = F.when(n % 3 == 0, "from a.b import c").when(n % 3 == 1, "import os, json.x as j").otherwise("x = 1")
    shown = F.when(n % 4 == 0, " Any ").when(n % 4 == 1, "list[int, Unknown]").when(n % 4 == 2, "").otherwise("int")
    columns = {
        "severity": scalars.severity_name(n % 30), "code": scalars.severity_code(kind), "kind": scalars.symbol_kind(n % 30),
        "path": scalars.uri_path(F.when(n % 3 == 0, "http://x/y").otherwise(F.concat(F.lit("file:///d%20e/"), n.cast("string"), F.lit("+.py")))),
        "quoted": scalars.quoted_name(F.concat(F.lit("name "), quote, kind, quote)), "quoted_double": scalars.quoted_name(F.concat(F.lit("name "), quote, kind, quote), True),
        "modules": F.array_join(scalars.import_modules(statement), ","), "identifier": scalars.is_identifier(F.when(n % 2 == 0, kind).otherwise("1x")),
        "unknown": scalars.unknown_type(shown), "col": scalars.name_column(F.when(n % 2 == 0, F.concat(F.lit("x = "), kind)).otherwise("none"), kind),
    }
    return V.table(spark, d, "events").select(n.alias("k"), *[c.alias(k) for k, c in columns.items()])
