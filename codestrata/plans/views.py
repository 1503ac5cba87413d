"""Bindings of the given tables to the operators' inputs; the SQL texts run in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = """SELECT 'u' || CAST(user_id % 40 AS STRING) AS path, CAST(event_id % 50 AS INT) AS start_line, 0 AS start_col,
 CAST(event_id % 50 AS INT) AS end_line, 1 AS end_col,
 CASE event_type WHEN 'error' THEN ' Error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'hint' WHEN 'view' THEN 'information' ELSE 'fatal' END AS severity,
 event_type AS message, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'c' || CAST(event_id % 6 AS STRING) END AS code, event_id AS seq FROM events"""
#: Two edges from each customer with orders: a directed graph with cycles, trees and a large component.
EDGES = """SELECT src, a % (SELECT count(*) FROM customer) AS dst FROM (SELECT o_custkey AS src, min(o_orderkey) AS a FROM orders GROUP BY o_custkey) x
 UNION SELECT src, b % (SELECT count(*) FROM customer) AS dst FROM (SELECT o_custkey AS src, max(o_orderkey) AS b FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey) y"""
#: Squares leave about half of the parts without any reference.
REFS = """SELECT (l_partkey * l_partkey) % (SELECT count(*) FROM part) AS sym, l_orderkey AS ref_file, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS external FROM lineitem"""
INTERVALS = "SELECT p_brand AS path, p_partkey AS nid, p_partkey AS start_line, p_partkey + p_size * 3 AS end_line FROM part"
POINTS = "SELECT p_brand AS path, p_partkey AS pid, p_partkey + 2 AS line FROM part"
TOKENS = """SELECT user_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS d_line, CAST(event_id % 7 AS INT) AS d_col,
 CAST(event_id % 5 AS INT) AS len, CAST(event_id % 26 AS INT) AS type_idx, CAST(event_id % 1024 AS INT) AS bits FROM events"""
RUNS = "SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('click','view') THEN 1 ELSE 0 END AS is_import FROM events"
LOG = "SELECT event_id AS seq, 'u' || CAST(user_id AS STRING) AS path, event_id % 10 AS batch, event_type AS content FROM events"
NEW = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
 UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 11 = 0"""
EDITS = "SELECT doc_id, 0 AS start_line, 0 AS start_col, 0 AS end_line, 1 AS end_col, 'X' AS new_text, 0 AS seq FROM labels"
DEFS = """SELECT p_partkey AS sym, CASE p_partkey % 12 WHEN 0 THEN 'Logger' WHEN 1 THEN 'test_' || p_name WHEN 2 THEN '__all__' WHEN 3 THEN '__' || p_name WHEN 4 THEN 'TestCase' ELSE p_name END AS name,
 p_size % 10 = 0 AS decorated, p_size % 7 = 0 AS in_test FROM part"""
RULES = (("TXT001", "high", 'token = "[0-9a-f]+"'), ("TXT002", "medium", "[0-9A-Za-z.]+@[0-9A-Za-z.]+"), ("TXT003", "low", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"))
TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")

#: A module for each part row, whose facts have closed forms.
MODULES = """SELECT k, 'pkg/m_' || k || '.py' AS path, 'import os' || chr(10)
 || CASE WHEN k > 0 THEN 'from pkg.m_' || j || ' import f_' || j || chr(10) ELSE '' END
 || CASE WHEN k % 5 = 0 AND k + 1 < n THEN 'from pkg.m_' || (k + 1) || ' import f_' || (k + 1) || chr(10) ELSE '' END
 || CASE WHEN k % 4 = 0 THEN 'import json' || chr(10) ELSE '' END
 || chr(10) || 'def f_' || k || '(a' || CASE WHEN k % 2 = 0 THEN ': int' ELSE '' END || ', b)' || CASE WHEN k % 3 = 0 THEN ' -> int' ELSE '' END || ':' || chr(10)
 || CASE WHEN d > 0 THEN '    if a:' || chr(10) ELSE '' END || CASE WHEN d > 1 THEN '        if a:' || chr(10) ELSE '' END || CASE WHEN d > 2 THEN '            if a:' || chr(10) ELSE '' END
 || CASE WHEN d > 0 THEN repeat('    ', CAST(d + 1 AS INT)) || 'pass' || chr(10) ELSE '' END
 || CASE WHEN k % 6 = 0 THEN '    eval(''1'')' || chr(10) ELSE '' END
 || '    return os.getpid() + f_' || j || '(a, b)' || chr(10) AS content
 FROM (SELECT p_partkey AS k, p_size % 4 AS d, CAST(floor(p_partkey / 3) AS BIGINT) AS j, (SELECT count(*) FROM part) AS n FROM part) x"""
#: A module with nested scopes, attributes, handlers and risky calls for each supplier row.
SCOPES = """SELECT k, 'app/s_' || k || '.py' AS path, 'import app.s_' || x || chr(10) || 'from app import s_' || x || ' as near' || chr(10) || 'import pickle, subprocess, yaml' || chr(10) || chr(10) || 'limit: int = ' || k || chr(10) || chr(10)
 || 'async def load_' || k || '(path, limit=limit):' || chr(10)
 || '    def inner(path):' || chr(10) || '        return path, limit, name' || chr(10)
 || '    try:' || chr(10) || '        return inner(path), app.s_' || x || '.load_' || x || ', near.Keep_' || x || chr(10)
 || '    except ' || CASE WHEN k % 2 = 0 THEN 'ValueError' ELSE 'OSError as error' END || ':' || chr(10) || '        raise' || chr(10) || chr(10)
 || '@near.mark' || chr(10) || 'class Keep_' || k || ':' || chr(10) || '    limit = 2' || chr(10) || chr(10)
 || '    def size(self):' || chr(10) || '        assert limit' || chr(10) || '        return ' || CASE k % 6 WHEN 0 THEN 'pickle.loads(self)' WHEN 1 THEN 'subprocess.run(self, shell=True)' WHEN 2 THEN 'subprocess.run(self, shell=False)' WHEN 3 THEN 'yaml.load(self)' WHEN 4 THEN 'exec(self)' ELSE 'self.pickle.loads(self)' END || chr(10) AS content
 FROM (SELECT s_suppkey AS k, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS x FROM supplier) y"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the given tables, each passed by name."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES if t in sql}
    for t in tables:
        sql = sql.replace(f" {t}", f" {{{t}}}") if f" {t}" in sql else sql
    return spark.sql(sql, **tables)


def _files(rows: DataFrame, repos: tuple[str, ...] = ("r0",)) -> DataFrame:
    return rows.select(F.explode(F.array(*map(F.lit, repos))).alias("repo"), "path", "content")


def rendered(spark: SparkSession, sf_dir: str, repos: tuple[str, ...] = ("r0",)) -> DataFrame:
    """MODULES as files (repo, path, content)."""
    return _files(view(spark, sf_dir, MODULES), repos)


def rendered_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(view(spark, sf_dir, SCOPES))


#: A module with a class for each supplier row.
CLASSES = """SELECT k, 'pkg2/c_' || k || '.py' AS path,
 CASE WHEN k > 0 THEN 'from pkg2.c_' || b || ' import C_' || b || chr(10) ELSE '' END
 || CASE WHEN k % 10 = 0 THEN 'from .c_' || x || ' import *' || chr(10) ELSE '' END
 || CASE WHEN k % 4 = 0 THEN '__all__ = [''C_' || k || ''']' || chr(10) ELSE '' END
 || '_hidden = 1' || chr(10) || 'class C_' || k || CASE WHEN k > 0 THEN '(C_' || b || ')' ELSE '' END || ':' || chr(10)
 || '    def m0(self, x):' || chr(10) || '        return x' || chr(10)
 || '    def m1(self, x' || CASE WHEN k % 3 = 0 THEN ', y' ELSE '' END || ')' || CASE WHEN k % 2 = 0 THEN ' -> int' ELSE '' END || ':' || chr(10) || '        return x' || chr(10)
 || '    def p_' || (k % 5) || '(self):' || chr(10) || '        return self' || chr(10)
 || 'def make_' || k || '(v: C_' || k || ') -> C_' || k || ':' || chr(10) || '    obj = C_' || k || '(v, size=' || k || ')' || chr(10)
 || CASE WHEN k % 10 = 0 THEN '    make_' || x || '(v)' || chr(10) ELSE '' END || '    return obj' || chr(10) AS content
 FROM (SELECT s_suppkey AS k, CAST(floor(s_suppkey / 2) AS BIGINT) AS b, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS x FROM supplier) y"""


def rendered_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(view(spark, sf_dir, CLASSES))


#: Modules in families of ten: the first defines a function, each next one gets it from the one before, by name or by star, and reads it; the
#: eighth gets it in two ways.
LINKED = """SELECT k, b, 'lnk/d_' || k || '.py' AS path, CASE WHEN k = b THEN 'def f_' || b || '():' || chr(10) || '    return ' || k || chr(10)
 WHEN k = b + 7 THEN 'try:' || chr(10) || '    import fast as f_' || b || chr(10) || 'except ImportError:' || chr(10) || '    from lnk.d_' || (k - 1) || ' import f_' || b || chr(10) || 'print(f_' || b || '())' || chr(10)
 ELSE 'from lnk.d_' || (k - 1) || ' import ' || CASE WHEN k % 3 = 0 THEN '*' ELSE 'f_' || b END || chr(10) || 'f_' || b || '()' || chr(10) END AS content
 FROM (SELECT s_suppkey AS k, s_suppkey - s_suppkey % 10 AS b FROM supplier) y"""
#: Rings of 500 parts each (the last of as many as are left), and a part without a ring for each.
RINGS = """SELECT p_partkey AS src, CASE WHEN p_partkey % 500 = 499 OR p_partkey + 1 = (SELECT count(*) FROM part) THEN p_partkey - p_partkey % 500 ELSE p_partkey + 1 END AS dst FROM part
 UNION ALL SELECT p_partkey AS src, p_partkey + 1000000 AS dst FROM part WHERE p_partkey % 500 = 7"""


#: A class hierarchy in the form of a graph: a part's base is its half, every seventh has its third as well, and some neighbours are each other's base.
BASES = """SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst FROM part WHERE p_partkey > 0 AND p_partkey % 7 = 0
 UNION SELECT p_partkey - 1 AS src, p_partkey AS dst FROM part WHERE p_partkey % 10 = 9 UNION SELECT p_partkey AS src, p_partkey - 1 AS dst FROM part WHERE p_partkey % 10 = 9"""


def rendered_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(view(spark, sf_dir, LINKED))


#: Modules whose parameters name classes of their own and of the next module in many ways.
TYPED = """SELECT k, x, 'pkg3/t_' || k || '.py' AS path, 'import pkg3.t_' || x || ' as far' || chr(10) || 'from pkg3.t_' || x || ' import T_' || x || chr(10) || 'class T_' || k || ':' || chr(10) || '    pass' || chr(10)
 || 'def use(a: far.T_' || x || ', b: list[T_' || x || '], c: "T_' || k || '", d: ''dict[str, far.T_' || x || ']'', e: Literal["T_' || k || '"], g: T_' || k || ' | None = None):' || chr(10)
 || '    own: "list[T_' || k || ']" = [g]' || chr(10) || '    return own' || chr(10) AS content FROM (SELECT s_suppkey AS k, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS x FROM supplier) y"""


def rendered_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(view(spark, sf_dir, TYPED))
