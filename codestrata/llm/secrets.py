"""Secret scans by base patterns and sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidate strings for entropy: whole runs of 20 or more that have a letter.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Character classes of whole candidates, the first that fits, and the least entropy in bits of a window: hexadecimal digits of one case;
#: letters and signs without a digit, which long names and paths are too; base 64; and with _ or - what slugs are made of as well.
CLASSES = (("hex", "^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("letters", "^[^0-9]+$", 4.0), ("base64", "^[A-Za-z0-9+/]+=*$", 3.7), ("slug", "", 3.9))
#: Values that are known not to be secrets, as wholes: made of filling words and rows of letters or digits, or marked as examples at their end.
ALLOW = r"(?i)^(?:[+/_=x-]|example|sample|placeholder|changeme|dummy|insert|replace|your|my|test|api|access|key|token|secret|password|here|0123456789|1234567890|abcdefghijklmnopqrstuvwxyz|abcdef)++$|(?-i:EXAMPLE(?:KEY)?$)"
KINDS = ("assign", "access", "hex", "entropy")
NONE = "cast(array() as array<struct<start:int,end:int,kind:int,value:string>>)"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda an expression is computed anew at every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(pattern: str, kind: int, group: int = 0, least: int = 0, slab: int = 64) -> Column:
    """The matches as structs (start, end, kind, value): code points of what lies between matches and of the matches are summed up.

    Sums run inside slabs of `slab` matches and over slabs, so that arrays that grow stay short in texts of many matches.
    """
    text, p = F.col("text"), F.lit(pattern)
    whole, value, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)), F.split(text, pattern, -1)
    sizes = F.transform(F.arrays_zip(whole.alias("w"), value.alias("v"), gaps.alias("g")), lambda x: F.struct(F.length(x["w"]).alias("w"), F.length(x["g"]).alias("g"), x["v"].alias("v")))

    def spans(parts):
        n = F.size(parts) - 1  # the last gap has no match behind it
        slabs = F.transform(F.sequence(F.lit(0), F.greatest((n - 1) / slab, F.lit(0)).cast("int")), lambda i: F.slice(parts, i * slab + 1, F.least(F.lit(slab), n - i * slab)))
        long = F.transform(slabs, lambda q: F.aggregate(q, F.lit(0), lambda a, x: a + x["w"] + x["g"]))
        firsts = F.aggregate(long, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def step(acc, x):
            begin = acc["at"] + x["g"]
            end = begin + x["w"]
            span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
            return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        each = F.zip_with(slabs, firsts, lambda q, at: F.aggregate(q, F.struct(at.alias("at"), F.expr(NONE).alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(each)

    return F.when(F.regexp_like(text, p), _bound(sizes, lambda parts: F.when(F.size(parts) > 1, spans(parts)).otherwise(F.expr(NONE)))).otherwise(F.expr(NONE))


def _dense(span: Column) -> Column:
    """The parts of a candidate that windows of enough entropy cover, each from its first window's start to its last one's end.

    One pass keeps the count of each character in the window and the sum of c * log2(c), in millionths, which the
    character that comes and the one that goes change by a table's difference; its time grows with the candidate's length.
    """
    table = F.array(*[F.lit(round(c * math.log2(c) * 1e6) if c else 0).cast("long") for c in range(WINDOW + 2)])
    limit = F.coalesce(*[F.when(F.regexp_like(span["value"], F.lit(pattern)), F.lit(round((math.log2(WINDOW) - least) * WINDOW * 1e6))) for _, pattern, least in CLASSES])
    none = F.lit(None).cast("int")
    begin = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).cast("long").alias("s"), none.alias("first"), none.alias("last"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("out"))

    def changed(n, k, by):
        """n with by added to its element k."""
        return F.concat(F.slice(n, F.lit(1), k), F.array(F.get(n, k) + by), F.slice(n, k + 2, F.lit(len(ALPHABET))))

    def closed(acc):
        """The parts, the open one included."""
        return F.when(acc["first"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(acc["out"])

    def step(limit):
        def one(acc, x):
            i, come, go = x["i"], x["come"], x["go"]
            was = F.get(acc["n"], come)
            s = acc["s"] + F.get(table, was + 1) - F.get(table, was)
            # what comes is counted before what goes, also where both are one character
            old = F.get(acc["n"], go) + F.when(come == go, 1).otherwise(0)
            full = i >= WINDOW
            n = changed(acc["n"], come, 1)
            n = F.when(full, changed(n, go, -1)).otherwise(n)
            s = F.when(full, s + F.get(table, old - 1) - F.get(table, old)).otherwise(s)
            hit, start = (i >= WINDOW - 1) & (s <= limit), i - WINDOW + 1
            # a window that does not touch the part before it opens one of its own
            opens = hit & (acc["first"].isNull() | (start > acc["last"]))
            first, last = F.when(opens, start).otherwise(acc["first"]), F.when(hit, i + 1).otherwise(acc["last"])
            return F.struct(n.alias("n"), s.alias("s"), first.alias("first"), last.alias("last"), F.when(opens, closed(acc)).otherwise(acc["out"]).alias("out"))

        return one

    def part(p):
        value = F.substring(span["value"], p["first"] + 1, p["last"] - p["first"])
        return F.struct((span["start"] + p["first"]).cast("int").alias("start"), (span["start"] + p["last"]).cast("int").alias("end"), span["kind"].alias("kind"), value.alias("value"))

    def window(x):
        codes = x["codes"]
        steps = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("come"), F.coalesce(F.get(codes, i - WINDOW), F.lit(0)).alias("go")))
        return F.transform(F.aggregate(steps, begin, step(x["limit"]), closed), part)

    codes = F.transform(F.regexp_extract_all(span["value"], F.lit("(.)"), F.lit(1)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return _bound(F.struct(codes.alias("codes"), limit.alias("limit")), window)


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs' doc_id and secrets: an array of (start, end, kind, value) by start, then kind (an index of KINDS).

    Kinds 0 to 2 are the base patterns' leftmost matches that do not overlap; kind 3 are the parts of a long run with a
    letter that windows of 20 characters with enough entropy for its class cover, unless the whole run is one of ALLOW.
    Offsets are code points, end exclusive. Null or empty text has none; rows are independent, so repeated ids give
    repeated rows; other columns are ignored. One projection: no shuffle, no Python.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.concat(_found(ASSIGN, 0, 2, 6), _found(ACCESS, 1), _found(HEX, 2)).alias("base"), _found(RUN, 3).alias("runs"))
    runs = F.filter("runs", lambda s: ~F.regexp_like(s["value"], F.lit(ALLOW)))
    dense = F.when(F.size("runs") > 0, F.flatten(F.transform(runs, _dense))).otherwise(F.expr(NONE))
    return rows.select("doc_id", _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", dense)).alias("secrets"))


def _ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda s: s["span"])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans written as kind:start:end."""
    names = F.array(*map(F.lit, KINDS))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told("base"), 256).alias("base_sha256"), told("secrets").alias("spans"))
