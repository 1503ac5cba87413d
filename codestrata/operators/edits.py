"""Text edits as tables: offsets, application, hints, module names and change logs."""

from __future__ import annotations

import keyword
import re
import sys
from bisect import bisect_right

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BREAK = "\r\n|\r|\n"
RANGES = "array<struct<lo:int,hi:int,ok:boolean>>"


def _starts(text: str) -> list[int]:
    """0-based offset of each line, then the length of the text plus 1."""
    return [0, *(m.end() for m in re.finditer(BREAK, text)), len(text) + 1]


def _offset(starts: list[int], line: int | None, col: int | None) -> int | None:
    """The offset of (line, col), None out of range; (number of lines, 0) is the end of the text."""
    if line is None or col is None or line < 0 or col < 0 or line >= len(starts):
        return None
    if line == len(starts) - 1:
        return starts[-1] - 1 if col == 0 else None
    return starts[line] + col if starts[line] + col < starts[line + 1] else None


def line_starts(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, starts: 0-based offset of each line, then the length of the text plus 1. One pass over each text."""

    @F.pandas_udf("array<int>")
    def starts(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _starts(t) for t in text], dtype=object)

    return files.select(key, starts(content).alias("starts"))


def to_offset(positions: DataFrame, files: DataFrame, key: str, content: str) -> DataFrame:
    """The offset of (line, col), null out of range; (number of lines, 0) is the end of the text.

    A file's positions are put together, so its lines are counted once, whatever their number.
    """
    names = positions.columns
    per = positions.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_p")).join(line_starts(files, key, content), key)
    start, after = (lambda x: F.get("starts", x["line"])), (lambda x: F.get("starts", x["line"] + 1))
    end = F.element_at("starts", -1) - 1
    at = lambda x: F.when((x["line"] == F.size("starts") - 1) & (x["col"] == 0), end).when((x["line"] >= 0) & (x["col"] >= 0) & (start(x) + x["col"] < after(x)), start(x) + x["col"])
    met = per.select(F.explode(F.transform("_p", lambda x: F.struct(x.alias("p"), at(x).alias("offset")))).alias("_x"))
    return met.select("_x.p.*", "_x.offset")


def to_position(offsets: DataFrame, files: DataFrame, key: str, content: str) -> DataFrame:
    """line and col of an offset; null out of range. A file's offsets are put together, and each is a search over its line starts."""

    @F.pandas_udf("array<struct<line:int,col:int>>")
    def place(text: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for t, offsets in zip(text, at):
            starts, rows = _starts(t or ""), []
            for x in offsets:
                k = None if x is None or t is None or not 0 <= x < starts[-1] else bisect_right(starts, int(x), 0, len(starts) - 1) - 1
                rows.append({"line": k, "col": None if k is None else int(x) - starts[k]})
            out.append(rows)
        return pd.Series(out, dtype=object)

    names = offsets.columns
    per = offsets.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_p")).join(files.select(key, F.col(content).alias("_t")), key)
    found = place("_t", F.transform("_p", lambda x: x["offset"].cast("long")))
    return per.select(F.explode(F.arrays_zip(F.col("_p"), found.alias("_r"))).alias("_x")).select("_x._p.*", "_x._r.*")


def end_position(files: DataFrame, key: str, content: str) -> DataFrame:
    parts = F.split(content, BREAK, -1)
    return files.select(key, (F.size(parts) - 1).alias("end_line"), F.length(F.element_at(parts, -1)).alias("end_col"))


def _with_edits(files: DataFrame, edits: DataFrame, key: str, content: str, how: str) -> DataFrame:
    """key, _t (the text) and _e: the file's edits as an array."""
    per = edits.groupBy(key).agg(F.collect_list(F.struct("start_line", "start_col", "end_line", "end_col", "new_text", "seq")).alias("_e"))
    return files.select(key, F.col(content).alias("_t")).join(per, key, how)


def _resolved(text: str, edits) -> list[tuple]:
    """(lo, hi, seq, place in edits, ok) by lo, hi, seq; inverted, overlapping or out-of-range edits are not ok, touching ones are."""
    starts = _starts(text)
    rows = [(_offset(starts, e["start_line"], e["start_col"]), _offset(starts, e["end_line"], e["end_col"]), e["seq"], k) for k, e in enumerate(edits)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2]))
    out, reached = [], 0
    for lo, hi, seq, k in rows:
        out.append((lo, hi, seq, k, lo is not None and hi is not None and reached <= lo <= hi))
        reached = max(reached, hi or 0)
    return out


def resolve_edits(files: DataFrame, edits: DataFrame, key: str, content: str) -> DataFrame:
    """Edits with offsets (lo, hi) and ok: inverted, overlapping or out-of-range edits are not. Touching ones are."""

    @F.pandas_udf(RANGES)
    def resolve(text: pd.Series, edits: pd.Series) -> pd.Series:
        out = []
        for t, e in zip(text, edits):
            rows = sorted(_resolved(t, e), key=lambda r: r[3])
            out.append([{"lo": lo, "hi": hi, "ok": ok} for lo, hi, _, _, ok in rows])
        return pd.Series(out, dtype=object)

    met = _with_edits(files, edits, key, content, "inner")
    rows = met.select(key, F.explode(F.arrays_zip(F.col("_e"), resolve("_t", "_e").alias("_r"))).alias("_x"))
    return rows.select(key, "_x._e.*", "_x._r.*")


def apply_edits(files: DataFrame, edits: DataFrame, key: str, content: str) -> DataFrame:
    """key and the text after its edits (key, range, new_text, seq); inserts at one place come out in reverse order of seq. Files
    without edits come as they are; a file with a bad edit keeps its text and has rejected set.

    Each text is cut once into what stays between edits, so the time grows with its length and the number of its edits.
    """

    @F.pandas_udf("struct<text:string,rejected:boolean>")
    def apply(text: pd.Series, edits: pd.Series) -> pd.DataFrame:
        out = []
        for t, e in zip(text, edits):
            rows = _resolved(t, e) if t is not None else []
            if t is None or not all(r[4] for r in rows):
                out.append((t, True))
                continue
            # by place; inserts at one place from the last in seq to the first, before what replaces text there
            rows.sort(key=lambda r: (r[0], r[1], -r[2]))
            parts, at = [], 0
            for lo, hi, _, k, _ in rows:
                parts += [t[at:lo], e[k]["new_text"] or ""]
                at = hi
            out.append(("".join([*parts, t[at:]]), False))
        return pd.DataFrame(out, columns=["text", "rejected"])

    met = _with_edits(files, edits, key, content, "left")
    done = met.filter("_e is not null").withColumn("_x", apply("_t", "_e")).select(key, F.col("_x.text").alias(content), "_x.rejected")
    return done.unionByName(met.filter("_e is null").select(key, F.col("_t").alias(content), F.lit(False).alias("rejected")))


EDIT = "struct<path:string,start_line:int,start_col:int,end_line:int,end_col:int,new_text:string>"


def normalize_edits(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Distinct edits of JSON payloads, an array of edits or a map of paths to arrays."""
    flat = F.from_json(column, f"array<{EDIT}>")
    by_path = F.from_json(column, f"map<string,array<{EDIT}>>")
    maps = F.flatten(F.transform(F.map_entries(by_path), lambda e: F.transform(e["value"], lambda x: x.withField("path", e["key"]))))
    rows = payloads.select(F.explode(F.when(F.startswith(F.ltrim(column), F.lit("[")), flat).otherwise(maps)).alias("e")).select("e.*")
    return rows.dropDuplicates()


def hints_to_edits(hints: DataFrame) -> DataFrame:
    """Zero-width inserts from hints of kind type: path, line, col, label, pad_left, pad_right."""
    text = F.concat(F.when(F.col("pad_left"), " ").otherwise(""), "label", F.when(F.col("pad_right"), " ").otherwise(""))
    return hints.filter("kind = 'type'").select("path", F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), F.col("col").alias("end_col"), text.alias("new_text"))


def module_rename_plan(files: DataFrame, column: str = "path") -> DataFrame:
    """Files whose name has upper case, their lower-case target, and whether another file has or gets it."""
    target = F.lower(column)
    taken = files.select(column, target.alias("target")).withColumn("n", F.count("*").over(Window.partitionBy("target")))
    return taken.filter(F.col(column) != F.col("target")).select(column, "target", (F.col("n") > 1).alias("collision"))


def as_of(changes: DataFrame, key: str, n_undone: int = 0) -> DataFrame:
    """The last content of each key with the n_undone last changes undone."""
    if n_undone:
        last = changes.orderBy(F.desc("seq")).limit(n_undone).select("seq")
        changes = changes.join(last, "seq", "left_anti")
    return changes.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("content", "seq").alias("content"))


def committed(changes: DataFrame, batches: DataFrame) -> DataFrame:
    return changes.join(batches, "batch", "left_semi")


def change_stacks(log: DataFrame, project: str = "project", block: int = 10_000) -> DataFrame:
    """What each project's log of changes comes to: the log's rows that are changes and still count, with level (their place
    from the bottom of the stack of changes) and state, done or redoable.

    log: project, seq (from 0 on, unique in a project), op (do, undo, redo) and what else a change has. An undo takes the top
    change off, a redo puts the last one taken off back, and a new change ends what could be redone. The log holds what was
    carried out, so no undo of nothing and no redo without an undo are in it.

    A row's depth is the number of changes on the stack after it: a running sum, taken over blocks of `block` numbers and
    then inside them. A change is pushed at its depth and replaces what was there, so of the changes of one depth the last
    counts; those up to the log's last depth are done. Those above can be redone if no change below is younger.
    """
    step = F.when(F.col("op") == "undo", -1).when(F.col("op").isin("do", "redo"), 1).otherwise(F.raise_error(F.concat(F.lit("unknown op "), "op")).cast("int"))
    rows = log.withColumns({"_step": step, "_block": F.floor(F.col("seq") / block)})
    sums = rows.groupBy(project, "_block").agg(F.sum("_step").alias("_sum"))
    before = Window.partitionBy(project).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(project, "_block", "_base")
    inside = Window.partitionBy(project, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("_step").over(inside)).join(sums, [project, "_block"]).withColumn("level", F.col("_in") + F.col("_base"))
    last = rows.groupBy(project).agg(F.max_by("level", "seq").alias("_depth"))
    tops = rows.filter("op = 'do'").groupBy(project, "level").agg(F.max_by(F.struct(*log.columns), "seq").alias("_row"))
    lower = Window.partitionBy(project).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.join(last, project).withColumn("_younger", F.max("_row.seq").over(lower))
    tops = tops.filter((F.col("level") <= F.col("_depth")) | (F.col("_row.seq") > F.coalesce("_younger", F.lit(-1))))
    return tops.select("_row.*", "level", F.when(F.col("level") <= F.col("_depth"), "done").otherwise("redoable").alias("state"))


def check_name(name: str) -> str:
    if not name.isidentifier() or keyword.iskeyword(name):
        raise ValueError(f"{name!r} is not a usable name")
    return name


cloudpickle.register_pickle_by_value(sys.modules[__name__])
