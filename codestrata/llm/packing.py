"""Packing token sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from bisect import bisect_right
from collections import Counter
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import buckets_of, checkpoint, ship, small_batches

#: Latin-1 letters, then ASCII marks other than the apostrophe, which can join a word's letters.
CASED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a task remembers (some 150 MB at most); the tokenizer alone stays in the worker from task to task.
CACHED = 500_000


def token_pieces(docs: DataFrame, tokenizer: str, end: int = 1, room: int = 4096) -> DataFrame:
    """A row per piece of at most `room` ids. White space never joins two tokens in this vocabulary, so each distinct
    run of other code points is encoded once and whole texts are put together. A run of Latin letters has the ids of its
    lower case, is one word to the tokenizer (so many runs are encoded in one call) and parts from the marks behind it."""

    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept = sys.modules.setdefault("_codestrata_tokens", types.ModuleType("_codestrata_tokens")).__dict__
        if kept.get("path") != tokenizer:
            kept.update(path=tokenizer, encoder=Tokenizer.from_file(tokenizer))
        encoder, seen, stems = kept["encoder"], {b"": b""}, {}
        tail = np.uint32(end).tobytes()

        def learn(words):
            halves = [(w, m[1].lower(), m[2].encode()) for w in words if (m := CASED.fullmatch(w.decode("utf-8")))]
            runs = list(dict.fromkeys([r for _, r, _ in halves if r not in stems]))
            for k in range(0, len(runs), 2000):
                part = runs[k : k + 2000]
                e = encoder.encode(" ".join(part), add_special_tokens=False)
                raw = np.array(e.ids, dtype="<u4").tobytes()
                cuts = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1))).tolist()
                for r, i, j in zip(part, cuts, cuts[1:]):
                    stems[r] = raw[i:j]
            whole = {w for w, _, _ in halves}
            base = [x for x in {*(m for _, _, m in halves), *(w for w in words if w not in whole)} if x not in seen]
            for x, e in zip(base, encoder.encode_batch_fast([x.decode("utf-8") for x in base], add_special_tokens=False)):
                seen[x] = np.array(e.ids, dtype="<u4").tobytes()
            for w, run, marks in halves:
                seen[w] = stems[run] + seen[marks]

        def runs(batch):
            """Documents of some two million bytes together, split into words."""
            held, size = [], 0
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                # bytes.split() splits at the six white-space characters and at nothing else
                held.append((doc, (text or b"").split()))
                size += len(text or b"")
                if size > 2_000_000:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for held in runs(batch):
                if len(seen) > CACHED:
                    seen.clear()
                    seen[b""] = b""
                if len(stems) > CACHED:
                    stems.clear()
                learn(set().union(*(own for _, own in held)).difference(seen))
                for doc, own in held:
                    ids = b"".join(map(seen.__getitem__, own)) + tail
                    for k, at in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[at : at + 4 * room]
                        for name, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on a histogram: (times, lengths in a sequence). Sequences filled alike stay one row."""
    open_, out = {}, []  # room left -> [(times, lengths)]
    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            left = min((r for r in open_ if r >= a), default=None)
            if left is None:
                per = room // a
                for times, k in ((n // per, per), (1 if n % per else 0, n % per)):
                    if times:
                        open_.setdefault(room - a * k, []).append((times, (a,) * k))
                n = 0
                continue
            times, items = open_[left].pop()
            if not open_[left]:
                del open_[left]
            k = max(1, min(left // a, n // times))
            used = min(times, n // k)
            if times > used:
                open_.setdefault(left, []).append((times - used, items))
            if left - a * k:
                open_.setdefault(left - a * k, []).append((used, items + (a,) * k))
            else:
                out.append((used, items + (a,) * k))
            n -= used * k
    return out + [x for xs in open_.values() for x in xs]


def _fillings(lengths: list[int], counts: dict[int, int], left: int, limit: float, width: float) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated ways to fill `left`, least waste first: items go in by falling length, and a filling that still has room
    for some unused length is dominated by the one that adds it. A filling with no waste ends the search, and so do
    `limit` steps; at each step the `width` longest lengths that fit are tried."""
    found, stack, steps = [], [(left, len(lengths), ())], 0
    while stack and steps < limit:
        room, top, items = stack.pop()
        steps += 1
        fits = bisect_right(lengths, room) - 1
        if any(counts[lengths[k]] > items.count(lengths[k]) for k in range(top, fits + 1)):
            continue
        i = min(fits, top - 1)
        tried = []
        while i >= 0 and len(tried) < width:
            a = lengths[i]
            if counts[a] > items.count(a):
                tried.append((room - a, i + 1, items + (a,)))
            i -= 1
        if not tried:
            found.append((room, items))
            if room == 0:
                break
        stack.extend(reversed(tried))
    return sorted(found, key=lambda f: (f[0], len(f[1])))


#: Bounds of the search: fillings tried at a branching, turns that branch, ends of branches, steps and lengths of a filling.
LIMITS = {"branches": 3, "turns": 6, "nodes": 60, "steps": 400, "width": 3}


def complete_bins(histogram: dict[int, int], room: int, limits: dict | None = LIMITS) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times, lengths) that hold every length of the histogram as often as it says.

    Branch and bound: the largest length left is completed by one of its undominated fillings; a branch whose waste leaves
    no way to need fewer sequences than the incumbent is cut; best-fit decreasing gives the first incumbent. The search ends
    at the lower bound (the sum of lengths over room, rounded up). It works on lengths (at most `room` of them), whatever
    the number of documents.

    limits bounds the search and repeats a filling while all its lengths last; the result is then no worse than best-fit
    decreasing. Without limits every undominated filling is tried for one sequence at a time: the optimum, in exponential time.
    """
    incumbent = best_fit(histogram, room)
    total = sum(a * n for a, n in histogram.items())
    best, bound = sum(t for t, _ in incumbent), -(-total // room)
    most = limits or dict.fromkeys(LIMITS, inf)
    ends, stack = 0, [({a: n for a, n in histogram.items() if n}, [], 0, 0)]
    while stack and best > bound and ends < most["nodes"]:
        counts, plan, bins, waste = stack.pop()
        if not counts or waste > (best - 1) * room - total:
            ends += 1
            if not counts and bins < best:
                best, incumbent = bins, plan
            continue
        lengths = sorted(counts)
        a = lengths[-1]
        counts[a] -= 1
        ways = _fillings(lengths, counts, room - a, most["steps"], most["width"])
        counts[a] += 1
        ways = ways[: int(min(most["branches"], len(ways)))] if len(plan) < most["turns"] else ways[:1]
        for left, items in reversed(ways):
            items = (a, *items)
            used = Counter(items)
            times = min(counts[x] // n for x, n in used.items()) if limits else 1
            rest = dict(counts)
            for x, n in used.items():
                rest[x] -= times * n
                if not rest[x]:
                    del rest[x]
            stack.append((rest, [*plan, (times, items)], bins + times, waste + times * left))
    return incumbent


def pack(docs: DataFrame, tokenizer: str, end: int = 1, room: int = 4096, limits: dict | None = LIMITS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than `room` ids are cut. Null or empty text is the end id alone; equal rows are packed each;
    an empty table gives no rows. The driver sees the histogram of lengths, at most `room` rows, and sends tasks the
    patterns, some rows a length. Pieces of one length are numbered in two steps (buckets, then rows of a bucket).
    """
    small_batches(docs.sparkSession)
    # numbers make even equal rows differ; the checkpoint fixes them
    pieces = checkpoint(token_pieces(docs, tokenizer, end, room).withColumn("no", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lanes: dict[int, list[tuple[int, int, int]]] = {}
    reached: dict[int, int] = {}
    sequence = 0
    for times, items in complete_bins(histogram, room, limits):
        at = 0
        for a in items:
            lanes.setdefault(a, []).append((reached.get(a, 0), sequence, at))
            reached[a] = reached.get(a, 0) + times
            at += a
        sequence += times
    lanes_np = {a: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for a, v in lanes.items()}
    # a length's pieces are dealt to buckets, some square root of their number to one; broadcast: at most `room` rows
    deal = F.broadcast(docs.sparkSession.createDataFrame([(a, buckets_of(n)) for a, n in histogram.items()], "length long, buckets int"))
    rows = pieces.join(deal, "length").withColumn("bucket", F.pmod(F.xxhash64("no"), "buckets").cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    own = Window.partitionBy("length", "bucket").orderBy("no")
    rows = rows.withColumn("rank", F.row_number().over(own) - 1).join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    def seat(batches):
        for pdf in batches:
            place, at = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for a, rows_ in pdf.groupby("length").indices.items():
                first, seq, off = lanes_np[a]
                rank = pdf["rank"].to_numpy()[rows_]
                i = np.searchsorted(first, rank, side="right") - 1
                place[rows_], at[rows_] = seq[i] + rank - first[i], off[i]
            yield pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": place, "offset": at})

    return rows.drop("no", "bucket", "buckets", "base").mapInPandas(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


ship(__name__)
