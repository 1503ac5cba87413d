"""Alignment of two tokenizers' tokens: divide and conquer at cuts where tokens of both end."""

from __future__ import annotations

import gc
import hashlib
import os
import re
import sys
import types
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import checkpoint, ship, small_batches

DOCS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments binary, links binary, pairs binary, df binary"
ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), *[(k, pa.binary()) for k in ("segments", "links", "pairs", "df")]])
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Fixed value: how byte-level tokenizers part words.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN = re.compile(r"\s ")
#: Segments that a task remembers; beyond that those not met since the last time it was full go.
REMEMBERED = 250_000


def groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (a_from, a_to, b_from, b_to) of tokens between neighbouring common ends, to-ends exclusive.

    a, b: the ends of each side's tokens, strictly rising, with the same last end. An interval is cut at the common end
    nearest to its middle: a's ends are tried from the middle one outwards, on both sides in turn, each by bisection in b.
    Both halves go on by themselves; an interval without a common end inside is a leaf group.
    """
    if not a or not b:
        return []
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        top, cut = a1 - 1, -1
        low = (a0 + top) // 2
        high = low + 1
        while low >= a0 or high < top:
            if a0 <= low < top:
                j = bisect_left(b, a[low], b0, b1)
                if b[j] == a[low]:
                    cut = low + 1
                    break
            if high < top:
                j = bisect_left(b, a[high], b0, b1)
                if b[j] == a[high]:
                    cut = high + 1
                    break
            low -= 1
            high += 1
        if cut < 0:
            out.append((a0, a1, b0, b1))
            continue
        j += 1
        # one token on a side can't be cut
        if cut - a0 == 1 or j - b0 == 1:
            out.append((a0, cut, b0, j))
        else:
            stack.append((a0, cut, b0, j))
        if a1 - cut == 1 or b1 - j == 1:
            out.append((cut, a1, j, b1))
        else:
            stack.append((cut, a1, j, b1))
    return sorted(out)


class _Tokenizers:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        # byte-level letters: printable Latin-1 stands for itself, the other bytes for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
        n = self.a.get_vocab_size(with_added_tokens=False)
        self.a_bytes = [bytes(letter[c] for c in self.a.id_to_token(i)) if set(self.a.id_to_token(i)) <= letter.keys() else self.a.id_to_token(i).encode() for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_text, self.b_text = [str(i) for i in range(n)], [str(i) for i in range(len(self.b_bytes))]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.quick = self._ranked(first)
        # where no piece has a blank behind another sign, what follows a blank is encoded by itself
        self.apart = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.blank = self.b.piece_to_id("▁")

    def _ranked(self, file: str):
        """The first tokenizer as ranks, which encodes short runs several times faster; None unless it is the same: single bytes,
        then one id a merge in their order, with the usual rule of byte-level tokenizers for parting words."""
        import json

        import tiktoken

        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        model, parts = told["model"], told.get("pre_tokenizer") or {}
        merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        usual = parts.get("type") == "ByteLevel" and parts.get("use_regex") and not parts.get("add_prefix_space") and not told.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "fuse_unk"))
        if not usual or [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        return tiktoken.Encoding("first", pat_str=PARTS, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes[: 256 + len(merged)])}, special_tokens={})

    def ids(self, runs: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for runs that begin with a blank; the second adds that blank itself."""
        a = list(map(self.quick.encode_ordinary, runs)) if self.quick else [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        b = self.b.encode([r[1:] for r in runs], num_threads=1)
        return [(x, y or [self.blank]) for x, y in zip(a, b)]

    def align(self, runs: list[str], ids: list[tuple[list[int], list[int]]]) -> list[tuple | None]:
        """For each run n_a, n_b, n_groups, text of the groups, and linked id pairs (a << 32 | b) as bytes; None if the bytes of
        either side are not the run's. Runs are aligned end to end, since both sides end where a run does."""
        texts = [r.encode() for r in runs]
        a, b = [i for x, _ in ids for i in x], [i for _, y in ids for i in y]
        size_a, size_b = np.array([len(x) for x, _ in ids]), np.array([len(y) for _, y in ids])
        at_a, at_b = np.cumsum([0, *map(self.a_size.__getitem__, a)]), np.cumsum([0, *map(self.b_size.__getitem__, b)])
        to, to_a, to_b = np.cumsum([len(t) for t in texts]), np.cumsum(size_a), np.cumsum(size_b)
        whole = b"".join(texts)
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        if not same or not (at_a[to_a] == to).all() or not (at_b[to_b] == to).all():
            if len(runs) == 1:
                return [None]
            half = len(runs) // 2
            return self.align(runs[:half], ids[:half]) + self.align(runs[half:], ids[half:])
        at_a, at_b = at_a[1:], at_b[1:]
        found = groups(at_a.tolist(), at_b.tolist())
        x, y = list(map(self.a_text.__getitem__, a)), list(map(self.b_text.__getitem__, b))
        told = [f"{x[i]}|{y[k]}" if j - i == 1 == m - k else f"{','.join(x[i:j])}|{','.join(y[k:m])}" for i, j, k, m in found]
        upto = (np.searchsorted([g[1] for g in found], to_a) + 1).tolist()
        # between two neighbouring ends of either side lies a part of one token of each
        ends = np.union1d(at_a, at_b)
        pairs = np.array(a, np.int64)[np.searchsorted(at_a, ends)] << 32 | np.array(b, np.int64)[np.searchsorted(at_b, ends)]
        links, raw = (8 * np.searchsorted(ends, to, side="right")).tolist(), pairs.tobytes()
        rows = zip(size_a.tolist(), size_b.tolist(), [0, *upto], upto, [0, *links], links)
        return [(n_a, n_b, g1 - g0, ";".join(told[g0:g1]), raw[p0:p1]) for n_a, n_b, g0, g1, p0, p1 in rows]


def _segments(text: str) -> list[str]:
    """blank + text in runs that begin with a blank behind a sign that is no white space: both tokenizers part there."""
    parts = text.split(" ")
    if text[:1] != " " and not OPEN.search(text):
        return parts
    out, open_ = [], False
    for p in parts:
        if open_:
            out[-1] += " " + p
        else:
            out.append(p)
        open_ = not p or p[-1].isspace()
    return out


class _Numbers(dict):
    """Numbers for segments, in order of their first use."""

    def __missing__(self, segment: str) -> int:
        self[segment] = len(self)
        return self[segment]


def align_documents(docs: DataFrame, first: str, second: str, block: int = 8_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    first: the file of a byte-level BPE; second: that of a sentence-piece model which adds a blank. Null and empty texts, and
    those that a tokenizer does not give back byte for byte, have zeros and an empty groups_sha256. A pair's count is the
    number of documents (rows) that hold it linked; n_best counts links whose pair has its first id's highest count.
    Repeated rows count each; other columns are ignored; an empty table gives no rows.

    Texts are cut where both tokenizers part whatever the text (a blank behind a sign that is no white space), and each
    distinct run is encoded and aligned once a task: that cut is a common end, so a text's groups are those of its runs. A
    text with a run that does not come back is encoded whole. Blocks of some `block` bytes keep their distinct
    pairs in one list; pairs' counts are added up over blocks, and each block gets those of its own pairs by a join.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        import pyspark

        kept = sys.modules.setdefault("_codestrata_pair", types.ModuleType("_codestrata_pair")).__dict__
        if kept.get("path") != (first, second):
            kept.update(path=(first, second), both=_Tokenizers(first, second))
        both: _Tokenizers = kept["both"]
        known: dict[str, tuple | None] = {}
        before: dict[str, tuple | None] = {}
        part, made = pyspark.TaskContext.get().partitionId(), 0

        def learn(texts):
            """What the texts' segments say; those met again are kept when others go."""
            nonlocal known, before
            met = {s for own in texts for s in own}
            if len(known) > REMEMBERED:
                known, before = {}, known
            new = []
            for s in met.difference(known):
                if s in before:
                    known[s] = before[s]
                else:
                    new.append(s)
            for k in range(0, len(new), 4000):
                runs = [" " + s for s in new[k : k + 4000]]
                known.update(zip(new[k : k + 4000], both.align(runs, both.ids(runs))))

        def emit(rows):
            nonlocal made
            texts = [_segments(t) if t and both.apart else [t] if t else [] for _, t in rows]
            learn(texts)
            whole: dict[str, tuple] = {}
            number = _Numbers()
            lists = [np.fromiter(map(number.__getitem__, own), np.int32, len(own)) for own in texts]
            odd = {s for s in number if known[s] is None}
            for i, own in enumerate(texts if odd else ()):
                if not odd.isdisjoint(own):
                    text = rows[i][1]
                    found = both.align([" " + text], both.ids([" " + text]))[0]
                    texts[i] = [text] if found else []
                    whole |= {text: found} if found else {}
            if odd:
                number = _Numbers()
                lists = [np.fromiter(map(number.__getitem__, own), np.int32, len(own)) for own in texts]
            facts = [whole.get(s) or known[s] for s in number]
            texts_of = [f[3] for f in facts]
            size = np.array([f[:3] + (len(f[4]) // 8,) for f in facts], np.int64).reshape(-1, 4)
            every = np.frombuffer(b"".join([f[4] for f in facts]), np.int64)
            pairs, place = np.unique(every, return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(size[:, 3])])
            df, last = np.zeros(len(pairs), np.int64), np.full(len(pairs), -1)
            out = {k: [] for k in ARROW.names}
            for i, ((doc, _), mine, own) in enumerate(zip(rows, lists, texts)):
                used = np.unique(mine)
                if len(used):
                    # the pairs of all its segments, one segment after the other
                    at = place[np.repeat(ends[used + 1] - np.cumsum(size[used, 3]), size[used, 3]) + np.arange(size[used, 3].sum())]
                    fresh = at[last[at] != i]
                    last[fresh] = i
                    df[np.unique(fresh)] += 1
                told = hashlib.sha256(";".join(map(texts_of.__getitem__, mine.tolist())).encode()).hexdigest() if own else ""
                row = (made << 24 | part, doc, *size[mine].sum(axis=0).tolist(), told, mine.tobytes(), None, None, None)
                for k, v in zip(out, row):
                    out[k].append(v)
            # the block's own row: which pairs each distinct run links, the pairs and in how many of its documents they are
            own = (made << 24 | part, None, 0, 0, 0, 0, "", ends.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), pairs.tobytes(), df.tobytes())
            for k, v in zip(out, own):
                out[k].append(v)
            made += 1
            return pa.RecordBatch.from_pydict(out, schema=ARROW)

        rows, letters = [], 0
        gc.freeze()  # the tokenizers and what else stays is not looked through again and again
        gc.disable()  # nothing below refers to itself
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows.append(row)
                letters += len(row[1] or "")
                if letters >= block:
                    yield emit(rows)
                    rows, letters = [], 0
        if rows:
            yield emit(rows)
        gc.enable()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = checkpoint(texts.mapInArrow(run, DOCS))

    def unfold(batches):
        for batch in batches:
            for block_, pairs, df in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "df"))):
                pairs = np.frombuffer(pairs, np.int64)
                yield pa.RecordBatch.from_pydict({"block": np.full(len(pairs), block_), "pair": pairs, "df": np.frombuffer(df, np.int64)})

    held = checkpoint(made.filter("pairs is not null").select("block", "pairs", "df").mapInArrow(unfold, "block long, pair long, df long"))
    counts = held.groupBy("pair").agg(F.sum("df").alias("count")).withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = held.select("block", "pair").join(counts, "pair")

    def weigh(mine: pa.Table, counted: pa.Table) -> pa.Table:
        rows = mine.to_pydict()
        at = next((i for i, p in enumerate(rows["pairs"]) if p is not None), None)
        out = {k: [] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
        order = np.argsort(counted.column("pair").to_numpy())
        value = np.stack([counted.column("best").to_numpy().astype(np.int64)[order], counted.column("count").to_numpy()[order]])
        ends, place = np.frombuffer(rows["segments"][at], np.int32), np.frombuffer(rows["links"][at], np.int32)
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(value[:, place], axis=1)], axis=1)
        of_run = sums[:, ends[1:]] - sums[:, ends[:-1]]
        for i, own in enumerate(rows["segments"]):
            if i != at:
                n_best, count_sum = of_run[:, np.frombuffer(own, np.int32)].sum(axis=1).tolist()
                for k, v in (("n_best", n_best), ("count_sum", count_sum), *((k, rows[k][i]) for k in out if k not in ("n_best", "count_sum"))):
                    out[k].append(v)
        return pa.Table.from_pydict(out, schema=pa.schema([(k, pa.string() if k == "groups_sha256" else pa.int64()) for k in out]))

    return made.drop("df").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(weigh, OUT)


ship(__name__)
