"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation, and a smoothed unigram base."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import checkpoint, ship, small_batches

OTHER, END = 0, 1
#: Without a set vocabulary the model knows its LEAST most frequent words and all that occur sqrt(tokens) / DEPTH times.
LEAST, DEPTH = 1024, 32
#: A block of documents ends once it has that many words or that many different ones.
BLOCK_WORDS, BLOCK_DISTINCT = 4_000_000, 400_000
#: Tasks go through a block by runs of texts of some so many words.
RUN_WORDS = 500_000
#: Words to a training task, which starts from the common parameters and makes one pass.
TRAINER_WORDS = 16_000_000
BLOCK = "block long, doc_id array<long>, learn array<boolean>, size array<int>, ids binary, words array<binary>, times array<int>"


def _contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two ids before each, of texts one behind the other that close with END; a text starts after two ends."""
    padded = np.concatenate([[END, END], ids]).astype(ids.dtype)
    before = padded[:-2].copy()
    before[1:][ids[:-1] == END] = END
    return padded[1:-1], before


def classes(noise: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Classes of words of like frequency, some sqrt(v) of them and none over 2 sqrt(v) + 1 words: class of each, members, place in the class."""
    v = len(noise)
    order = np.argsort(-noise, kind="stable")
    share = (np.sqrt(noise[order]) / np.sqrt(noise).sum() + 1 / v) / 2
    k = np.unique(np.floor(np.ceil(np.sqrt(v)) * (np.cumsum(share) - share / 2)), return_inverse=True)[1]
    members = np.split(order, np.flatnonzero(np.diff(k)) + 1)
    own, place = np.empty(v, np.int32), np.empty(v, np.int32)
    for c, m in enumerate(members):
        own[m], place[m] = c, np.arange(len(m))
    return own, members, place


def start_part(noise: np.ndarray, dim: int) -> dict:
    """Parameters before training, the same in every task: a, b (words as context), q (words; their bias is the last column), c (classes, likewise)."""
    start = np.random.default_rng(11)
    own, members, _ = classes(noise)
    p = {k: start.normal(0, 0.1, (len(noise), dim)).astype(np.float32) for k in ("a", "b")}
    for k, share in (("q", noise), ("c", np.bincount(own, noise))):
        p[k] = np.column_stack([start.normal(0, 0.1, (len(share), dim)), np.log(share)]).astype(np.float32)
    return p


def train_part(streams, noise: np.ndarray, dim: int, seed: int, rate: float = 0.3, drawn: int = 64, size: int = 8192) -> tuple[dict, int]:
    """One pass of noise-contrastive estimation over arrays of ids (texts that close with END); every batch shares its noise words.

    The prediction of a context is a[w1] + b[w2]; its score for w is prediction . q[w] + bias[w], for a class likewise.
    The model separates the word, and its class, from `drawn` words or classes of the noise distribution.
    """
    rng = np.random.default_rng(seed)
    own = classes(noise)[0]
    p = start_part(noise, dim)
    heads = [(k, np.log(drawn * x).astype(np.float32), np.cumsum(x)) for k, x in (("q", noise), ("c", np.bincount(own, noise)))]
    grad2 = {k: np.full(x.shape, 1e-2, np.float32) for k, x in p.items()}
    seen = 0

    def add(name, at, g):
        order = np.argsort(at.astype(np.uint16) if len(p[name]) <= 2**16 else at, kind="stable")  # 16 bits: a radix sort
        at = at.take(order)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        total, rows = np.add.reduceat(g.take(order, axis=0), first, axis=0), at.take(first)
        pace = grad2[name].take(rows, axis=0)
        pace += total * total
        grad2[name][rows] = pace
        np.sqrt(pace, out=pace)
        total *= np.float32(rate)
        total /= pace
        p[name][rows] += total

    def pull(s, sign):
        """Gradients of log sigmoid(s) (sign 1) or log sigmoid(-s) (sign -1), over the batch's size; s is overwritten."""
        np.clip(s, -30, 30, out=s)
        s *= np.float32(sign)
        np.exp(s, out=s)
        s += np.float32(1)
        return s

    def batch(ids, w1, w2):
        n = np.float32(len(ids))
        hat = np.ones((len(ids), dim + 1), np.float32)
        np.add(p["a"].take(w1, axis=0), p["b"].take(w2, axis=0), out=hat[:, :-1])
        g_hat = np.zeros_like(hat)
        for (name, log_noise, upto), true in zip(heads, (ids, own.take(ids))):
            false = np.minimum(np.searchsorted(upto, rng.random(drawn)), len(upto) - 1).astype(np.int32)
            true_q, false_q = p[name].take(true, axis=0), p[name].take(false, axis=0)
            t = np.float32(1) / n / pull(np.einsum("ij,ij->i", hat, true_q) - log_noise.take(true), 1)
            f = pull(hat @ false_q.T - log_noise.take(false), -1)
            np.divide(np.float32(-1) / n, f, out=f)
            true_q *= t[:, None]
            g_hat += true_q
            g_hat += f @ false_q
            add(name, np.concatenate([true, false]), np.concatenate([t[:, None] * hat, f.T @ hat]))
        g_hat = np.ascontiguousarray(g_hat[:, :-1])
        add("a", w1, g_hat)
        add("b", w2, g_hat)

    for ids in streams:
        w1, w2 = _contexts(ids)
        for i in range(0, len(ids), size):
            batch(ids[i : i + size], w1[i : i + size], w2[i : i + size])
        seen += len(ids)
    return p, seen


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Logs of the sums of exponentials of each row; s is overwritten."""
    top = 0 if s.max() < 60 and s.min() > -60 else s.max(1)
    if not np.isscalar(top):
        s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], np.float32)) + top


def log_chances(p: dict, kinds: tuple, ids: np.ndarray, w1: np.ndarray, w2: np.ndarray, size: int = 8192) -> np.ndarray:
    """Natural logs of P(class | context) P(word | class, context), each with its exact normaliser: some sqrt(v) scores a token, not v.

    Tokens go by the class of their word, so that a class's parameters are fetched once.
    """
    own, members, place = kinds
    out, k = np.empty(len(ids), np.float32), own.take(ids)
    order = np.argsort(k.astype(np.uint16) if len(members) <= 2**16 else k, kind="stable")  # 16 bits: a radix sort
    classes_q = np.ascontiguousarray(p["c"].T)
    for same in np.split(order, np.flatnonzero(np.diff(k.take(order))) + 1):
        m = members[k[same[0]]] if len(same) else ()
        words_q = np.ascontiguousarray(p["q"].take(m, axis=0).T) if len(m) > 1 else None
        for i in range(0, len(same), size):
            rows = same[i : i + size]
            hat = np.ones((len(rows), p["q"].shape[1]), np.float32)
            np.add(p["a"].take(w1.take(rows), axis=0), p["b"].take(w2.take(rows), axis=0), out=hat[:, :-1])
            s = hat @ classes_q
            log = s[:, k[same[0]]].copy()
            log -= _log_sum(s)
            if words_q is not None:
                s = hat @ words_q
                log += s[np.arange(len(rows)), place.take(ids.take(rows))]
                log -= _log_sum(s)
            out[rows] = log
    return out


def log_tables(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score tables of the two context words and the log of each context's normaliser over all words at once (small vocabularies)."""
    v = len(p["bias"])
    ta, tb = p["a"] @ p["q"].T + p["bias"], p["b"] @ p["q"].T
    top_a, top_b = ta.max(1), tb.max(1)
    ea, eb = np.exp(ta - top_a[:, None]), np.exp(tb - top_b[:, None])
    # sum over w of exp(ta[w1, w] + tb[w2, w]) is a product of the exponentials' tables
    z = np.concatenate([np.log(np.maximum(ea[i : i + 256] @ eb.T, 1e-30)) for i in range(0, v, 256)])
    return ta, tb, z + top_a[:, None] + top_b


def blocks(docs: DataFrame, learn: Column) -> DataFrame:
    """Documents by the block, each block with its own dictionary: the only pass over the texts.

    A task's rows are put together in order until a block has BLOCK_WORDS words or BLOCK_DISTINCT different ones (a longer
    text is a block by itself). ids: the texts' words as places in `words`, 32-bit, compressed; size: words of each text;
    times: how often texts to learn from have each word.
    """
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        numbers = count(first)

        def row():
            ids, size, on = np.concatenate(held), np.array([len(x) for x in held], np.int32), np.array(learns, bool)
            times = np.bincount(ids[np.repeat(on, size)], minlength=len(known)).astype(np.int32)
            columns = ([next(numbers)], [doc_ids], [on], [size], [_squeeze(ids)], [list(known)], [times])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

        held, doc_ids, learns, total, known = [], [], [], 0, _dictionary()
        for batch in batches:
            for doc, on, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "learn", "text"))):
                # bytes.split() splits at the six white-space characters and bytes.lower() changes A-Z, and nothing else
                words = (text or b"").lower().split()
                held.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc)
                learns.append(on)
                total += len(words)
                if total >= BLOCK_WORDS or len(known) >= BLOCK_DISTINCT:
                    yield row()
                    held, doc_ids, learns, total, known = [], [], [], 0, _dictionary()
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, BLOCK)


def _dictionary() -> defaultdict:
    d: defaultdict = defaultdict()
    d.default_factory = d.__len__  # a new word's place is the number of words before it
    return d


def _squeeze(ids: np.ndarray) -> bytes:
    return len(ids).to_bytes(8, "little") + pa.compress(ids.astype("<i4").tobytes(), "zstd", asbytes=True)


def _spread(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], 4 * int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), "<i4")


def _runs(ids: np.ndarray, size: np.ndarray, end: int):
    """Runs of a block's texts: the first text and the one after the last, their ids with `end` behind each text, and where each text starts."""
    upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + RUN_WORDS, side="right")) - 1)
        stop = np.cumsum(size[a:b].astype(np.int64) + 1)
        out = np.full(int(stop[-1]), end, np.int32)
        inside = np.ones(len(out), bool)
        inside[stop - 1] = False
        out[inside] = ids[upto[a] : upto[b]]
        yield a, b, out, stop - size[a:b] - 1
        a = b


def score(docs: DataFrame, learn: Column, vocabulary: int | None = None, common: int = 20_000, dim: int = 24) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text of docs, learning from rows where learn is true.

    Tokens are lower-case (A-Z) words and one end a text. Texts are read and split once, into blocks of word places with a
    dictionary each; counting, training and scoring work on those. Counts cover all rows to learn from, and so does
    training: every task makes one pass over its blocks, and the tasks' parameters are averaged by tokens (so scores, unlike
    base scores, depend a little on how rows are dealt to tasks). The model knows the `vocabulary` most frequent words, or
    by default the 1,024 most frequent and all that occur at least sqrt(tokens) / 32 times (no more than 32 sqrt(tokens)
    words, so they grow with the rows); the probability of others is the model's for any other word, shared by smoothed
    counts. Words of the model and those that make up 1 / common of all tokens go to all tasks with their counts; the
    blocks' other words meet their counts in a window over their occurrences in dictionaries.

    Null text counts as empty: its one token is the end. Without text to learn from, N and V are 0 and a text's base score
    is the sum of log10(1). Repeated and null ids give a row each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = checkpoint(blocks(docs, learn))
    sums = held.agg(F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"), F.sum(F.size(F.filter("learn", lambda x: x))).alias("texts")).first()
    texts = int(sums["texts"] or 0)
    total = int(sums["n"] or 0) + texts
    least = max(total, 1) ** 0.5 / DEPTH
    said = held.select("block", F.posexplode(F.arrays_zip("words", "times")).alias("i", "x")).select("block", "i", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    counts = said.filter("times > 0").groupBy("word").agg(F.sum("times").alias("n"))
    often = F.col("n") * common >= total  # no more than `common` words
    often = often if vocabulary else often | (F.col("n") >= least)
    found = counts.agg(F.count("*").alias("v"), F.collect_list(F.when(often, F.struct("word", "n"))).alias("top")).first()
    distinct = found["v"] + (texts > 0)
    top = sorted(((bytes(r["word"]), r["n"]) for r in found["top"]), key=lambda x: (-x[1], x[0]))
    known = dict(top)
    model = [w for i, (w, n) in enumerate(top) if (i < vocabulary - 2 if vocabulary else i < LEAST - 2 or n >= least)]
    index = {w: i + 2 for i, w in enumerate(model)}
    v = len(model) + 2
    rest = total - texts - sum(known[w] for w in model)
    noise = np.array([max(rest, 0) + 1, texts + 1, *(known[w] + 1 for w in model)], float)
    noise = noise / noise.sum()
    shared_words = spark.sparkContext.broadcast((index, noise))

    def train(batches):
        index, noise = shared_words.value

        def streams():
            for row in _rows(batches):
                on = np.asarray(row["learn"], bool)
                if on.any():
                    to_model = np.array([index.get(w, OTHER) for w in row["words"]] + [END], np.int32)
                    ids, size = _spread(row["ids"]), np.asarray(row["size"], np.int32)
                    for _, _, run, _ in _runs(ids[np.repeat(on, size)], size[on], len(to_model) - 1):
                        yield to_model.take(run)

        p, seen = train_part(streams(), noise, dim, 5)
        first = start_part(noise, dim)
        for name in p if seen else ():
            moved = (p[name] - first[name]) * np.float32(seen)
            rows = np.flatnonzero(moved.any(1)).astype(np.int32)
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                flat = moved.take(part, axis=0)
                x = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), x], names=["name", "row", "x"])

    # averages by tokens, of fixed size however many tasks trained; what a task did not move is not sent
    trainers = held.select("learn", "size", "ids", "words").coalesce(max(1, -(-total // TRAINER_WORDS)))
    parts = trainers.mapInArrow(train, "name string, row int, x array<float>")
    sums = parts.groupBy("name", "row").agg(F.array(*(F.sum(F.get("x", F.lit(i))) for i in range(dim + 1))).alias("x"))
    p = start_part(noise, dim)
    for name, part in sums.toPandas().groupby("name"):
        p[name][part["row"].to_numpy()] += (np.array(part["x"].tolist(), float)[:, : p[name].shape[1]] / total).astype(np.float32)
    log_all = float(np.log10(total + 0.5 * (distinct + 1)))
    log_rest = float(np.log10(max(rest, 0) + 0.5 * (distinct - v + 3))) if distinct > v else float(np.log10(max(rest, 0) + 1.0))
    shared = spark.sparkContext.broadcast((p, classes(noise)))
    ln10 = float(np.log(10))

    def run(batches):
        p, kinds = shared.value
        for row in _rows(batches):
            ids, size = _spread(row["ids"]), np.asarray(row["size"], np.int32)
            last = int(ids.max(initial=-1)) + 1
            n, to_model = np.zeros(last + 1, np.int64), np.full(last + 1, OTHER, np.int32)
            n[last], to_model[last] = texts, END
            for k in ("", "top_"):  # rare words, and those that all tasks know
                if row[f"{k}at"] is not None:
                    at = np.asarray(row[f"{k}at"])
                    n[at], to_model[at] = np.asarray(row[f"{k}n"]), np.asarray(row[f"{k}m"])
            log_n = np.log10(n + 0.5)
            share = np.where(to_model == OTHER, log_n - log_rest, 0.0)
            base, known = log_n - log_all, (n > 0).astype(np.int64)
            doc_ids = row["doc_id"]
            for a, b, run_, starts in _runs(ids, size, last):
                m = to_model.take(run_)
                chances = log_chances(p, kinds, m, *_contexts(m)).astype(float) / ln10
                chances += share.take(run_)
                n_known, base_score, lm = (np.add.reduceat(x, starts) for x in (known.take(run_), base.take(run_), chances))
                out = {"doc_id": doc_ids[a:b], "n_tokens": size[a:b].astype(np.int64) + 1, "n_known": n_known, "train_tokens": np.full(b - a, total), "base_score": base_score, "score": lm}
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), (*[pa.int64()] * 4, *[pa.float64()] * 2))], names=list(out))

    # all tasks know the model's words and the common ones, and a block's dictionary is looked up as a whole
    told = spark.sparkContext.broadcast({w: (n, index.get(w, OTHER)) for w, n in top})

    def look_up(batches):
        told_ = told.value
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                met = [(i, *told_[w]) for i, w in enumerate(words) if w in told_]
                at, n, m = map(list, zip(*met)) if met else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64())), pa.array([m], pa.list_(pa.int32()))], names=["block", "top_at", "top_n", "top_m"])

    common_words = held.select("block", "words").mapInArrow(look_up, "block long, top_at array<int>, top_n array<long>, top_m array<int>")
    known_words = F.broadcast(spark.createDataFrame([(w,) for w, _ in top], "word binary"))
    # a counted word outside of them is in fewer than sqrt(tokens) / 32 (or tokens / common) dictionaries with a count; others in one a block at most
    rare = said.join(known_words, "word", "left_anti").withColumn("n", F.sum("times").over(Window.partitionBy("word"))).filter("n > 0").withColumn("m", F.lit(OTHER))
    words = rare.groupBy("block").agg(F.collect_list(F.struct("i", "n", "m")).alias("x")).select("block", F.col("x.i").alias("at"), F.col("x.n").alias("n"), F.col("x.m").alias("m"))
    both = held.select("block", "doc_id", "size", "ids").join(words, "block", "left").join(common_words, "block", "left")
    return both.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: _value(column[i]) for name, column in zip(batch.schema.names, batch.columns)}


def _value(x):
    """A field of a block; arrays of numbers come as numpy arrays, words as a list of bytes."""
    if not x.is_valid:
        return None
    if not pa.types.is_list(x.type):
        return x.as_py()
    return x.values.to_numpy(zero_copy_only=False) if not pa.types.is_binary(x.type.value_type) and not x.values.null_count else x.as_py()


ship(__name__)
