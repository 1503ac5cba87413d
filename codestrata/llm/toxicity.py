"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import checkpoint, ship, small_batches

#: Words that are insults whatever the labels say.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown clowns dumb imbecile jerk filth vermin garbage".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch vous tu te toi ton ta votre vos tú usted ustedes ti tus vosotros".split())
LEET = str.maketrans("013457@$", "oieastas")
EDGE = ".,;:!?\"'()[]{}<>*#&%|-_=~"
FEATURES = 14


def tokens(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


def plain(word: str) -> str:
    """A word with look-alike digits and signs read as letters and separators inside it dropped."""
    return re.sub(r"[^\w]|_|\d", "", word.translate(LEET)) if not word.isalpha() else word


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Densities and rates of one whole text; zeros for an empty one.

    Two features count words as such: distinct lexicon words, level from 50 on, and all marked words, level from 200 on.
    """
    if not text:
        return [0.0] * FEATURES
    words, chars = tokens(text), len(text)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    hidden = [i for i, w in enumerate(words) if not w.isalpha() and ((p := plain(w)) in lexicon or p in INSULTS)]
    all_ = sorted({*hits, *insults, *hidden})
    near, seconds = 0, [i for i, w in enumerate(words) if w in SECOND]
    if all_ and seconds:
        at = np.array(seconds)
        for i in all_:
            k = int(np.searchsorted(at, i))
            near += any(abs(int(at[j]) - i) <= 4 for j in (k - 1, k) if 0 <= j < len(at))
    raw = text.split()
    return [
        len(hits) / n, float(sum(lexicon[words[i]] for i in hits)) / n, float(min(len({words[i] for i in hits}), 50)), float(min(len(all_), 200)),
        len(insults) / n, len(hidden) / n, len(seconds) / n, near / n,
        sum(c.isupper() for c in text) / chars, sum(w.isupper() and len(w) > 1 for w in raw) / n,
        (text.count("!") + text.count("?")) / chars, sum(not c.isalnum() and not c.isspace() for c in text) / chars,
        sum(not w.isalpha() and any(c.isalpha() for c in w) for w in words) / n, float(np.log1p(n)),
    ]


def learn_lexicon(counts: pd.DataFrame, positives: int, negatives: int, least: int = 3, most: int = 20_000) -> dict[str, float]:
    """Words whose share of toxic texts is well above that of others: smoothed log odds, at least `least` toxic texts and a standard error above 1.2.

    At most `most` words, the surest first (the sample bounds how many there can be); a word's weight is level from log odds of 6 on.
    """
    p, q = counts["pos"].to_numpy(float), counts["neg"].to_numpy(float)
    odds = np.log((p + 0.1) / (positives - p + 1)) - np.log((q + 0.1) / (negatives - q + 1))
    error = np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    take = np.flatnonzero((p >= least) & (odds - error > 1.2))
    take = sorted(take, key=lambda i: (-(odds[i] / error[i]), counts["word"].iloc[i]))[:most]
    return {counts["word"].iloc[i]: float(min(odds[i], 6.0)) for i in take}


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, smooth: float = 2.0) -> tuple:
    """Gradient-boosted trees on the logistic loss by histograms; a tree is a list of (feature, bound) by heap order and its leaf values."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, model = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node, splits = np.zeros(len(y), int), []
        for level in range(depth):
            width = 2**level
            best = [(0.0, 0, np.inf)] * width
            for j in range(x.shape[1]):
                k = len(edges[j]) + 1
                gs = np.bincount(node * k + coded[:, j], g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(node * k + coded[:, j], h, width * k).reshape(width, k).cumsum(1)
                gain = gs**2 / (hs + smooth) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + smooth) - gs[:, -1:] ** 2 / (hs[:, -1:] + smooth)
                for i in range(width):
                    if k > 1 and (b := int(np.argmax(gain[i, :-1]))) >= 0 and gain[i, b] > best[i][0] + 1e-9:
                        best[i] = (float(gain[i, b]), j, float(edges[j][b]))
            splits += [(j, b) for _, j, b in best]
            chosen = np.array([b[1] for b in best])[node]
            bound = np.array([b[2] for b in best])[node]
            node = node * 2 + (x[np.arange(len(y)), chosen] > bound)
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaves = rate * gs / (hs + smooth)
        score = score + leaves[node]
        model.append((splits, leaves))
    return base, depth, model


def margins(x: np.ndarray, trees: tuple) -> np.ndarray:
    base, depth, model = trees
    out = np.full(len(x), base)
    for splits, leaves in model:
        node, first = np.zeros(len(x), int), 0
        for level in range(depth):
            j, b = (np.array(v) for v in zip(*splits[first : first + 2**level]))
            first += 2**level
            node = node * 2 + (x[np.arange(len(x)), j[node]] > b[node])
        out += leaves[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means, kept a little off 0 and 1, each at the block's mean score, for interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order].astype(float)):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.clip([b[0] / b[1] for b in blocks], 0.002, 0.998)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, folds: int = 4) -> dict:
    """Learn the lexicon, the trees and the calibration from at most `sample` labelled documents (a bounded sample: the least hashes of ids).

    Lexicon words have 3 to 40 letters. Lexicon features of a fitted row come from the other folds' lexicon, so that a row's own words don't vouch for it.
    Labels that repeat an id count once, as their greatest; null labels and ids are left out. Without both labels
    present every score is the sample's share of toxic rows (0 without any).
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).orderBy("h", "doc_id").limit(sample)
    # broadcast: at most `sample` rows of three numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows that repeat an id the least text counts; stored, so that all that is learned comes from the same rows
    rows = checkpoint(rows.groupBy("doc_id", "y", "h").agg(F.min("text").alias("text")).select("text", "y", (F.col("h") % folds).cast("int").alias("fold")))

    def count(batches):
        for pdf in batches:
            out: dict[str, np.ndarray] = {}
            for text, y, fold in zip(pdf["text"], pdf["y"], pdf["fold"]):
                for w in {plain(w) for w in tokens(text)}:
                    if 3 <= len(w) <= 40:
                        out.setdefault(w, np.zeros(2 * folds, np.int64))[2 * fold + (1 - y)] += 1
            if out:
                yield pd.DataFrame([(w, *map(int, v)) for w, v in out.items()], columns=["word", *[f"c{i}" for i in range(2 * folds)]])

    columns = [f"c{i}" for i in range(2 * folds)]
    counted = rows.mapInPandas(count, "word string, " + ", ".join(f"{c} long" for c in columns)).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    words = counted.filter(sum(F.col(c) for c in columns[::2]) >= 3).toPandas().sort_values("word", ignore_index=True)
    share = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    size = lambda y, skip=None: sum(n for (f, v), n in share.items() if v == y and f != skip)
    if not size(1) or not size(0):
        return {"constant": float(size(1) > 0), "lexicon": {}}

    def lexicon(skip=None):
        pos, neg = (sum(words[f"c{2 * f + k}"] for f in range(folds) if f != skip) for k in (0, 1))
        return learn_lexicon(pd.DataFrame({"word": words["word"], "pos": pos, "neg": neg}), size(1, skip), size(0, skip))

    lexicons = [lexicon(f) for f in range(folds)]
    names = [f"f{j}" for j in range(FEATURES)]

    def extract(batches):
        for pdf in batches:
            x = [features(t, lexicons[f]) for t, f in zip(pdf["text"], pdf["fold"])]
            yield pd.DataFrame(np.array(x, float).reshape(-1, FEATURES), columns=names).assign(y=pdf["y"].to_numpy(), fold=pdf["fold"].to_numpy())

    got = rows.mapInPandas(extract, ", ".join(f"{c} double" for c in names) + ", y int, fold int").toPandas().sort_values([*names, "y", "fold"], ignore_index=True)
    x, y, fold = got[names].to_numpy(), got["y"].to_numpy(float), got["fold"].to_numpy()
    out = np.zeros(len(y))
    for f in range(folds):
        if (fold == f).any() and (fold != f).any():
            out[fold == f] = margins(x[fold == f], boost(x[fold != f], y[fold != f]))
    return {"lexicon": lexicon(), "trees": boost(x, y), "calibration": isotonic(out, y)}


def scorer(model: dict):
    """The score (0 to 1) of a column of whole texts; null counts as empty and gets the empty text's score."""

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        if "constant" in model:
            return pd.Series(model["constant"], index=text.index, dtype=float)
        x = np.array([features(t or "", model["lexicon"]) for t in text], float).reshape(-1, FEATURES)
        return pd.Series(np.clip(np.interp(margins(x, model["trees"]), *model["calibration"]), 0, 1))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every whole text.

    Rows are independent: repeated and null ids give rows of their own, other columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(model)("text").alias("score"))


def keep_clean(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of docs with all their columns, but for those of a score of `least` or more. Each row is judged by its own
    text, whatever its id; there is no join."""
    small_batches(docs.sparkSession)
    return docs.filter(scorer(model)("text") < least)


ship(__name__)
