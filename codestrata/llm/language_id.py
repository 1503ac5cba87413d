"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL with elastic-net penalties."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import ship, small_batches

BUCKETS = 1 << 15


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of the lower-case text's letters, other runs read as one space: buckets and counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (codes >= 97) & (codes <= 122) | (codes >= 192)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    c = np.where(letters, codes, 32)[keep].astype(np.uint32)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0)
    one = c * np.uint32(2654435761)
    parts = [one]
    if len(c) > 1:
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519) + one[1:]
        parts.append(two)
    if len(c) > 2:
        parts.append((two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(3266489917) + one[2:])
    h = np.concatenate(parts)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(17)).astype(np.int64)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = grams(text)
    v = (1 + np.log(n)) * idf[at] if len(at) else np.zeros(0)
    return at, v / max(1e-9, float(np.sqrt((v * v).sum())))


def ftrl(rows: list, y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, per-coordinate rates: weights are 0 while |z| is under the l1 penalty."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            at, v = np.append(at, BUCKETS), np.append(v, 1.0)
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = np.outer(v, p)
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha * w
            n[at] += g2
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def fit(docs: DataFrame, sample: int = 3000) -> dict:
    """Learn from rows with a language: document frequencies over all of them, weights from at most `sample` (the least
    hashes of id and text, a bounded sample; rows equal in id, text and language count once), a fifth of which sets the
    temperature. Without rows nothing is learned and all is `und`."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                df[grams(t)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"g": [*at, -1], "n": [*df[at], n]})

    table = known.select("text").mapInPandas(frequencies, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    total = int(table.loc[table["g"] < 0, "n"].sum())
    if not total:
        return {"classes": []}
    df = np.zeros(BUCKETS)
    found = table[table["g"] >= 0]
    df[found["g"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    hashed = known.select(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)).alias("h"), F.xxhash64("text").alias("t"), "text", "lang")
    last = hashed.select("h", "t").distinct().orderBy("h", "t").limit(sample).agg(F.max(F.struct("h", "t")).alias("m")).first()["m"]
    chosen = hashed.filter((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("t") <= last["t"])).dropDuplicates(["h", "t", "lang"])

    def extract(batches):
        for pdf in batches:
            xs = [vector(t, idf) for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "lang": pdf["lang"], "at": [a.tolist() for a, _ in xs], "v": [v.tolist() for _, v in xs]})

    got = chosen.mapInPandas(extract, "h long, lang string, at array<long>, v array<double>").toPandas()
    got = got.assign(size=got["at"].map(len)).sort_values(["h", "lang", "size"], ignore_index=True)
    classes = sorted(got["lang"].unique())
    if not classes:
        return {"classes": []}
    y = got["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy()
    rows = [(np.asarray(a, np.int64), np.asarray(v, float)) for a, v in zip(got["at"], got["v"])]
    held = np.arange(len(y)) % 5 == 4
    w, b = ftrl([r for r, o in zip(rows, held) if not o], y[~held], len(classes))
    temperature = 1.0
    if held.any():
        s = np.array([v @ w[a] + b for (a, v), o in zip(rows, held) if o])

        def loss(t):
            q = s / t
            return float(np.mean(np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(q)), y[held]]))

        temperature = min(np.geomspace(0.1, 10, 61), key=loss)
    return {"classes": classes, "w": w, "b": b, "idf": idf, "t": float(temperature)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; null text or text without a letter is `und` with score 0, and so
    is everything if nothing was learned. Rows are independent; other columns are ignored; an empty table gives no rows."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                if not t or not model["classes"] or not any(c.isalpha() for c in t):
                    out.append(("und", 0.0))
                    continue
                at, v = vector(t, model["idf"])
                s = (v @ model["w"][at] + model["b"]) / model["t"]
                p = np.exp(s - s.max())
                k = int(np.argmax(p))
                out.append((model["classes"][k], float(p[k] / p.sum())))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [o[0] for o in out], "score": [o[1] for o in out]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


ship(__name__)
