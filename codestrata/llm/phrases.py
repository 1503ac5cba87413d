"""Phrases by stripes: each prefix keys a counter of next words; stripes are built within tasks and merged element by element."""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import LOWER, UPPER, checkpoint, ship, small_batches

SEPARATORS = ".,;:!?\n\x0b\x0c\r"
#: Bytes as they are counted: A-Z lower-cased, separators as line feeds, tabs as blanks. All are ASCII, so UTF-8 stays whole.
BYTES = bytes.maketrans((UPPER + SEPARATORS + "\t").encode(), (LOWER + "\n" * len(SEPARATORS) + " ").encode())
#: Stripes of one run, language, size and slot as they travel: prefixes and next words by line (neither holds a line feed), how many
#: next words each prefix has, and their counts; all packed.
PACKED = "slot int, lang string, size int, prefixes binary, next binary, lengths binary, n binary"
ARROW = pa.schema([("slot", pa.int32()), ("lang", pa.string()), ("size", pa.int32()), ("prefixes", pa.binary()), ("next", pa.binary()), ("lengths", pa.binary()), ("n", pa.binary())])
#: Bits of the filter that tells tasks what was frequent in the round before: 8 MB, whatever the input.
BITS = 1 << 26


def _hash(lang: bytes, phrases: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, phrases, repeat(zlib.crc32(lang + b"\n"))), np.int64, len(phrases)) % BITS


def _filter(frequent: DataFrame) -> np.ndarray:
    """A bit for each frequent (lang, phrase) at its hash; other phrases may share a bit. At most BITS / 64 rows reach the driver."""
    h = F.crc32(F.concat_ws("\n", "lang", "phrase").cast("binary")) % BITS
    cells = frequent.select(h.alias("h")).select(F.shiftright("h", 6).alias("cell"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h >> 6] >> (h & 63)) & 1 == 1


class _Words(dict):
    """Numbers for words, in order of their first use; 0 is the line feed between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _crcs(phrases: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, phrases), np.uint64, len(phrases))


def _stripes(lang: str, size: int, slots: int, prefixes: list[bytes], words: list[bytes], a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Elements (prefix number a, word number b, count n), in order of a, as packed stripes. An element's slot comes from its
    prefix and its word, so that a hot prefix is in many."""
    slot = ((_crcs(prefixes)[a] * np.uint64(0x9E3779B1) + _crcs(words)[b] * np.uint64(0x85EBCA77)) >> np.uint64(13)) % np.uint64(slots)
    order = np.argsort(slot, kind="stable")
    slot, a, b, n = slot[order].astype(np.int32), a[order], b[order], n[order].astype("<u4")
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    out = {k: [] for k in ARROW.names}
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(slot)]):
        starts = lo + np.flatnonzero(np.diff(a[lo:hi], prepend=-1))
        lengths = np.diff(starts, append=hi).astype("<u4")
        joined = [b"\n".join([prefixes[i] for i in a[starts].tolist()]), b"\n".join([words[i] for i in b[lo:hi].tolist()]), lengths.tobytes(), n[lo:hi].tobytes()]
        for k, v in zip(out, (int(slot[lo]), lang, size, *[zlib.compress(x, 1) for x in joined])):
            out[k].append(v)
    return pa.RecordBatch.from_pydict(out, schema=ARROW)


def _merged(rows: pa.Table, least: int) -> pa.Table:
    """The stripes of one slot added up, element by element: elements that occur `least` times, and a row of size 0 a language
    with the sum of all counts."""
    counters: dict[tuple[str, int], dict[bytes, dict[bytes, int]]] = {}
    total: dict[str, int] = {}
    for lang, size, *packed in zip(*(rows.column(k).to_pylist() for k in ARROW.names[1:])):
        prefixes, words, lengths, n = map(zlib.decompress, packed)
        stripes_, at = counters.setdefault((lang, size), {}), 0
        words, n = words.split(b"\n"), np.frombuffer(n, "<u4").tolist()
        total[lang] = total.get(lang, 0) + sum(n)
        for prefix, length in zip(prefixes.split(b"\n"), np.frombuffer(lengths, "<u4").tolist()):
            counter = stripes_.setdefault(prefix, {})
            for word, more in zip(words[at : at + length], n[at : at + length]):
                counter[word] = counter.get(word, 0) + more
            at += length
    out = [(lang, size, prefix, word, n) for (lang, size), stripes_ in counters.items() for prefix, counter in stripes_.items() for word, n in counter.items() if n >= least]
    out += [(lang, 0, b"", b"", n) for lang, n in total.items()]
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["lang", "size", "prefix", "next", "n"])


def _count(lang: str, codes: np.ndarray, words: list[bytes], sizes: tuple[int, ...], known: np.ndarray | None, slots: int):
    """Stripes of phrases of these sizes in a run of words. known: frequent words (for pairs) or frequent pairs (for more)."""
    arrow, tag = pa.array(words, pa.binary()), lang.encode()
    if sizes == (1,):
        n = np.bincount(codes, minlength=len(words))
        n[0] = 0
        at = np.flatnonzero(n)
        if len(at):
            yield _stripes(lang, 1, slots, [b""], words, np.zeros(len(at), np.int64), at, n[at])
        return
    ok = codes != 0
    if sizes == (2,):
        here = np.flatnonzero(np.bincount(codes, minlength=len(words)))
        common = np.zeros(len(words), bool)
        common[here] = _has(known, _hash(tag, [words[i] for i in here.tolist()]))
        ok &= common[codes]
    at = np.flatnonzero(ok[:-1] & ok[1:])
    pairs, number, n = np.unique(codes[at] * np.int64(len(words)) + codes[at + 1], return_inverse=True, return_counts=True)
    first, second = np.divmod(pairs, len(words))
    if sizes == (2,):
        if len(pairs):
            yield _stripes(lang, 2, slots, words, words, first, second, n)
        return
    phrases = pc.binary_join_element_wise(arrow.take(pa.array(first)), arrow.take(pa.array(second)), b" ")
    good = _has(known, _hash(tag, phrases.to_pylist())) if len(pairs) else np.zeros(0, bool)
    at, number = at[good[number]], number[good[number]]
    starts = np.zeros(len(codes) + 1, bool)
    starts[at] = True
    for size in sizes:
        # a phrase goes on where its next pair is frequent too
        on = starts[at + size - 2]
        at, number = at[on], number[on]
        if not len(at):
            return
        both, inverse, n = np.unique(number * np.int64(len(words)) + codes[at + size - 1], return_inverse=True, return_counts=True)
        a, b = np.divmod(both, len(words))
        yield _stripes(lang, size, slots, phrases.to_pylist(), words, a, b, n)
        phrases, number = pc.binary_join_element_wise(phrases.take(pa.array(a)), arrow.take(pa.array(b)), b" "), inverse


def stripes(docs: DataFrame, sizes: tuple[int, ...], least: int = 1, known: np.ndarray | None = None, slots: int = 128, most: int = 2_000_000) -> DataFrame:
    """Merged stripes of phrases of these sizes: lang, size, prefix, next, n, a row an element that occurs `least` times; and
    rows of size 0 whose n add up to a language's occurrences.

    A task counts runs of up to `most` words (one longer text may exceed that) in associative counters, a stripe a prefix.
    Stripes travel packed, dealt to `slots` by prefix and next word, and each slot adds its own up element by element.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches):
        bits = sent.value if sent is not None else None
        held, number, total, letters = {}, _Words({b"\n": 0}), 0, 0

        def flush():
            words = list(number)
            for lang, parts in held.items():
                yield from _count(lang, np.concatenate(parts), words, sizes, bits, slots)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tokens = text.translate(BYTES).replace(b"\n", b" \n ").split(b" ")
                codes = np.fromiter(map(number.__getitem__, filter(None, tokens)), np.int64)
                if not len(codes):
                    continue
                held.setdefault(lang, []).append(np.append(codes, 0))
                total += len(codes) + 1
                letters += len(text)
                if total >= most or letters >= 8 * most:
                    yield from flush()
                    held, number, total, letters = {}, _Words({b"\n": 0}), 0, 0
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    made = rows.mapInArrow(run, PACKED).groupBy("slot").applyInArrow(lambda table: _merged(table, least), "lang string, size int, prefix binary, next binary, n long")
    return made.withColumns({c: F.col(c).cast("string") for c in ("prefix", "next")})


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals of 38 digits: exact for up to 10^15 words."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = F.lit(1000).cast("decimal(4,0)") * wide(a, 16) * wide(n, 15)
    return F.call_function("div", top, wide(left, 16) * wide(right, 16))


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, salts: int = 64) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to `longest` words that occur at least `least` times within pieces are candidates. A phrase is no more
    frequent than its words and pairs, so three passes over the texts suffice: words, pairs of frequent words, and longer phrases
    all of whose pairs are frequent. What is frequent reaches tasks as a bitmap of fixed size, which may let too much through
    but never too little; counts decide. The merged stripes give extensions (a row each), what a phrase's first part and rest
    have (rows of the same table) and, as the largest count over a phrase's extensions to either side, whether a longer
    candidate holds it in all its occurrences.

    Null text is empty, null lang is `und`; repeated rows count each; other columns are ignored; an empty table gives no rows.
    Ties of score and count go by phrase in byte order.
    """
    small_batches(docs.sparkSession)
    # a slot for some two million words, so that its counters fit a task however large the corpus
    slots = max(128, (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // 12_000_000)
    words = checkpoint(stripes(docs, (1,), least, slots=slots))
    totals = words.filter("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    single = words.filter("size > 0").select("lang", F.col("next").alias("phrase"), F.col("n").alias("f"))
    pairs = checkpoint(stripes(docs, (2,), least, _filter(single), slots).filter("size > 0"))
    joined = F.concat_ws(" ", "prefix", "next").alias("phrase")
    found = pairs
    if longest > 2:
        known = _filter(pairs.select("lang", joined))
        found = pairs.unionByName(checkpoint(stripes(docs, tuple(range(3, longest + 1)), least, known, slots).filter("size > 0")))
    candidates = found.select("lang", joined, "size", F.col("n").alias("a"), "prefix")
    # a word more on either side: the stripe's own prefix, and the phrase without its first word
    shorter = F.explode(F.array("prefix", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))).alias("phrase")
    covered = candidates.filter("size > 2").select("lang", shorter, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter("longer is null or longer < a").select("lang", "phrase", "size", "a")
    counts = single.unionByName(candidates.select("lang", "phrase", F.col("a").alias("f")))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)")})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first among a salt's phrases, so no task sorts a language's phrases whole
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
w AS (SELECT lang, id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w1 FROM p),
x AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS size, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL
 UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM x WHERE w5 IS NOT NULL),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 100),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1 : size - 1], ' '), array_to_string(ws[2 : size], ' ')]) AS phrase FROM c WHERE size > 2) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1 : k], ' ') AS first, array_to_string(ws[k + 1 : size], ' ') AS rest FROM c LEFT JOIN longer USING (lang, phrase), range(1, 5) s(k) WHERE k < size AND coalesce(longer, 0) < c.a),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = first JOIN f r ON r.lang = cuts.lang AND r.phrase = rest JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
"""
ship(__name__)
