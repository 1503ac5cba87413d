"""Alignment, phrases and shards against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from codestrata.llm import alignment, licenses, phrases, sharding
from codestrata.llm.queries import tokenizer_path

BASE = "doc_id long, text string, lang string, source string, n_chars long"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"


def frame(spark, rows):
    """Rows of (doc_id, text, lang), with columns that operators use as names of their own."""
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], BASE).withColumns({c: F.lit("x") for c in ("n", "shard", "slot", "block", "phrase", "size", "pair", "prefix")})


# --- alignment -----------------------------------------------------------------------------------------------------
def test_groups_end_at_every_common_end():
    rng = random.Random(1)
    for _ in range(300):
        last = rng.randint(1, 40)
        a, b = (sorted({*rng.sample(range(1, last + 1), rng.randint(0, last)), last}) for _ in range(2))
        want, i, j = [], 0, 0
        for cut in sorted({*a} & {*b}):
            want.append((i, a.index(cut) + 1, j, b.index(cut) + 1))
            i, j = a.index(cut) + 1, b.index(cut) + 1
        runs = alignment.groups(a, b)
        assert runs == want
    assert alignment.groups([], []) == []


def test_segments_part_only_behind_plain_signs():
    for text in ("a b", " a", "a  b", "a\n b", "a  b c", "", " ", "a ", "  ", "x\t y z"):
        runs = [" " + s for s in alignment._segments(text)]
        assert "".join(runs) == " " + text
        assert all(not r[-1].isspace() for r in runs[:-1])


def aligned_by_hand(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(SECOND))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*plain}))}
    out, df = [], collections.Counter()
    for doc, text, _ in rows:
        told = (doc, 0, 0, 0, 0, "", [])
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
                ex, ey, gs, i, j = ends(xb), ends(yb), [], 0, 0
                for cut in sorted({*ex} & {*ey}):
                    k, m = ex.index(cut) + 1, ey.index(cut) + 1
                    gs.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
                    i, j = k, m
                met = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(ex[i] - len(xb[i]), ey[j] - len(yb[j])) < min(ex[i], ey[j])]
                told = (doc, len(x), len(y), len(gs), len(met), hashlib.sha256(";".join(gs).encode()).hexdigest(), met)
                df.update(set(met))
        out.append(told)
    best = collections.Counter()
    for (i, _), n in df.items():
        best[i] = max(best[i], n)
    return sorted((*r[:5], sum(df[p] == best[p[0]] for p in r[6]), sum(df[p] for p in r[6]), r[5]) for r in out)


ODD = [
    None, "", " ", "  ", "a", "a ", "  a", "a  b", "a\n b", "a\n\n  b\tc", "café naïve üß", "中文 Ελ", "\U0001f600\U0001f680 ok", "<|endoftext|> <s> </s> <unk> <0x0A>", "x▁y and more", "▁", "don't I'll we've", "  x　y  z",
    "a\x00b \x1c c\x85 d", "12345 67,890.12", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "Zq9/" * 200, "ﬁ Å é", "the cat sat on the mat. " * 40, "the cat", "the cat", "\r\n", "tail\n", "https://x.y/z?q=1&r=2 a@b.c",
]


def test_alignment_of_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(7, "the cat", "en"), (None, "the cat", None)]
    rows += [(100 + i, "".join(rng.choice(["a", "th", "e ", " ", "\n", "é", "Q", "9", " ", ".", "'s", "\t", "ing "]) for _ in range(rng.randint(1, 60))), "en") for i in range(150)]
    key = lambda r: tuple((x is None, x) for x in r)
    for block in (60, 8_000_000):
        got = alignment.align_documents(frame(spark, rows).repartition(3), tokenizer_path(FIRST), tokenizer_path(SECOND), block)
        got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()]
        want = aligned_by_hand([(-1 if i is None else i, t, x) for i, t, x in rows])
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want, key=key)
    empty = alignment.align_documents(frame(spark, []), tokenizer_path(FIRST), tokenizer_path(SECOND))
    assert empty.count() == 0


# --- phrases -------------------------------------------------------------------------------------------------------
def phrases_by_hand(rows, least, top, longest=5):
    f, total = collections.Counter(), collections.Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if any(x == lang and len(q) > len(p) and n >= a and inside(p, q) for (x, q), n in found.items()):
            continue
        n = total[lang]
        score, _, left, right = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right, n))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n, -score) for lang, every in out.items() for i, (score, a, p, left, right, n) in enumerate(sorted(every)[:top]))


@pytest.mark.parametrize(("least", "top", "longest"), [(3, 2000, 5), (4, 7, 5), (2, 2000, 3), (2, 50, 2)])
def test_phrases(spark, least, top, longest):
    rng = random.Random(least)
    words = ["a", "B", "b", "é", "É", "the", "The", "cat", "中", "\x00", "x'y", "a" * 300]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for i in range(60)]
    rows += [(None, None, "en"), (1, "", None), (1, "...", "en"), *[(5, "one passage that repeats in many rows", "en")] * 9]
    got = [tuple(r) for r in phrases.phrases(frame(spark, rows).repartition(3), least, longest, top).collect()]
    assert sorted(got) == phrases_by_hand(rows, least, top, longest)


def test_phrases_in_small_runs_and_of_nothing(spark):
    rows = [(i, "x y z x y z " * 30, "en") for i in range(4)]
    whole = phrases.stripes(frame(spark, rows), (1,)).filter("size > 0").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, phrases.stripes(frame(spark, rows), (1,), slots=3, most=10).filter("size > 0").collect()))
    assert phrases.phrases(frame(spark, [])).count() == 0
    assert phrases.phrases(frame(spark, [(1, None, None), (2, "a. b", "en")])).count() == 0


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12, 10**14, 10**12 + 1, 3 * 10**12), (7 * 10**13, 9 * 10**14, 7 * 10**13, 7 * 10**13 + 11)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases._score(*[F.col(c) for c in "anlr"])).collect()
    assert [r[0] for r in got] == [1000 * a * n // (left * right) for a, n, left, right in rows]


# --- shards --------------------------------------------------------------------------------------------------------
def draw(key, label, weight):
    h = xxhash.xxh64_intdigest(key.encode(), seed=xxhash.xxh64_intdigest(label.encode(), seed=42))
    return -math.log(((h >> 12) + 0.5) / 2**52) / weight


def shard_by_hand(key, layout):
    key = "" if key is None else str(key)
    first = [x for x in layout if x.step == 0]
    weigh = lambda n, *at: sum(x.weight for x in first if x[: len(at)] == at)
    tops = [(draw(key, r, weigh(1, r)), r, None) for r in sorted({x.region for x in first})]
    tops += [(draw(key, f"{x.region}/{x.rack}/{x.shard}+{x.step}", x.weight), "", x.shard) for x in layout if x.step]
    _, region, new = min(tops, key=lambda t: t[0])
    if new is not None:
        return new
    _, rack = min((draw(key, f"{region}/{k}", weigh(2, region, k)), k) for k in sorted({x.rack for x in first if x.region == region}))
    return min((draw(key, f"{region}/{rack}/{x.shard}", x.weight), x.shard) for x in first if x[:2] == (region, rack))[1]


def test_shards_of_odd_rows(spark):
    rows = [(i, "x" * (i % 50), "en") for i in range(3000)] + [(-5, None, None), (None, "", None), (None, None, "en"), (2**63 - 1, "é中", "en")] + [(9, "same", "en")] * 700
    got = sharding.shard_documents(frame(spark, rows).repartition(5), most=64).collect()
    assert len(got) == len(rows)
    text = lambda t: (t or "").encode()
    wider = sharding.grown(sharding.LAYOUT, "region0", "rack00", 24)
    want = collections.Counter((i, len(text(t)) + 8, zlib.crc32(text(t)), shard_by_hand(i, sharding.LAYOUT), shard_by_hand(i, wider)) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24)) and {r.law for r in got} == {"key"}
    again = sharding.shard_documents(frame(spark, rows[::-1]).repartition(2), most=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def placed(spark, layout, n=20_000):
    return [r[0] for r in spark.range(n).select(sharding.shard_of(F.col("id"), layout)).collect()]


def test_growth_takes_rows_only_into_the_new_shard_and_in_proportion(spark):
    layout = sharding.LAYOUT
    was = placed(spark, layout)
    assert all(abs(n - 20_000 / 24) < 150 for n in collections.Counter(was).values())
    for shard, weight in ((24, 1.0), (25, 2.0), (3, 0.5)):  # the third gives a known shard more weight
        layout = sharding.grown(layout, "region1", "rack10", shard, weight)
        now = placed(spark, layout)
        moved = [b for a, b in zip(was, now) if a != b]
        assert moved and set(moved) == {shard}
        was = now
    n = collections.Counter(was)
    assert abs(n[25] - 2 * 20_000 / 27.5) < 200 and abs(n[24] - 20_000 / 27.5) < 150


def test_changed_weights_move_rows_of_their_subtree_only(spark):
    was = placed(spark, sharding.LAYOUT)
    rack = lambda s: s // 4
    # the weight moves within a rack, so no other rack and no region sees a change
    level = [x._replace(weight={0: 0.25, 1: 1.75}.get(x.shard, 1.0)) for x in sharding.LAYOUT]
    assert {rack(a) for a, b in zip(was, placed(spark, level)) if a != b} == {0} and all(rack(a) == rack(b) for a, b in zip(was, placed(spark, level)))
    # a rack loses weight: rows leave it or move in its region, none goes between other racks of the other region
    less = [x._replace(weight=0.25 if x.rack == "rack00" else 1.0) for x in sharding.LAYOUT]
    moves = {(rack(a), rack(b)) for a, b in zip(was, placed(spark, less)) if a != b}
    assert all(a < 3 for a, _ in moves) and all(a == 0 for a, b in moves if b < 3)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [sharding.Shard("r", "k", 0, 0.0)])


# --- licences ------------------------------------------------------------------------------------------------------
def test_every_sentence_is_found_by_itself(spark):
    wordings = [(i, name, w) for i, (w, name) in enumerate(sorted(licenses._WORDINGS.items()))]
    rows = [(i, "Foreword here.\n\n# " + w.replace(" ", "\n# ", 3).capitalize() + ".\n") for i, _, w in wordings]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(w, got[i]) for i, name, w in wordings if name not in got[i]] == []


def test_sentences_need_no_other_word_of_licences(spark):
    text = "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, "nothing of it"), (3, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["sentence_ids"] for r in rows} == {1: ["mit-as-is"], 2: [], 3: []}
