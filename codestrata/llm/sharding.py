"""Shards from a weighted hash tree: a row descends regions, racks and shards by the earliest of weighted hash draws."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import buckets_of, checkpoint


class Shard(NamedTuple):
    """A leaf of the tree. step: 0 for the first layout; later additions (new shards, or more weight for a known one) count up."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0
    step: int = 0


#: Two regions of three racks of four shards.
LAYOUT = tuple(Shard(f"region{r}", f"rack{r}{k}", 12 * r + 4 * k + s) for r in range(2) for k in range(3) for s in range(4))


def grown(layout: Iterable[Shard], region: str, rack: str, shard: int, weight: float = 1.0) -> tuple[Shard, ...]:
    """The layout with one addition more."""
    layout = tuple(layout)
    return (*layout, Shard(region, rack, shard, weight, 1 + max((x.step for x in layout), default=-1)))


def _draw(key: Column, label: str, weight: float) -> Column:
    """An arrival time, exponential with rate `weight`: -ln(u) / weight, u from 52 bits of a hash of label and key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(label), key), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def _earliest(draws: list[tuple[Column, int]]) -> Column:
    """The number that comes with the earliest draw; ties go to the smaller number."""
    both = [F.struct(d.alias("at"), F.lit(i).alias("i")) for d, i in draws]
    return (F.least(*both) if len(both) > 1 else both[0])["i"]


def _pick(choice: Column, answers: list[Column]) -> Column:
    """answers[choice]; only the chosen one is computed."""
    return reduce(lambda so_far, x: F.when(choice == x[0], x[1]).otherwise(so_far), list(enumerate(answers))[-2::-1], answers[-1])


def shard_of(key: Column, layout: Iterable[Shard] = LAYOUT) -> Column:
    """The shard of a key (a null key counts as the empty text).

    The first layout is a tree: a row goes to the region with the earliest draw, in it to the rack and in that to the shard,
    each weighted by all that is below. A later addition is a draw of its own, weighted like its shard, beside the regions:
    it is the part by which its region, its rack and its shard grow at once. A row that this draw takes goes to its shard;
    all others stay where they were. So additions take rows only into their shard, and a changed weight in the first layout
    moves rows between parts of its own subtree and into or out of it, never between other subtrees.
    """
    layout = tuple(layout)
    if any(x.weight <= 0 or x.step < 0 for x in layout) or len({(x.shard, x.step) for x in layout}) < len(layout) or not any(x.step == 0 for x in layout):
        raise ValueError("weights must be positive, steps 0 or more with a first layout, and a shard at most once a step")
    key = F.coalesce(key.cast("string"), F.lit(""))
    tree: dict[str, dict[str, list[Shard]]] = {}
    for x in sorted((x for x in layout if x.step == 0), key=lambda x: x[:3]):
        tree.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    regions = []
    for region, racks in tree.items():
        inside = [_earliest([(_draw(key, f"{region}/{rack}/{x.shard}", x.weight), x.shard) for x in leaves]) for rack, leaves in racks.items()]
        rack = _earliest([(_draw(key, f"{region}/{rack}", sum(x.weight for x in leaves)), i) for i, (rack, leaves) in enumerate(racks.items())])
        regions.append(_pick(rack, inside))
    tops = [(_draw(key, region, sum(x.weight for leaves in racks.values() for x in leaves)), i) for i, (region, racks) in enumerate(tree.items())]
    later = [x for x in layout if x.step > 0]
    tops += [(_draw(key, f"{x.region}/{x.rack}/{x.shard}+{x.step}", x.weight), len(tree) + i) for i, x in enumerate(later)]
    return _pick(_earliest(tops), [*regions, *[F.lit(x.shard) for x in later]]).cast("int")


def shard_documents(docs: DataFrame, layout: Iterable[Shard] = LAYOUT, wider: Iterable[Shard] | None = None, most: int = 65_536) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    shard is decided by doc_id and the layout, grown_shard by doc_id and `wider` (by default the layout with one shard more
    in its first region). slot numbers the rows of a shard from 0 without gaps, by hash, then doc_id, size and crc32. Null
    text has size 8 (no bytes); a null id counts as the empty text and is one key like any other; rows alike are counted
    first and get neighbouring slots each; other columns are ignored; an empty table gives no rows.

    No group grows with the input: rows alike are combined before they travel, a shard's rows are numbered in buckets of
    some square root of them, and a row that stands for more than `most` rows alike is unfolded in pieces. The driver sees
    a count a shard.
    """
    layout = tuple(layout)
    if wider is None:
        wider = grown(layout, *min(layout)[:2], max(x.shard for x in layout) + 1)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    own = ["doc_id", "size", "text_crc32"]
    alike = rows.groupBy(*own).agg(F.count("*").alias("n"))
    alike = checkpoint(alike.withColumns({"shard": shard_of(F.col("doc_id"), layout), "grown_shard": shard_of(F.col("doc_id"), wider), "h": F.xxhash64(*own)}))
    counts = {r["shard"]: r["n"] for r in alike.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    n_buckets = _pick_number(F.col("shard"), {s: buckets_of(n) for s, n in counts.items()})
    alike = alike.withColumn("bucket", F.pmod("h", n_buckets).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = alike.groupBy("shard", "bucket").agg(F.sum("n").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    inside = Window.partitionBy("shard", "bucket").orderBy("h", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["shard", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    keep = [*own, "shard", "grown_shard"]
    few = placed.filter(F.col("n") <= most).select(*keep, "at", "n")
    many = placed.filter(F.col("n") > most).select(*keep, "at", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most))).alias("piece"))
    many = many.repartition(*keep, "piece").select(*keep, (F.col("at") + F.col("piece") * most).alias("at"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("n"))
    slots = few.unionByName(many).select(*keep, F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("slot"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _pick_number(choice: Column, numbers: dict[int, int]) -> Column:
    """numbers[choice], by a literal map of one entry a shard."""
    if not numbers:
        return F.lit(1)
    return F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[choice]
