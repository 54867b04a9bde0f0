"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A topology is a list of regions, each a list of racks, each a list of shard weights. A row
descends three levels. At each level every child makes a draw ``-ln(u) / weight`` with
``u = hash(key, node) in (0, 1)``; the smallest draw wins, so a child is taken in
proportion to its weight, and changing one child's weight changes no other child's draw.
Rows therefore move only into subtrees whose weight rises or out of those whose weight
falls. ``grow`` hangs each new shard into the tree as a region of its own: all other nodes
keep their weights and draws, so the new shard takes rows only into itself.

The descent costs one hash per child on the path (2 + 3 + 4 for 24 shards), has no shuffle
and no state. Slots need counts: rows are dealt over (shard, bucket) groups of bounded
size, group counts are summed before the shuffle, and a prefix sum over the small count
table gives each group its first slot; no task ever holds a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import utf8_size

Topology = Sequence[Sequence[Sequence[float]]]

#: 24 shards: two regions of three racks of four equal shards.
DEFAULT: Topology = (((1.0,) * 4,) * 3,) * 2

#: Rows that one (shard, bucket) group holds on average, and that one window task sorts at once.
BUCKET_ROWS = 20_000


def grow(topology: Topology, weight: float = 1.0) -> Topology:
    """One more shard, as a region of its own."""
    return (*topology, ((weight,),))


def shard_count(topology: Topology) -> int:
    return sum(len(rack) for region in topology for rack in region)


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u)/weight; a child of weight 0 or less is never taken while another has weight."""
    if weight <= 0:
        return F.lit(float("inf"))
    return -F.log((_hashed(node, key, 13).cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def _hashed(node: str, key: Column, digits: int) -> Column:
    """A number of so many hexadecimal digits out of the MD5 of node and key: any engine can draw the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{node}:"), key)), 1, digits), 16, 10).cast("long")


def _winner(key: Column, path: str, weights: Sequence[float]) -> Column:
    """Index of the child with the smallest draw; the lower index on a tie."""
    if len(weights) == 1:
        return F.lit(0)
    draws = [F.struct(_draw(key, f"{path}/{i}", w).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.least(*draws)["i"]


def _choose(index: Column, options: Sequence[Column]) -> Column:
    if len(options) == 1:
        return options[0]
    out = F.when(index == 0, options[0])
    for i, option in enumerate(options[1:-1], start=1):
        out = out.when(index == i, option)
    return out.otherwise(options[-1])


def assign(df: DataFrame, key: Column, topology: Topology, prefix: str = "shard") -> DataFrame:
    """Add ``<prefix>_region``, ``<prefix>_rack`` (within its region) and ``<prefix>`` (overall number).

    A null key hashes like any other value, so all rows without a key share a shard.
    """
    if not shard_count(topology) or not any(w > 0 for region in topology for rack in region for w in rack):
        raise ValueError("a topology needs at least one shard of positive weight")
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    region_w = [sum(w for rack in region for w in rack if w > 0) for region in topology]
    out = df.withColumn(f"{prefix}_region", _winner(text, "r", region_w))
    region = F.col(f"{prefix}_region")
    racks = [_winner(text, f"r{r}", [sum(w for w in rack if w > 0) for rack in racks_]) for r, racks_ in enumerate(topology)]
    out = out.withColumn(f"{prefix}_rack", _choose(region, racks))
    rack = F.col(f"{prefix}_rack")
    number, leaves = 0, []
    for r, racks_ in enumerate(topology):
        inner = []
        for k, shards in enumerate(racks_):
            inner.append(F.lit(number) + _winner(text, f"r{r}/k{k}", shards))
            number += len(shards)
        leaves.append(_choose(rack, inner))
    return out.withColumn(prefix, _choose(region, leaves).cast("int"))


def number_slots(df: DataFrame, shard: str, order: Sequence[str], rows: int, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, in the order (bucket, order columns).

    ``rows`` is the row count; it only sets the number of buckets. The first of the order columns
    decides the bucket, so it should be a key of the rows. Equal rows are interchangeable: they
    get different numbers.
    """
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    first_key = F.coalesce(F.col(order[0]).cast("string"), F.lit("\u0000null"))
    dealt = df.withColumn("_bucket", F.pmod(_hashed("slot", first_key, 8), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn("_r", F.row_number().over(inside))
    joined = ranked.join(first, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(slot, (F.col("_first") + F.col("_r") - 1).cast("long")).drop("_bucket", "_r", "_s", "_b", "_first")


def shard_documents(docs: DataFrame, topology: Topology = DEFAULT) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard and the region and rack.

    Law ``key``: doc_id and the topology alone decide, so equal texts under different ids
    may part; null texts have size 8 and the checksum of no bytes; repeated rows each get
    a slot; other columns of the input are not read. An empty table gives an empty result.
    """
    narrow = docs.select("doc_id", (utf8_size("text") + 8).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    placed = assign(assign(narrow, F.col("doc_id"), topology), F.col("doc_id"), grow(topology), prefix="grown_shard")
    slotted = number_slots(placed, "shard", ["doc_id", "text_crc32", "size"], docs.select("doc_id").count())
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"),
    )
