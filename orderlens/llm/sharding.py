"""Operator 3: sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Leaves are shards with weights, grouped into racks and regions. For a key, every shard draws a waiting time from the hash of key and
shard's place in the tree, exponential with the shard's weight as its rate: -ln(u) / weight. A rack's draw is the smallest of its
shards', and so exponential with the rack's summed weight; a region's is the smallest of its racks'. A key descends to the region, the
rack in it and the shard in that which drew the least, and reaches each with a probability in proportion to its weight.

A shard's draw depends on its own weight alone: more weight makes it smaller, less makes it larger, and no other draw changes. So
where one weight changes, up, down, from or to nothing, keys move into that shard or out of it, and none moves between shards, racks
or regions whose weights stay. That is the law `key` for a shard that is added, wherever it stands. A key costs a draw a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, small

#: Buckets a shard's rows are counted in, so that slots need no task with a whole shard.
SLOT_BUCKETS = 1024
#: Slots of like rows that are made at once.
SLOT_RUN = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks_per_region: int = 2, weights: Sequence[float] | None = None) -> list[Leaf]:
    """Shards 0..n-1 dealt in order to racks and regions; all weigh 1 unless weights are given."""
    if shards < 1:
        raise ValueError("a tree has one shard at least")
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s, 1.0 if weights is None else float(weights[s])) for s in range(shards)]


def _draw(key: Column, region: Column, rack: Column, shard: Column, weight: Column) -> Column:
    """The waiting time of a key for a shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, region, rack, shard), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.ln(u) / weight


def place(docs: DataFrame, leaves: Sequence[Leaf], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard (int) that its key reaches. A null key is a key like any other; equal keys share a shard. Equal draws: the
    smaller region, rack and shard wins. A leaf that is listed twice has both weights; leaves of no weight get nothing."""
    weights: dict[int, dict[int, dict[int, float]]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            own = weights.setdefault(leaf.region, {}).setdefault(leaf.rack, {})
            own[leaf.shard] = own.get(leaf.shard, 0.0) + leaf.weight
    if not weights:
        raise ValueError("a tree has some weight")

    def listed(name: str, nodes: dict, inner: Callable[..., Column]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias(name), inner(nodes[n]).alias("own")) for n in sorted(nodes)])

    tree_ = listed("region", weights, lambda racks: listed("rack", racks, lambda shards: listed("shard", shards, F.lit)))

    def shard_draw(region: Column, rack: Column, x: Column) -> Column:
        return F.struct(_draw(F.col(key), region, rack, x["shard"], x["own"]).alias("draw"), region.alias("region"), rack.alias("rack"), x["shard"].alias("shard"))

    def rack_draw(region: Column, x: Column) -> Column:
        return F.array_min(F.transform(x["own"], lambda shard: shard_draw(region, x["rack"], shard)))

    def region_draw(x: Column) -> Column:
        return F.array_min(F.transform(x["own"], lambda rack: rack_draw(x["region"], rack)))

    return docs.withColumn(name, F.array_min(F.transform(tree_, region_draw))["shard"].cast("int"))


def slots(placed: DataFrame, columns: Sequence[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """placed with slot (long): numbers 0, 1, ... without gaps in each shard.

    Rows are counted by (shard, hash bucket of columns); a slot is the rows of the earlier buckets plus the place in one's own. Rows
    alike in all columns are one row with a count until the end, so many of them are no load for one task.
    """
    rows = placed.withColumn("_bucket", F.pmod(F.xxhash64(*columns, F.lit("slot")), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    kinds = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("shard", "_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("_own", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    start = F.col("_offset") + F.col("_own")
    out = kinds.join(small(cut(offsets)), ["shard", "_bucket"]).withColumn("_end", start + F.col("_n") - 1)
    out = out.withColumn("_run", F.explode(F.sequence(start, "_end", F.lit(SLOT_RUN).cast("long"))))  # no array of all rows of a kind
    return out.withColumn("slot", F.explode(F.sequence("_run", F.least("_end", F.col("_run") + SLOT_RUN - 1)))).select(*placed.columns, "slot")


def shard_documents(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty, with crc32 0. law is `key`: doc_id and the tree decide.
    grown_shard is the shard under the tree `grown` (null if none is given). Copies of a text lie wherever their keys put them;
    repeated rows get slots of their own; a null doc_id is one more key; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = place(rows, leaves)
    rows = place(rows, grown, name="grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    out = slots(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
