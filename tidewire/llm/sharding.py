"""Sharding: rendezvous hashing of stable record keys over weighted shards, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Row numbers are counted within so many slices of a shard, so no shard is numbered by one task.
SLOT_SLICES = 64


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the smallest -ln(u) / weight, u drawn from a hash of (key, shard); ties go to the lower shard.

    A further shard only adds a candidate, so a row either stays or moves to the new shard; a shard of weight w
    gets a share in proportion to w. A null key is a key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shares = F.array(*[F.lit(float(w)) for w in weights])

    def score(weight: Column, shard: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.ln(u) / weight).alias("score"), shard.alias("shard"))

    return F.array_min(F.transform(shares, score))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0, slices: int = SLOT_SLICES) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: record key and shard weights alone decide. `slot` numbers the records of a shard from 0
    without gaps in (slice, key) order: row numbers within (shard, slice) plus the counts of the earlier slices,
    a table of shards x slices rows whose size is known, so its broadcast is bounded. Null text has size 16
    and checksum 0; null keys hash like any key; repeated rows get slots of their own; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slice_of = F.pmod(F.xxhash64(F.col(id_col), F.lit("slice")), F.lit(slices)).cast("int")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        rendezvous(F.col(id_col), [*weights, grown_weight]).alias("grown_shard"),
        slice_of.alias("slice"),
    )
    counts = docs.select(rendezvous(F.col(id_col), weights).alias("_shard"), slice_of.alias("_slice")).groupBy("_shard", "_slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_shard", "_slice", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.join(F.broadcast(starts), (F.col("shard") == F.col("_shard")) & (F.col("slice") == F.col("_slice")))
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + within - 1).cast("long").alias("slot"), "grown_shard")
    )
