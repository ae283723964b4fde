"""Ordered work dealt out: slices by approximate quantiles, and a fold over sorted keys that holds one anchor."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.sources.io import materialise

SLICES = 64
HOT = 1_000_000  # rows of a key from which it is dealt out in slices


def sliced(df: DataFrame, value: Column, slices: int = SLICES) -> DataFrame:
    """df with `_slice`, an int that rises with `value`: equal values share a slice, null is in the first. One pass over `value`."""
    cuts = df.select(F.percentile_approx(value, [i / slices for i in range(1, slices)], 1_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))

    def place(low: int, high: int) -> Column:
        """The number of cuts below the value, which is within low and high: a tree of comparisons."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(cuts[middle]), place(middle + 1, high)).otherwise(place(low, middle))

    return df.withColumn("_slice", place(0, len(cuts)))


def long_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with more than HOT rows."""
    return materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).drop("_n"), "long-keys")


def hot_sliced(rows: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, DataFrame | None]:
    """rows with `_slice`: 0 where the key has at most HOT rows; the rows of the other keys lie in slices from 1 on, which rise with `value`. The
    second table has only those others and is None if there are none. rows: a written table, as it is read twice."""
    many = long_keys(rows, keys)
    if many.isEmpty():
        return rows.withColumn("_slice", F.lit(0)), None
    many = F.broadcast(many.withColumnsRenamed({k: f"_h_{k}" for k in keys}))  # at most a HOT-th of the rows
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    hot = sliced(rows.join(many, same, "left_semi"), value).withColumn("_slice", F.col("_slice") + 1)
    return rows.join(many, same, "left_anti").withColumn("_slice", F.lit(0)).unionByName(hot), hot


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number (from 1) within the keys, in order. Rows are dealt by ranges of keys and order, counted within a range, and the few keys
    that a range boundary cuts get the counts of the ranges before; so a key with a third of all rows is many tasks, also where times are equal."""
    dealt = materialise(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    of = [f"_k{i}" for i in range(len(keys))]
    before = F.sum("_n").over(Window.partitionBy(*of).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    cut = counts.withColumn("_before", before).where("_before is not null").drop("_n")  # a row for each range boundary at most
    place = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, of, strict=True)], F.col("_part") == F.col("_p"))
    met = dealt.withColumn("_nth", place).join(F.broadcast(cut), same, "left")
    return met.withColumn(name, F.col("_nth") + F.coalesce("_before", F.lit(0))).drop("_part", "_nth", "_before", "_p", *of)


def fold_anchors(rows: DataFrame, keys: list[str], at: str, micros: int) -> DataFrame:
    """The distinct (keys, at) of rows with `anchor`: a time opens a new anchor if it is more than `micros` after the last (W1, ST6).

    Times are sorted within a key by the shuffle and pass once, a batch at a time; only the open anchor is held, so a key of any
    length needs constant memory and linear time. Null keys are a key; rows without a time are left out.
    """
    kind = rows.schema[at].dataType
    name = F.to_json(F.struct(*keys))
    times = rows.where(F.col(at).isNotNull()).select(*keys, F.col(at), name.alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us")).distinct()
    names = [*times.columns, "_anchor"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, anchor = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("_key").dictionary_encode()
            code, us = codes.indices.to_numpy(), batch.column("_us").to_numpy()
            out = np.empty(len(us), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            for k, to in zip(starts, [*starts[1:], len(us)], strict=True):
                key = codes.dictionary[int(code[k])].as_py()
                if key != held:
                    held, anchor = key, us[k]
                while k < to:
                    if us[k] > anchor + micros:
                        anchor = us[k]
                    end = k + int(np.searchsorted(us[k:to], anchor + micros, side="right"))
                    out[k:end] = anchor
                    k = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in times.schema.fields)
    found = times.repartition("_key").sortWithinPartitions("_key", "_us").mapInArrow(run, f"{fields}, _anchor long")
    return found.select(*keys, at, F.timestamp_micros("_anchor").cast(kind).alias("anchor"))
