"""As-of questions without range joins: events and asked times of a key lie on one timeline, and running aggregates pass over it.

A key of up to HOT rows is passed over at once. Longer ones are cut into slices of time (at most SLICES, by approximate quantiles of their times), so
that a key with a third of all rows is many tasks; the totals of a key's earlier slices, a row a slice, are added. Events come in with one row for each (key, time),
summed before the shuffle, so that many events of one moment are one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.operators.slices import hot_sliced
from tidewire.sources.io import materialise


def same(left: Sequence[str], right: Sequence[str]):
    """Null-safe equality of the columns, pair by pair."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def as_of(events: DataFrame, asks: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), maxes: Sequence[str] = (), after: bool = False, strict: bool = False, short: bool = False) -> DataFrame:
    """Every distinct ask (keys, us) with the sums and greatest values of the key's events up to us; from us on if `after`; without those
    at us if `strict`. us is a time in microseconds. Sums without events are 0, greatest values null; null keys are a key, null times are left out.
    short: it is known that no key has more than HOT rows."""
    time = -F.col("us") if after else F.col("us")
    kind = lambda ask: F.lit(int(ask != strict))
    asked = asks.where("us is not null").select(*keys, "us").distinct().select(*keys, time.alias("_t"), kind(True).alias("_kind"), F.lit(True).alias("_ask"))
    told = events.where("us is not null").select(*keys, time.alias("_t"), kind(False).alias("_kind"), F.lit(False).alias("_ask"), *sums, *maxes)
    rows = told.unionByName(asked, allowMissingColumns=True)
    rows, hot = (rows, None) if short else hot_sliced(materialise(rows, "timeline"), list(keys), F.col("_t"))
    inside = Window.partitionBy(*keys, *(["_slice"] if hot else [])).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    values = {**{c: F.sum for c in sums}, **{c: F.max for c in maxes}}
    run = rows.withColumns({f"_in_{c}": f(c).over(inside) for c, f in values.items()}).where("_ask")
    met = run.withColumns({f"_before_{c}": F.lit(None) for c in values}) if hot is None else run.join(F.broadcast(_before(hot, keys, values)), same([*keys, "_slice"], [*[f"_k{i}" for i in range(len(keys))], "_s"]), "left")
    zero = lambda c: F.coalesce(F.col(f"_in_{c}"), F.lit(0)) + F.coalesce(F.col(f"_before_{c}"), F.lit(0))
    return met.select(*keys, time_back(after).alias("us"), *[zero(c).alias(c) for c in sums], *[F.greatest(f"_in_{c}", f"_before_{c}").alias(c) for c in maxes])


def _before(hot: DataFrame, keys: Sequence[str], values: dict) -> DataFrame:
    """(_k0, .., _s, _before_*): what the slices of a key before each of its slices add up to, a row a slice."""
    of = [f"_k{i}" for i in range(len(keys))]
    totals = hot.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], F.col("_slice").alias("_s")).agg(*[f(c).alias(f"_total_{c}") for c, f in values.items()])  # asks add nothing
    earlier = Window.partitionBy(*of).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*of, "_s", *[f(f"_total_{c}").over(earlier).alias(f"_before_{c}") for c, f in values.items()])


def time_back(after: bool):
    return -F.col("_t") if after else F.col("_t")


def changes(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """values (keys, us, value; one row for each key and time) with `first`, whether it is the key's first, and `delta`, the change since the
    one before (the value itself for the first). A key of more than HOT rows is cut into slices of time; the last value of a slice goes to the next."""
    rows, hot = hot_sliced(materialise(values, "changes"), list(keys), F.col("us"))
    last = F.lag(value).over(Window.partitionBy(*keys, *(["_slice"] if hot else [])).orderBy("us"))
    met = rows.withColumn("_last", last)
    if hot is None:
        met = met.withColumn("_end", F.lit(None).cast(values.schema[value].dataType))
    else:
        of = [f"_k{i}" for i in range(len(keys))]
        ends = hot.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], F.col("_slice").alias("_s")).agg(F.max_by(value, "us").alias("_end"))
        ends = ends.select(*of, "_s", F.lag("_end").over(Window.partitionBy(*of).orderBy("_s")).alias("_end"))
        met = met.join(F.broadcast(ends), same([*keys, "_slice"], [*of, "_s"]), "left")
    known = F.coalesce("_last", "_end")
    return met.select(*keys, "us", value, known.isNull().alias("first"), (F.col(value) - F.coalesce(known, F.lit(0))).alias("delta"))
