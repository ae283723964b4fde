"""Folding of reports, outcomes, source reliability and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.operators.slices import fold_anchors, numbered, sliced
from tidewire.sources.io import materialise

SETTLED = 20  # outcomes from which the running score is the plain hit rate


def assign_rumours(reports: DataFrame, days: int = 7) -> DataFrame:
    """Every report with the first report time of its rumour (W1): a (player, from, to) report joins the rumour that was opened
    at most `days` before. Only the distinct times of a key are folded; reports find their anchor by a join."""
    keys = ["player_id", "from_club_id", "to_club_id"]
    folded = fold_anchors(reports, keys, "rumour_date", days * 86_400_000_000)
    by_time = folded.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rumour_date").alias("_t"), "anchor")
    on = F.col("rumour_date") == F.col("_t")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return reports.join(by_time, on).drop("_t", *[f"_{k}" for k in keys])


def corroboration_count(assigned: DataFrame) -> DataFrame:
    """Reports folded into each rumour, repeats counted, and the distinct sources."""
    return assigned.groupBy("player_id", "from_club_id", "to_club_id", "anchor").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("source_id").alias("sources"))


def rate_limit_audit(usage: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Requests with their place in the key's window, which starts at its first request (ST6)."""
    folded = fold_anchors(usage, ["api_key_id"], "created_at", seconds * 1_000_000 - 1)
    at = folded.select(F.col("api_key_id").alias("_k"), F.col("created_at").alias("_t"), F.col("anchor").alias("window_start"))
    rows = usage.join(at, (F.col("api_key_id") == F.col("_k")) & (F.col("created_at") == F.col("_t")))
    counted = numbered(rows.select("id", "api_key_id", "created_at", "window_start"), ["api_key_id", "window_start"], [F.col("created_at"), F.col("id")], "n")
    return counted.withColumn("n", F.col("n").cast("int")).select("id", "api_key_id", "created_at", "window_start", "n", (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("n")).alias("remaining"))


def _step(score: Column, hits: Column, n: Column) -> Column:
    w = F.least(n / 20.0, F.lit(1.0))
    return F.greatest(F.lit(0.1), F.least(F.lit(0.99), score * (1 - w) + hits / n * w))


def reliability_fold(score: Column, hits: Column, n: Column, results: Column) -> Column:
    """The score after results (array of 1 and 0) in order, from a stored score, hits and count."""
    start = F.struct(score.cast("double").alias("score"), hits.cast("double").alias("hits"), n.cast("double").alias("n"))

    def step(acc: Column, r: Column) -> Column:
        h, m = acc["hits"] + r, acc["n"] + 1
        return F.struct(_step(acc["score"], h, m).alias("score"), h.alias("hits"), m.alias("n"))

    return F.aggregate(results, start, step)["score"]


def source_reliability(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """hits, misses and score of every source after its outcomes (source_id, at, id, hit).

    From 20 outcomes on the score is the clamped hit rate, so counts are combined before the shuffle. Only the first 19
    of each source are ordered and folded, for sources with fewer.
    """
    counts = outcomes.groupBy(F.col("source_id").alias("_s")).agg(F.count(F.lit(1)).alias("new"), F.sum(F.col("hit").cast("int")).alias("new_hits"))
    first = outcomes.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("at", "id"))).where(F.col("k") < SETTLED)
    lists = first.groupBy(F.col("source_id").alias("_t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("hit").cast("double").alias("h")))), lambda x: x["h"]).alias("results"))
    rows = sources.join(counts, F.col("id") == F.col("_s"), "left").join(lists, F.col("id") == F.col("_t"), "left")
    hits, n = F.col("hit_count") + F.coalesce("new_hits", F.lit(0)), F.col("hit_count") + F.col("miss_count") + F.coalesce("new", F.lit(0))
    settled = F.greatest(F.lit(0.1), F.least(F.lit(0.99), hits / F.greatest(n, F.lit(1))))
    folded = reliability_fold(F.col("reliability"), F.col("hit_count"), F.col("hit_count") + F.col("miss_count"), F.col("results"))
    score = F.when(F.coalesce("new", F.lit(0)) == 0, F.col("reliability")).when(n >= SETTLED, settled).otherwise(folded)
    return rows.select("id", hits.cast("long").alias("hits"), (n - hits).cast("long").alias("misses"), score.alias("score"))


def reliability_history(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits, misses and score of each source after every outcome (W10): id, source_id, at, hits, misses, score.

    Outcomes are counted within slices of time, so that no task orders all of a source, and the totals of earlier slices, at most 64
    a source, are added. From SETTLED outcomes on, those stored with the source included, the score is the clamped hit rate; before, it is folded over the source's first outcomes, which
    are fewer than SETTLED. Outcomes of unknown sources start from 0.5 without counts.
    """
    rows = sliced(outcomes, F.unix_micros(F.col("at").cast("timestamp")))
    hit = F.col("hit").cast("int")
    totals = rows.groupBy(F.col("source_id").alias("_s"), F.col("_slice").alias("_k")).agg(F.sum(hit).alias("_h"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_s", "_k", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_h"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    by = Window.partitionBy("source_id", "_slice").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({"_hits": F.sum(hit).over(by), "_all": F.count(F.lit(1)).over(by)})
    met = counted.join(starts, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k")))
    met = met.select("id", "source_id", "at", "hit", (F.col("_hits") + F.col("_h")).alias("_nh"), (F.col("_all") + F.col("_n")).alias("_nth"))
    known = sources.select(F.col("id").alias("_i"), F.col("reliability").alias("_r"), F.col("hit_count").alias("_hc"), F.col("miss_count").alias("_mc"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = materialise(met.join(known, F.col("source_id") == F.col("_i"), "left").withColumns({"_r": F.coalesce("_r", F.lit(0.5)), "_hc": zero("_hc"), "_mc": zero("_mc")}).drop("_i"), "reliability")
    few = met.where(F.col("_nth") < SETTLED)
    lists = few.groupBy(F.col("source_id").alias("_l")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.col("hit").cast("double").alias("h")))), lambda x: x["h"]).alias("_first"))
    early = few.join(lists, F.col("source_id").eqNullSafe(F.col("_l")))
    hits, n = F.col("_nh") + F.col("_hc"), F.col("_nth") + F.col("_hc") + F.col("_mc")
    settled = F.greatest(F.lit(0.1), F.least(F.lit(0.99), hits / n))
    folded = reliability_fold(F.col("_r"), F.col("_hc"), F.col("_hc") + F.col("_mc"), F.slice("_first", F.lit(1), F.col("_nth").cast("int")))
    told = lambda df, score: df.select("id", "source_id", "at", hits.cast("long").alias("hits"), (n - hits).cast("long").alias("misses"), score.alias("score"))
    return told(early, F.when(n >= SETTLED, settled).otherwise(folded)).unionByName(told(met.where(F.col("_nth") >= SETTLED), settled))


def link_contradictions(new: DataFrame, rumours: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(id, contradicts): the likeliest active recent rumour of the player to another club (J10). Per player and destination only
    the best is kept, and of these the two best: one of them has another destination. No pairs are formed."""
    live = rumours.where(F.col("status").isin("PENDING", "HOT") & (F.col("rumour_date") >= now - F.make_dt_interval(F.lit(days))))
    order = F.struct("likelihood", (-F.col("id")).alias("i"))
    best = live.groupBy("player_id", "to_club_id").agg(F.max(order).alias("o"))
    two = best.withColumn("k", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("o")))).where("k <= 2")
    tops = two.groupBy(F.col("player_id").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("k", (-F.col("o.i")).alias("rid"), "to_club_id"))).alias("tops"))
    other = F.get(F.filter("tops", lambda t: t["to_club_id"] != F.col("to_club_id")), F.lit(0))["rid"]
    return new.join(tops, F.col("player_id") == F.col("_p")).select("id", other.alias("contradicts")).where("contradicts is not null")


TERMINAL = ("COMPLETED", "FAILED", "DENIED")


def _settled(rumours: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rumours with `_status`, the status after their outcomes, and `_at`, when it came: the last forced outcome, else for one that was
    open the first."""
    order = F.struct("at", "status")
    forced, free = F.when(F.col("forced"), order), F.when(~F.col("forced"), order)
    one = outcomes.groupBy(F.col("rumour_id").alias("_r")).agg(F.max(forced).alias("_forced"), F.min(free).alias("_first"))
    rows = rumours.join(one, F.col("id") == F.col("_r"), "left")
    said = F.when(F.col("_forced").isNotNull(), F.col("_forced")).when(~F.col("status").isin(*TERMINAL), F.col("_first"))
    return rows.withColumns({"_status": said["status"], "_at": said["at"]}).drop("_r", "_forced", "_first")


def _likelihood(status: Column, before: Column) -> Column:
    return F.when(status == "COMPLETED", 100.0).when(status.isin("FAILED", "DENIED"), 0.0).otherwise(before)


def apply_outcomes(rumours: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rumours after their first terminal outcome, or their last forced one (M12). outcomes: rumour_id, at, status, forced."""
    rows = _settled(rumours, outcomes)
    status = F.coalesce("_status", "status")
    return rows.withColumns({"likelihood": F.when(F.col("_status").isNotNull() | F.col("status").isin(*TERMINAL), _likelihood(status, F.col("likelihood"))).otherwise(F.col("likelihood")), "status": status}).drop("_status", "_at")


def outcome_history(rumours: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The history row of every rumour that its outcomes changed: rumour_id, likelihood, status, recorded_at (M12). An outcome that a rumour has already changes nothing."""
    rows = _settled(rumours, outcomes).where(F.col("_status").isNotNull() & (F.col("_status") != F.col("status")))
    return rows.select(F.col("id").alias("rumour_id"), _likelihood(F.col("_status"), F.col("likelihood")).alias("likelihood"), F.col("_status").alias("status"), F.col("_at").alias("recorded_at"))


def ensure_sources(signals: DataFrame, sources: DataFrame, defaults: DataFrame) -> DataFrame:
    """New source rows for unseen names: the first signal's implied reliability, else the feed's default, else 0.5."""
    first = signals.groupBy("source_name").agg(F.min_by("implied_reliability", F.struct("published_at", "link")).alias("implied"))
    new = first.join(sources.select(F.col("name").alias("_n")), F.col("source_name") == F.col("_n"), "left_anti")
    return new.join(defaults.select(F.col("name").alias("_d"), "default"), F.col("source_name") == F.col("_d"), "left").select(F.col("source_name").alias("name"), F.lit("AGGREGATOR").alias("type"), F.coalesce("implied", "default", F.lit(0.5)).alias("reliability"))
