"""Timelines, listings, ingest totals and product metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.operators.evidence import categorise_evidence
from tidewire.operators.slices import hot_sliced, numbered
from tidewire.sources.io import materialise

# Product event types.
CREATED, PANEL, HISTORY, UPGRADE = "WATCHLIST_CREATED", "PROVENANCE_PANEL_VIEWED", "FORECAST_HISTORY_VIEWED", "UPGRADE_INTEREST_CLICKED"


def evidence_metadata(evidence: DataFrame, limit: int = 500) -> DataFrame:
    """The newest items' provenance columns, never their text."""
    return evidence.orderBy(F.desc("published_at"), F.desc("id")).limit(limit).select("id", "claim_id", "source_id", "published_at", "source_type", "direction", "root_id")


def validate_product_events(events: DataFrame, kinds: dict[str, tuple[str, ...]], metadata: str = "metadata") -> DataFrame:
    """The events with `valid` (their type is one of `kinds`) and the metadata keys that their type allows as JSON, or null."""
    allowed = F.lit(None).cast("string")
    for kind, keys in kinds.items():
        if keys:
            inner = F.struct(*[F.get_json_object(metadata, f"$.{k}").alias(k) for k in keys])
            allowed = F.when(F.col("event_type") == kind, F.to_json(inner)).otherwise(allowed)
    return events.withColumn("valid", F.coalesce(F.col("event_type").isin(*kinds), F.lit(False))).withColumn(metadata, F.when(allowed != "{}", allowed))


def evidence_timeline(evidence: DataFrame, category: str | None = None) -> DataFrame:
    """Every claim's items in time with their number, and root and its time for copies: one row an item.

    A root is looked up within its claim; where several rows have its id, the earliest time counts. With a category, only its items
    are listed and numbered.
    """
    roots = evidence.groupBy(F.col("claim_id").alias("_c"), F.col("id").alias("_r")).agg(F.min("published_at").alias("root_published_at"))
    rows = evidence
    if category is not None:
        marked = categorise_evidence(evidence).where(F.array_contains(F.split("categories", ","), category)).select(F.col("claim_id").alias("_mc"), F.col("id").alias("_m")).distinct()
        rows = evidence.join(marked, F.col("claim_id").eqNullSafe(F.col("_mc")) & (F.col("id") == F.col("_m")), "left_semi")
    listed = numbered(rows.select("claim_id", "id", "published_at", "root_id"), ["claim_id"], [F.col("published_at"), F.col("id")], "nth")
    return listed.join(roots, F.col("claim_id").eqNullSafe(F.col("_c")) & (F.col("root_id") == F.col("_r")), "left").drop("_c", "_r")


def articles_by_rumour(rumours: DataFrame, articles: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """The most likely rumours with the list of their articles, newest first (A13). articles: id, rumour_id, published_at."""
    top = rumours if status is None else rumours.where(F.col("status") == status)
    top = top.orderBy(F.desc("likelihood"), "id").limit(limit).select("id", "likelihood")
    met = articles.join(F.broadcast(top.select(F.col("id").alias("_r"))), F.col("rumour_id") == F.col("_r"), "left_semi")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("published_at", F.col("id").alias("a"))), asc=False), lambda s: s["a"])
    lists = met.groupBy(F.col("rumour_id").alias("_r")).agg(listed.alias("articles"))
    return top.join(lists, F.col("id") == F.col("_r"), "left").select("id", "likelihood", F.coalesce("articles", F.array().cast("array<long>")).alias("articles"))


def ingest_totals(signals: DataFrame, matches: DataFrame) -> DataFrame:
    """Per source: signals, matched tuples, signals with a match (A21). matches: signal_id, rumour_id."""
    per = matches.groupBy(F.col("signal_id").alias("_s")).agg(F.count(F.lit(1)).alias("m"))
    return signals.join(per, F.col("id") == F.col("_s"), "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("signals"), F.coalesce(F.sum("m"), F.lit(0)).alias("matches"), F.count("m").alias("matched_signals"))


def mark_matched(signals: DataFrame, matches: DataFrame) -> DataFrame:
    """Signals with `matched` and the last rumour that they were matched to."""
    last = matches.groupBy(F.col("signal_id").alias("_s")).agg(F.max("rumour_id").alias("rumour_id"))
    return signals.join(last, F.col("id") == F.col("_s"), "left").withColumn("matched", F.col("_s").isNotNull()).drop("_s")


def resolve_external_ids(rows: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """Provider rows with player_id, from_club_id, to_club_id looked up by external ids; rows without a known player go."""
    ids = lambda df, name: df.where("external_id IS NOT NULL").groupBy(F.col("external_id").alias(f"_{name}")).agg(F.min("id").alias(f"{name}_id"))
    out = rows.join(ids(players, "player"), F.col("player_external_id") == F.col("_player"))
    for side in ("from_club", "to_club"):
        out = out.join(ids(clubs, side), F.col(f"{side}_external_id") == F.col(f"_{side}"), "left")
    return out.drop("_player", "_from_club", "_to_club")


def forecast_history(forecasts: DataFrame) -> DataFrame:
    """Every claim's forecasts oldest first; `plotted` is the rounded percentage of those with a probability."""
    rows = numbered(forecasts.select("claim_id", "predicted_at", "calibrated"), ["claim_id"], [F.col("predicted_at"), F.col("calibrated")], "nth")
    return rows.select("claim_id", "predicted_at", "calibrated", "nth", F.floor(F.col("calibrated") * 100 + 0.5).cast("long").alias("plotted"))


def nearest_point(series: DataFrame, events: DataFrame) -> DataFrame:
    """Every event's point of its claim that is nearest in time, the earlier of two as near (J19). series: claim_id, predicted_at; events: claim_id, id, at.

    Points and events of a claim lie on one timeline, which is passed over in both directions; no event meets all points and none is joined back. Claims
    with more than HOT rows are cut into slices of time. Events of claims without points have no row.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    points = series.select("claim_id", us("predicted_at").alias("us")).where("us is not null").distinct().withColumns({"point": F.col("us"), "_kind": F.lit(0)})
    asks = events.select("claim_id", us("at").alias("us"), F.lit(1).alias("_kind"), "id", "at").where("us is not null")
    rows, hot = hot_sliced(materialise(points.unionByName(asks, allowMissingColumns=True), "points"), ["claim_id"], F.col("us"))
    line = Window.partitionBy("claim_id", *(["_slice"] if hot else []))
    run = lambda order: line.orderBy(order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumns({"last": F.max("point").over(run(F.asc("us"))), "following": F.min("point").over(run(F.desc("us")))}).where("_kind = 1")
    if hot is not None:
        per = hot.groupBy(F.col("claim_id").alias("_c"), F.col("_slice").alias("_s")).agg(F.max("point").alias("most"), F.min("point").alias("least"))
        by = Window.partitionBy("_c")
        ends = per.select("_c", "_s", F.max("most").over(by.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_last"), F.min("least").over(by.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)).alias("_following"))
        met = met.join(F.broadcast(ends), F.col("claim_id").eqNullSafe(F.col("_c")) & (F.col("_slice") == F.col("_s")), "left").withColumns({"last": F.coalesce("last", "_last"), "following": F.coalesce("following", "_following")})
    earlier = F.col("following").isNull() | (F.col("us") - F.col("last") <= F.col("following") - F.col("us"))
    nearest = F.when(F.col("last").isNotNull() & earlier, F.col("last")).otherwise(F.col("following"))
    return met.select("claim_id", "id", "at", F.timestamp_micros(nearest).cast(series.schema["predicted_at"].dataType).alias("nearest")).where("nearest is not null")


def watchlist_listing(watchlist: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """Every watched player with name and club, newest first within a user."""
    p = players.select(F.col("id").alias("_p"), F.col("name").alias("player"), "current_club_id")
    c = clubs.select(F.col("id").alias("_k"), F.col("name").alias("club"))
    rows = watchlist.join(p, F.col("player_id") == F.col("_p")).join(c, F.col("current_club_id") == F.col("_k"), "left").select("user_id", "player_id", "player", "club", "created_at")
    return numbered(rows, ["user_id"], [F.desc("created_at"), F.col("player_id")], "nth")


def product_metrics(users: DataFrame, events: DataFrame, caps: DataFrame) -> DataFrame:
    """One row: activation among sign-ups, views of the panel and the history per active user, upgrade clicks, cap-hit rate of free users.

    users: id, tier; events: user_id, event_type; caps: user_id of refused additions.
    """
    created = events.where(F.col("event_type") == CREATED).select(F.col("user_id").alias("_u")).distinct()
    signed = users.join(created, F.col("id") == F.col("_u"), "left").agg(F.try_divide(F.count("_u"), F.count(F.lit(1))).alias("activation_rate"))
    viewed = F.count_if(F.col("event_type").isin(PANEL, HISTORY))
    used = events.agg(F.try_divide(viewed, F.count_distinct("user_id")).alias("views_per_active_user"), F.count_if(F.col("event_type") == UPGRADE).alias("upgrade_clicks"))
    hit = users.where("tier = 'FREE'").join(caps.select(F.col("user_id").alias("_h")).distinct(), F.col("id") == F.col("_h"), "left").agg(F.try_divide(F.count("_h"), F.count(F.lit(1))).alias("cap_hit_rate"))
    return signed.join(used, F.lit(True)).join(hit, F.lit(True))  # three single rows


def upgrade_clicks(events: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Upgrade clicks by the feature that prompted them."""
    return events.where(F.col("event_type") == UPGRADE).groupBy(F.get_json_object(metadata, "$.featureKey").alias("feature_key")).agg(F.count(F.lit(1)).alias("clicks"))


def touched_scores(batch: DataFrame, scored: DataFrame, likelihood: Column, recorded_at: Column) -> DataFrame:
    """History rows for the rumours that a batch touched: rumour_id, likelihood, recorded_at (ST4's batch step)."""
    keys = batch.select(F.col("rumour_id").alias("_r")).distinct()
    return scored.join(keys, F.col("id") == F.col("_r"), "left_semi").select(F.col("id").alias("rumour_id"), likelihood.alias("likelihood"), recorded_at.alias("recorded_at"))
