"""Feeds, dashboards, pages and reports over rumours, players, clubs and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import rules


def with_dimensions(rumours: DataFrame, players: DataFrame, clubs: DataFrame, sources: DataFrame) -> DataFrame:
    """Rumours with prefixed columns of player, current club, both clubs and source (J18). AQE broadcasts what it measures as small."""
    p = players.select(F.col("id").alias("_pid"), *[F.col(c).alias(f"player_{c}") for c in players.columns if c != "id"])
    s = sources.select(F.col("id").alias("_sid"), *[F.col(c).alias(f"source_{c}") for c in sources.columns if c != "id"])
    out = rumours.join(p, F.col("player_id") == F.col("_pid")).join(s, F.col("source_id") == F.col("_sid"), "left").drop("_pid", "_sid")
    for key, prefix, how in (("player_current_club_id", "current", "left"), ("from_club_id", "from", "left"), ("to_club_id", "to", "left")):
        c = clubs.select(F.col("id").alias("_cid"), *[F.col(x).alias(f"{prefix}_{x}") for x in clubs.columns if x != "id"])
        out = out.join(c, F.col(key) == F.col("_cid"), how).drop("_cid")
    return out


def active_rumours(rumours: DataFrame, since: Column | None = None) -> DataFrame:
    """PENDING and HOT rumours, dated from `since` on if given (F8)."""
    out = rumours.where(F.col("status").isin(*rules.ACTIVE))
    return out if since is None else out.where(F.col("rumour_date") >= since)


def filter_rumours(rumours: DataFrame, clubs: DataFrame, league: str | None = None, club_id: int | None = None, position: str | None = None, status: str | None = None, window: str | None = None, players: DataFrame | None = None) -> DataFrame:
    """Optional predicates (F6). A league matches either club as a substring and replaces club_id; `position` needs a
    player_position column; `players` (player_id) keeps a watchlist by semi join."""
    out = rumours
    if league is not None:
        ids = clubs.where(F.contains(F.lower("league"), F.lit(league.lower()))).select(F.col("id").alias("_c"))
        out = out.withColumn("_club", F.explode(F.array_distinct(F.array("from_club_id", "to_club_id")))).join(ids, F.col("_club") == F.col("_c"), "left_semi").drop("_club").dropDuplicates(["id"])
    elif club_id is not None:
        out = out.where((F.col("from_club_id") == club_id) | (F.col("to_club_id") == club_id))
    for column, value in (("player_position", position), ("status", status), ("window", window)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if players is not None:
        out = out.join(players.select(F.col("player_id").alias("_p")), F.col("player_id") == F.col("_p"), "left_semi")
    return out


def search_names(df: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Case-insensitive substring search, by name."""
    return df.where(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("name", "id").limit(limit)


def display_origin(rumours: DataFrame) -> DataFrame:
    """Origin to show: the player's current club, unconfirmed, where an inferred from-club differs from it."""
    other = F.col("from_club_inferred") & F.col("player_current_club_id").isNotNull() & (F.col("player_current_club_id") != F.col("from_club_id"))
    return rumours.select("id", F.when(other, F.col("player_current_club_id")).otherwise(F.col("from_club_id")).alias("origin_club_id"), F.coalesce(other, F.lit(False)).alias("unconfirmed"))


def purge_older_than(events: DataFrame, now: Column, days: int = 90, at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(rows kept, one health row) (F12). Days that are not positive mean 90."""
    cutoff = now - F.make_dt_interval(F.lit(days if days and days > 0 else 90))
    health = events.agg(F.count_if(F.col(at) < cutoff).alias("deleted"), F.count_if(F.col(at) >= cutoff).alias("kept"), F.lit(True).alias("success")).withColumn("cutoff", cutoff)
    return events.where(F.col(at) >= cutoff), health


def historical_claims(claims: DataFrame, limit: int = 500) -> DataFrame:
    """Resolved claims, newest first."""
    return claims.where(F.col("claim_status").isin("CONFIRMED", "DENIED", "EXPIRED")).orderBy(F.desc("first_seen_at"), "id").limit(limit)


def page_of(rows: DataFrame, order: list[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """One page of at most 100 rows with `total`, the count of all rows, on each (K1)."""
    size = min(max(1, limit), 100)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size).join(F.broadcast(total))  # a single row


def rumour_page(rumours: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    """One page by likelihood, at most 100 rows, with the total (K1)."""
    return page_of(rumours, [F.desc("likelihood"), F.col("id")], page, limit)


def top_per_key(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of every key (K2, K3)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def overview_counts(rumours: DataFrame) -> DataFrame:
    """Total, hot and completed."""
    return rumours.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "HOT").alias("hot"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))


def source_stats(sources: DataFrame, rumours: DataFrame) -> DataFrame:
    """Sources with their rumour counts, zero kept, and hits and misses (A6). Counted before the join."""
    n = rumours.groupBy(F.col("source_id").alias("_s")).agg(F.count(F.lit(1)).alias("rumours"))
    return sources.join(n, F.col("id") == F.col("_s"), "left").select("id", "name", "reliability", F.coalesce("rumours", F.lit(0)).alias("rumours"), F.coalesce("hit_count", F.lit(0)).alias("hits"), F.coalesce("miss_count", F.lit(0)).alias("misses"))


def club_dashboard(clubs: DataFrame, players: DataFrame, rumours: DataFrame, midpoint: bool = False) -> DataFrame:
    """Squad size, active moves in and out and expected spend per club (A8). The fee term is (min, else max) / 2 and 0
    without a max, as the service computes it; midpoint=True takes the midpoint."""
    active = active_rumours(rumours)
    low, high = F.col("fee_min"), F.col("fee_max")
    fee = rules.fee_mid(low, high) if midpoint else F.when(high.isNull(), 0.0).otherwise(F.coalesce(low, high) / 2)
    squad = players.groupBy(F.col("current_club_id").alias("_c")).agg(F.count(F.lit(1)).alias("squad"))
    into = active.groupBy(F.col("to_club_id").alias("_c")).agg(F.count(F.lit(1)).alias("n_in"), F.sum(F.coalesce(fee, F.lit(0.0)) * F.col("likelihood") / 100).alias("spend"))
    out = active.groupBy(F.col("from_club_id").alias("_c")).agg(F.count(F.lit(1)).alias("n_out"))
    rows = clubs
    for part in (squad, into, out):
        rows = rows.join(part, F.col("id") == F.col("_c"), "left").drop("_c")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("id", "name", zero("squad"), zero("n_in"), zero("n_out"), rules.half_up(F.coalesce("spend", F.lit(0.0))).cast("double").alias("expected_spend"))


def spend_by_position(rumours: DataFrame, players: DataFrame) -> DataFrame:
    """Expected spend per buying club and position."""
    p = players.select(F.col("id").alias("_p"), "position")
    fee = F.coalesce("fee_max", "fee_min", F.lit(0.0))
    return active_rumours(rumours).join(p, F.col("player_id") == F.col("_p")).groupBy("to_club_id", "position").agg(rules.half_up(F.sum(fee * F.col("likelihood") / 100)).cast("double").alias("spend"))


# Colours of a network's edges by status, and of its nodes.
STATUS_COLOURS = {"HOT": "#f97316", "PENDING": "#94a3b8", "COMPLETED": "#22c55e", "FAILED": "#ef4444", "DENIED": "#6b7280"}
NODE_COLOURS = {"player": "#60a5fa", "club": "#8b5cf6"}


def transfer_network(rumours: DataFrame, players: DataFrame, clubs: DataFrame | None = None, k: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the k likeliest live or completed rumours (A10). Labels of clubs need `clubs`."""
    top = rumours.where(F.col("status").isin("PENDING", "HOT", "COMPLETED")).orderBy(F.desc("likelihood"), "id").limit(k)
    p = players.select(F.col("id").alias("_p"), F.col("name").alias("_name"), "market_value")
    top = top.join(p, F.col("player_id") == F.col("_p"), "left")
    colour = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_COLOURS.items() for x in pair]), F.col("status"))
    weight = [(F.col("likelihood") / 100).alias("weight"), F.greatest(F.lit(1.0), F.col("likelihood") / 25).alias("size"), "status", colour.alias("colour")]
    name = lambda kind, c: F.concat(F.lit(kind + "-"), F.col(c))
    told = F.concat("_name", F.lit(" ("), F.floor(F.col("likelihood") + 0.5).cast("string"), F.lit("%)"))
    edge = lambda tail, a, b, way, label: F.struct(F.concat(F.lit("edge-"), F.col("id").cast("string"), F.lit(tail)).alias("edge"), a.alias("source"), b.alias("target"), F.lit(way).alias("way"), label.alias("label"))
    both = F.array(edge("", name("club", "from_club_id"), name("player", "player_id"), "rumour-from", told), edge("-to", name("player", "player_id"), name("club", "to_club_id"), "rumour-to", F.lit(None).cast("string")))
    edges = top.select("id", F.explode(both).alias("e"), *weight).select(F.col("id").alias("rumour_id"), "e.*", "weight", "size", "status", "colour")
    people = top.select(name("player", "player_id").alias("id"), F.lit("player").alias("kind"), F.col("_name").alias("label"), rules.clamp(F.coalesce("market_value", F.lit(20.0)) / 8, 6.0, 18.0).alias("size"))
    teams = top.select(F.explode(F.array("from_club_id", "to_club_id")).alias("c"))
    if clubs is not None:
        short = F.coalesce("short_name", "name") if "short_name" in clubs.columns else F.col("name")
        teams = teams.join(clubs.select(F.col("id").alias("_k"), short.alias("label")), F.col("c") == F.col("_k"), "left")
    else:
        teams = teams.withColumn("label", F.lit(None).cast("string"))
    nodes = people.unionByName(teams.select(F.concat(F.lit("club-"), "c").alias("id"), F.lit("club").alias("kind"), "label", F.lit(14.0).alias("size"))).dropDuplicates(["id"])
    return nodes.withColumn("colour", F.when(F.col("kind") == "player", NODE_COLOURS["player"]).otherwise(NODE_COLOURS["club"])), edges


def network_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_count and edge_count (A10), one row."""
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).join(edges.agg(F.count(F.lit(1)).alias("edge_count")))  # two single rows


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of every node in either direction."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other")))
    return both.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("other")).alias("neighbours"))


def likelihood_timeline(history: DataFrame) -> DataFrame:
    """Every rumour's scores in time with the change from the last and a hot flag; single points are left out."""
    by = Window.partitionBy("rumour_id").orderBy("recorded_at", "likelihood")
    out = history.select("rumour_id", "recorded_at", "likelihood", F.lag("likelihood").over(by).alias("previous"), F.lead("likelihood").over(by).alias("_next"))
    return out.where(F.col("previous").isNotNull() | F.col("_next").isNotNull()).select("rumour_id", "recorded_at", "likelihood", "previous", (F.col("likelihood") - F.col("previous")).alias("change"), (F.col("likelihood") >= 70).alias("hot"))


def usage_metrics(events: DataFrame) -> DataFrame:
    """Events and distinct users per type."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
