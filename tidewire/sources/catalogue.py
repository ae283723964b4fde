"""Landed catalogue files, the feeds, and tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators.mentions import merge_clubs
from tidewire.sources import io

# The leagues of the catalogue by their number.
LEAGUES = {"2": "Champions League", "5": "Europa League", "1328": "UEFA Super Cup", "2286": "Europa Conference League"}
UNKNOWN = "Unknown"

TEAMS = "data struct<currentseason struct<teams array<struct<id bigint, name string, short_code string, image_path string, country_id bigint>>>>"
SQUAD = "data array<struct<player_id bigint, position_id bigint, detailed_position_id bigint, `end` string, player struct<id bigint, display_name string, date_of_birth string, image_path string, nationality struct<name string>>>>"
BROKEN = "_broken"

# The feeds, their names and default reliabilities.
FEEDS = (
    ("https://www.skysports.com/rss/12040", "Sky Sports Transfers", 0.78),
    ("https://feeds.bbci.co.uk/sport/football/rss.xml", "BBC Sport", 0.80),
    ("https://www.theguardian.com/football/rss", "The Guardian Football", 0.75),
    ("https://www.espn.com/espn/rss/soccer/news", "ESPN Soccer", 0.72),
    ("https://www.marca.com/en/rss/football.xml", "Marca Football", 0.70),
    ("https://www.football-italia.net/feed", "Football Italia", 0.68),
    ("https://dwh.lequipe.fr/api/edito/rss?path=/Football/Transferts-football/", "L'Équipe Mercato", 0.75),
    ("https://news.google.com/rss/search?q=football+transfer+rumour&hl=en-GB&gl=GB&ceid=GB:en", "Google News Transfers", 0.60),
    ('https://news.google.com/rss/search?q="here+we+go"+transfer&hl=en-GB&gl=GB&ceid=GB:en', "Google News Here We Go", 0.88),
    ("https://news.google.com/rss/search?q=transfer+confirmed+football&hl=en-GB&gl=GB&ceid=GB:en", "Google News Confirmed", 0.82),
    ("https://www.reddit.com/r/footballtransfers/new.rss", "Reddit Transfers", 0.45),
    ("https://www.reddit.com/r/soccer/search.rss?q=transfer+rumour&sort=new", "Reddit Soccer", 0.40),
)


def file_key(suffix: str = r"\.json") -> Column:
    """The name of a row's file without its ending: landed files are named by the league's, team's or feed's number or key."""
    return F.regexp_extract("_metadata.file_name", rf"^(.*?){suffix}(?:\.gz)?$", 1)


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one document each, with `key` (the file's name) and `_broken`, the text of a file that does not fit its schema."""
    rows = spark.read.schema(f"{schema}, {BROKEN} string").option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).option("recursiveFileLookup", True).json(path)
    return rows.select("*", file_key().alias("key"))


def broken_files(rows: DataFrame) -> DataFrame:
    """(key, broken): the files that could not be read, to be looked at (they have no clubs and players)."""
    return rows.where(F.col(BROKEN).isNotNull()).select("key", F.col(BROKEN).alias("broken"))


def league_clubs(teams: DataFrame, countries: DataFrame, leagues: DataFrame) -> DataFrame:
    """external_id, name, short_name, league, country, logo_url: one row a team, the leagues it plays in joined (SRC4, A14).

    teams: league_key, seq, id, name, short_code, image_path, country_id; countries: id, name; leagues: key, name. Both are catalogues of a few thousand rows. Unknown
    countries are "Unknown", so are leagues.
    """
    c, g = countries.select(F.col("id").alias("_c"), F.col("name").alias("_country")), leagues.select(F.col("key").alias("_l"), F.col("name").alias("_league"))
    rows = teams.where("id is not null").join(c, F.col("country_id") == F.col("_c"), "left").join(g, F.col("league_key") == F.col("_l"), "left")
    rows = rows.select(F.concat(F.lit("sm-club-"), F.col("id").cast("string")).alias("external_id"), "seq", "name", F.col("short_code").alias("short_name"), F.coalesce("_league", F.lit(UNKNOWN)).alias("league"), F.coalesce("_country", F.lit(UNKNOWN)).alias("country"), F.col("image_path").alias("logo_url"))
    first = rows.groupBy("external_id").agg(F.min_by(F.struct("short_name", "logo_url"), "seq").alias("f")).select(F.col("external_id").alias("_x"), "f.*")
    return merge_clubs(rows).join(first, F.col("external_id") == F.col("_x")).select("external_id", "name", "short_name", "league", "country", "logo_url")


def squad_players(members: DataFrame, now: Column) -> DataFrame:
    """external_id, name, current_club_external_id, age, position, nationality, photo_url, contract_end of squad rows (SRC4).

    members: team_key and the squad's columns, `player` a struct. The detailed position counts before the general one; age is the difference of calendar years; a missing contract end
    is null. A player in several squads is a row for each.
    """
    at = text.map_position(F.coalesce("detailed_position_id", "position_id"))
    p = F.col("player")
    return members.where(p["id"].isNotNull()).select(
        F.concat(F.lit("sm-player-"), p["id"].cast("string")).alias("external_id"), p["display_name"].alias("name"), F.concat(F.lit("sm-club-"), F.col("team_key")).alias("current_club_external_id"),
        text.age_from_birth(p["date_of_birth"], now).alias("age"), at.alias("position"), p["nationality"]["name"].alias("nationality"), p["image_path"].alias("photo_url"), F.try_to_timestamp("end").alias("contract_end"),
    )


def read_catalog(spark: SparkSession, leagues_path: str, squads_path: str, countries: DataFrame, now: Column, leagues: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clubs, players, broken): landed league files, named by the league's number, and squad files, named by the team's (SRC4).

    Teams of several leagues are one club; leagues join in the order of `leagues`. Files that do not fit the schema are in `broken`
    (kind, key, broken) and stop nothing. Players are those of the clubs of the leagues."""
    order = {k: i for i, k in enumerate(leagues or LEAGUES)}
    names = spark.createDataFrame([(k, v) for k, v in (leagues or LEAGUES).items()], "key string, name string")
    raw, squads = io.materialise(landed(spark, leagues_path, TEAMS), "leagues"), io.materialise(landed(spark, squads_path, SQUAD), "squads")
    rank = F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("key"))
    teams = raw.withColumn("rank", rank).where("rank is not null").select(F.col("key").alias("league_key"), "rank", F.posexplode("data.currentseason.teams").alias("i", "t"))
    clubs = league_clubs(teams.select("league_key", F.struct("rank", "i").alias("seq"), "t.*"), countries, names)
    members = squads.select(F.col("key").alias("team_key"), F.explode("data").alias("m")).select("team_key", "m.*")
    players = squad_players(members, now)
    players = players.join(clubs.select(F.col("external_id").alias("_x")), F.col("current_club_external_id") == F.col("_x"), "left_semi")
    broken = broken_files(raw).withColumn("kind", F.lit("league")).unionByName(broken_files(squads).withColumn("kind", F.lit("squad")))
    return clubs, players, broken.select("kind", "key", "broken")


# ---- feeds ---------------------------------------------------------------------------------------------------------------------------


def feed_registry(spark: SparkSession) -> DataFrame:
    """key, url, name, default: the feeds and their default reliability (SRC1); `key` names a feed's folder."""
    key = F.regexp_replace(F.lower(text.fold_accents(F.col("name"))), "[^a-z0-9]+", "-")
    return spark.createDataFrame(list(FEEDS), "url string, name string, default double").select(key.alias("key"), "url", "name", "default")


def read_feeds(spark: SparkSession, root: str, now: Column, feeds: DataFrame | None = None) -> DataFrame:
    """The signals of all feeds, landed as RSS files in a folder for each feed's key under `root` (SRC1): those of read_feed_items, with
    source_name and reliability, the implied one before the feed's default. One read for all folders; folders of no known feed are left out."""
    feeds = feed_registry(spark) if feeds is None else feeds
    items = spark.read.format("xml").option("rowTag", "item").schema(io.FEED_ITEM).load(f"{root}/*")
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    rows = io.signals_of(items.withColumn("_folder", folder), now, keep=("_folder",))
    known = feeds.select(F.col("key").alias("_k"), F.col("name").alias("source_name"), "default")
    out = rows.join(F.broadcast(known), F.col("_folder") == F.col("_k"))  # a row a feed
    return out.withColumn("reliability", F.coalesce("implied_reliability", "default")).drop("_folder", "_k", "default")


# ---- tables --------------------------------------------------------------------------------------------------------------------------

#: The library's stored tables with their columns.
TABLES = {
    "clubs": "id bigint, external_id string, name string, short_name string, league string, country string, logo_url string, auto_created boolean",
    "players": "id bigint, external_id string, name string, age int, position string, current_club_id bigint, contract_end timestamp, market_value double, nationality string, photo_url string, auto_created boolean, kb_id string, enriched_at timestamp",
    "sources": "id bigint, name string, type string, reliability double, hit_count int, miss_count int, tier int, country string, url string",
    "rumours": "id bigint, external_id string, player_id bigint, from_club_id bigint, to_club_id bigint, source_id bigint, fee_min double, fee_max double, currency string, rumour_date timestamp, window string, base_probability double, likelihood double, status string, source_count int, from_club_inferred boolean, notes string, contradicts bigint",
    "rumour_history": "rumour_id bigint, likelihood double, status string, recorded_at timestamp",
    "raw_signals": "id bigint, source_name string, feed_url string, headline string, summary string, link string, published_at timestamp, raw_text string, implied_reliability double, matched boolean, rumour_id bigint",
    "claims": "id bigint, player_id bigint, from_club_id bigint, to_club_id bigint, transfer_type string, stated_fee double, stated_months int, claim_status string, window string, first_seen_at timestamp, last_evidence_at timestamp",
    "evidence": "id bigint, claim_id bigint, source_id bigint, canonical_url string, published_at timestamp, fetched_at timestamp, author string, source_type string, title string, excerpt string, attributions array<struct<name: string, quoted: boolean>>, direction string, parent_id bigint, root_id bigint, confidence double",
    "duplicate_candidates": "id bigint, item_id bigint, candidate_id bigint, similarity double, reviewed_at timestamp",
    "forecast_definitions": "id bigint, version int, horizon_days int, summer_cutoff string, winter_cutoff string, is_active boolean",
    "forecasts": "claim_id bigint, definition_id bigint, model_id bigint, predicted_at timestamp, features map<string,double>, feature_hash string, raw double, calibrated double, low double, high double, display_mode string, reason string",
    "watchlist": "user_id bigint, player_id bigint, alert_mode string, created_at timestamp",
    "users": "id bigint, tier string, created_at timestamp",
    "product_events": "id bigint, user_id bigint, event_type string, metadata string, created_at timestamp",
    "api_usage": "id bigint, api_key_id bigint, category string, response_class string, rate_state string, created_at timestamp",
    "operational_events": "id bigint, event_type string, correlation_id string, detail string, created_at timestamp",
}


def read_stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the library's tables with its declared columns (SRC5); columns that a file lacks are null, others are not read."""
    if name not in TABLES:
        raise ValueError(f"no table {name}; there are {sorted(TABLES)}")
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def jdbc_options(url: str, table: str, low: int, high: int, parts: int, key: str = "id", fetch: int = 10_000, **more: str) -> dict[str, str]:
    """Options of a read in `parts` ranges of a numeric key (SRC5): each is a task with a connection of its own, rows outside low and high are in the first and the last."""
    if parts < 1 or high < low:
        raise ValueError("parts is 1 or more, high not below low")
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts), "fetchsize": str(fetch), "pushDownPredicate": "true", **more}


def read_jdbc(spark: SparkSession, url: str, name: str, low: int, high: int, parts: int, key: str = "id", **more: str) -> DataFrame:
    """A table of a database in parallel ranges, with the declared columns in their order and types (SRC5)."""
    columns = spark.createDataFrame([], TABLES[name]).schema
    rows = spark.read.format("jdbc").options(**jdbc_options(url, name, low, high, parts, key, **more)).load()
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in columns])
