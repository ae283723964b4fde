"""Readers and writers of landed files, and tables cut into the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text

FEED_ITEM = "title string, link string, pubDate string, description string, encoded string"
TRANSFERS = "data array<struct<id long, player_id long, from_team_id long, to_team_id long, date string, career_ended boolean, completed boolean, amount double>>, pagination struct<has_more boolean>"
TRANSFER_LISTS = "response array<struct<player struct<id long, name string>, update string, transfers array<struct<date string, type string, teams struct<`in` struct<id long, name string>, `out` struct<id long, name string>>>>>>"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, as the output of a generator: an expression that later ones use many times is not merged into each of them."""
    kept = df.columns
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by a key over tasks of about so many rows, if these are more than the session's shuffles have."""
    parts = df.count() // rows
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def few_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast of a written table if its counted rows are few; else the join shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table (SRC5)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def published(pub_date: Column, now: Column) -> Column:
    """The time of "Tue, 05 Aug 2025 10:00:00 GMT" without its weekday, else now."""
    stamp = F.regexp_replace(F.regexp_replace(pub_date, r"^\s*[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(pub_date), now)


def signals_of(items: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feed items as signals: transfer-related ones with window and implied reliability (SRC1). keep: columns of the items to carry along."""
    summary = F.coalesce("description", "encoded", F.lit(""))
    rows = items.select(F.coalesce("title", F.lit("")).alias("headline"), summary.alias("summary"), F.coalesce("link", F.lit("")).alias("link"), published(F.col("pubDate"), now).alias("published_at"), *keep)
    rows = rows.where(text.is_transfer_related(F.col("headline"), F.col("summary"))).withColumn("raw_text", F.concat_ws(" ", "headline", "summary"))
    return rows.withColumns({"window": text.guess_window_from_text(F.col("raw_text"), now), "implied_reliability": text.implied_reliability(F.col("headline")), "outcome": text.detect_outcome(F.col("raw_text"))})


def read_feed_items(spark: SparkSession, path: str, source_name: str, now: Column) -> DataFrame:
    """RSS files of one feed (SRC1)."""
    items = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)
    return signals_of(items, now).withColumn("source_name", F.lit(source_name))


def read_provider_transfers(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Transfer pages as normalized rumours: fees 0.9 and 1.1 of the amount, 1.0 if completed else 0.5 (SRC2)."""
    t = spark.read.schema(TRANSFERS).option("multiLine", True).json(path).select(F.explode("data").alias("t")).select("t.*")
    amount = F.nullif("amount", F.lit(0.0))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    return t.select(
        name("sm-", "id").alias("external_id"), name("sm-player-", "player_id").alias("player"), name("sm-club-", "from_team_id").alias("from_club"), name("sm-club-", "to_team_id").alias("to_club"),
        (amount * 0.9).alias("fee_min"), (amount * 1.1).alias("fee_max"), F.coalesce(F.try_to_timestamp("date"), now).alias("rumour_date"), F.when(F.col("completed"), 1.0).otherwise(0.5).alias("base_probability"),
    ).withColumn("window", text.guess_window_from_date(F.col("rumour_date")))


def read_apifootball_transfers(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Nested transfer lists in the same shape; 0.9 for free transfers, else 0.6 (SRC3)."""
    r = spark.read.schema(TRANSFER_LISTS).option("multiLine", True).json(path).select(F.explode("response").alias("r")).select(F.col("r.player.id").alias("p"), F.explode("r.transfers").alias("t"))
    ids = F.concat_ws("-", F.lit("apf"), "p", "t.teams.out.id", "t.teams.in.id", "t.date")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    return r.select(
        ids.alias("external_id"), name("apf-player-", "p").alias("player"), name("apf-club-", "t.teams.out.id").alias("from_club"), name("apf-club-", "t.teams.in.id").alias("to_club"),
        F.lit(None).cast("double").alias("fee_min"), F.lit(None).cast("double").alias("fee_max"), F.coalesce(F.try_to_timestamp("t.date"), now).alias("rumour_date"), F.when(F.col("t.type") == "Free", 0.9).otherwise(0.6).alias("base_probability"),
    ).withColumn("window", text.guess_window_from_date(F.col("rumour_date")))


def union_providers(*providers: DataFrame) -> DataFrame:
    """All provider rows in one shape."""
    out = providers[0]
    for p in providers[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def drop_seen(signals: DataFrame, stored: DataFrame) -> DataFrame:
    """Signals whose link is new: the first of a link within the batch, none that is stored; an empty link is always new and
    skips the join (J8)."""
    linked = signals.where("link <> ''")
    order = F.struct("published_at", "headline")
    first = linked.groupBy("link").agg(F.min_by(F.struct(*signals.columns), order).alias("r")).select("r.*")
    new = first.join(stored.where("link <> ''").select(F.col("link").alias("_l")), F.col("link") == F.col("_l"), "left_anti")
    return new.unionByName(signals.where("link = ''"))


def export_watchlist_csv(watched: DataFrame, path: str) -> None:
    """player, current_club, added_at with quoted names, safe from spreadsheet formulas (SNK1)."""
    safe = lambda c: F.when(F.rlike(c, F.lit("^[=+\\-@]")), F.concat(F.lit("'"), c)).otherwise(c)
    at = F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = watched.select(safe(F.col("player")).alias("player"), safe(F.coalesce("current_club", F.lit(""))).alias("current_club"), at.alias("added_at"))
    out.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_history(df: DataFrame, path: str, at: str) -> None:
    """Append rows under their day; nothing is updated (SNK2)."""
    df.withColumn("dt", F.to_date(at)).write.mode("append").partitionBy("dt").parquet(path)


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """rumour:new, rumour:updated and rumour:removed events with a JSON payload, by a full outer comparison of two states (SNK4)."""
    b = before.select(F.col("id").alias("_id"), F.col("likelihood").alias("_l"), F.col("status").alias("_s"))
    rows = after.select("id", "likelihood", "status").join(b, F.col("id") == F.col("_id"), "full")
    changed = ~F.col("likelihood").eqNullSafe(F.col("_l")) | ~F.col("status").eqNullSafe(F.col("_s"))
    event = F.when(F.col("_id").isNull(), "rumour:new").when(F.col("id").isNull(), "rumour:removed").when(changed, "rumour:updated")
    payload = F.when(F.col("id").isNull(), F.to_json(F.struct(F.col("_id").alias("id")))).otherwise(F.to_json(F.struct("id", "likelihood", "status")))
    return rows.select(event.alias("event"), payload.alias("data")).where("event is not null")


_STATE = "id long, likelihood double, status string, gone boolean"


def start_live_state(spark: SparkSession, path: str) -> None:
    """An empty first folder of the live state, so that there is a table to read."""
    spark.createDataFrame([], _STATE).write.mode("overwrite").parquet(f"{path}/state/batch=-1")


def live_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rumours as the change feed left them: the last row of each, those that are gone left out. before: only batches up to this one, exclusive."""
    rows = spark.read.schema(f"{_STATE}, batch long").parquet(f"{path}/state")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.groupBy("id").agg(F.max_by(F.struct("likelihood", "status", "gone"), "batch").alias("s"))
    return last.where("not s.gone").select("id", "s.likelihood", "s.status")
