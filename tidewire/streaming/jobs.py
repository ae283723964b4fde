"""Structured Streaming twins of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.operators import evidence as ev
from tidewire.operators.outcomes import SETTLED
from tidewire.operators.reports import touched_scores
from tidewire.sources import io


def stream_signals(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Feed items as they land (JSON lines), each link once within seven days (ST1); older repeats meet drop_seen in foreachBatch."""
    items = spark.readStream.schema(io.FEED_ITEM).json(path)
    return io.signals_of(items, now).withWatermark("published_at", "7 days").dropDuplicatesWithinWatermark(["link"])


def stream_live_state(updates: DataFrame) -> DataFrame:
    """The latest likelihood and status of every rumour; write in update mode (ST5)."""
    return updates.groupBy("id").agg(F.max_by(F.struct("likelihood", "status"), "ts").alias("s")).select("id", "s.likelihood", "s.status")


def stream_source_reliability(outcomes: DataFrame, start: tuple[float, int, int] = (0.5, 0, 0)) -> DataFrame:
    """Hits, misses and score of every source after each micro-batch that touched it (ST3); write in append mode, the last row of a source counts.

    outcomes: rumour_id, source_id, at, hit. A rumour counts once, however late it is repeated: its id stays in the state store. Of a source the counts are
    kept, and while it has fewer than SETTLED outcomes these outcomes too (at most 19), so that late ones are folded in their order: the score is that of the batch job
    whatever the order of arrival. start: score, hits and misses of a source at first.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    score0, hits0, misses0 = start

    def fold(key, frames, state: GroupState):
        hits, n, early = state.get if state.exists else (0, 0, [])
        rows = pd.concat(list(frames))
        hits, n = hits + int(rows["hit"].sum()), n + len(rows)
        early = [] if n + hits0 + misses0 >= SETTLED else sorted([*map(tuple, early), *((int(t), int(r), int(h)) for t, r, h in zip(rows["us"], rows["rumour_id"], rows["hit"], strict=True))])
        state.update((hits, n, [list(e) for e in early]))
        h, m, score = hits0, hits0 + misses0, float(score0)
        if n + m >= SETTLED:
            score = (hits + h) / (n + m)
        for _, _, hit in early:
            h, m = h + hit, m + 1
            w = min(m / SETTLED, 1.0)
            score = max(0.1, min(0.99, score * (1 - w) + h / m * w))
        yield pd.DataFrame({"source_id": [key[0]], "hits": [hits + hits0], "misses": [n - hits + misses0], "score": [max(0.1, min(0.99, score))]})

    once = outcomes.dropDuplicates(["rumour_id"]).select("rumour_id", "source_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("hit").cast("int").alias("hit"))
    return once.groupBy("source_id").applyInPandasWithState(fold, "source_id long, hits long, misses long, score double", "hits long, n long, early array<array<bigint>>", "append", GroupStateTimeout.NoTimeout)


def stream_change_feed(batches: DataFrame, score: Callable[[SparkSession], DataFrame], path: str, checkpoint: str):
    """Keeps the live state of rumours under `path`/state and writes what changed under `path`/events, a folder for each micro-batch (SNK4, ST4).

    batches: a stream with rumour_id of the rumours that signals touched; score gives id, likelihood and status as they stand. A batch compares the touched rumours with the
    last state (a full outer comparison: new, updated, gone) and adds one ingest totals event. Folders are written over when a batch runs again, and the
    state that a batch starts from is always that of the folders before it, so every event comes exactly once.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = batch.select(F.col("rumour_id").alias("_k")).where("_k is not null").distinct()
        before = io.live_state(spark, path, number).join(keys, F.col("id") == F.col("_k"), "left_semi")
        after = score(spark).select("id", "likelihood", "status").join(keys, F.col("id") == F.col("_k"), "left_semi")
        feed = io.change_feed(before, after)
        totals = batch.agg(F.count(F.lit(1)).alias("signals"), F.count("rumour_id").alias("matched")).select(F.lit("ingest:totals").alias("event"), F.to_json(F.struct("signals", "matched")).alias("data"))
        state = after.withColumn("gone", F.lit(False)).unionByName(before.join(after.select(F.col("id").alias("_a")), F.col("id") == F.col("_a"), "left_anti").select("id", "likelihood", "status").withColumn("gone", F.lit(True)))
        feed.unionByName(totals).write.mode("overwrite").json(f"{path}/events/batch={number}")
        state.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    spark = batches.sparkSession
    io.start_live_state(spark, path)
    return batches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def stream_rescore(touched: DataFrame, score: Callable[[SparkSession], DataFrame], path: str, checkpoint: str):
    """Scores the rumours that each micro-batch touched and adds their history rows under `path` (ST4).

    touched: a stream with rumour_id and the time `at` of the change. score gives all rumours with id and likelihood as they stand; only those touched are joined. A
    batch that is run again after a failure writes over its own folder. Returns the running query.
    """

    def one(batch: DataFrame, number: int) -> None:
        at = batch.groupBy(F.col("rumour_id").alias("_t")).agg(F.max("at").alias("at"))
        scored = score(batch.sparkSession).join(at, F.col("id") == F.col("_t"))
        touched_scores(batch, scored, F.col("likelihood"), F.col("at")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return touched.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def stream_assign_rumours(reports: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """Reports with the anchor of their rumour as keyed state (player, from, to) (ST2); what batch assign_rumours gives for all reports that are at most `late`.

    Reports wait in the state until the watermark has passed them and are folded in order of time and id; so one that comes late joins the rumour that was open at its
    time. The state of a key is the reports of the last `late`, and the anchor; it goes when nothing waits and the anchor is `days` old.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    width = days * 86_400_000_000
    names = ["id", "player_id", "from_club_id", "to_club_id", "us", "anchor"]

    def fold(key, frames, state: GroupState):
        anchor, waiting = state.get if state.exists else (None, [])
        waiting = [tuple(w) for w in waiting]
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            waiting += [(int(t), int(i)) for t, i in zip(rows["us"], rows["id"], strict=True)]
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted(w for w in waiting if w[0] < passed)
        waiting = sorted(w for w in waiting if w[0] >= passed)
        out = []
        for at, i in ready:
            if anchor is None or at > anchor + width:
                anchor = at
            out.append((i, *key, at, anchor))
        if not waiting and (anchor is None or anchor + width < passed):
            if state.exists:
                state.remove()
        else:
            state.update((anchor, [list(w) for w in waiting]))
            wake = waiting[0][0] if waiting else anchor + width
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names).astype("Int64")

    rows = reports.select("id", "player_id", "from_club_id", "to_club_id", "rumour_date", F.unix_micros(F.col("rumour_date").cast("timestamp")).alias("us")).withWatermark("rumour_date", late)
    found = rows.groupBy("player_id", "from_club_id", "to_club_id").applyInPandasWithState(fold, "id long, player_id long, from_club_id long, to_club_id long, us long, anchor long", "anchor long, waiting array<array<bigint>>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("id", "player_id", "from_club_id", "to_club_id", F.timestamp_micros("us").alias("rumour_date"), F.timestamp_micros("anchor").alias("anchor"))


def stream_rate_limits(usage: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Requests with their place in the key's window, which starts at its first request, as keyed state (ST6).

    The state of a key is the start of its window and a count; it goes once the window is over. Requests of a micro-batch are taken
    in order of time and id.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    width = pd.Timedelta(seconds=seconds)

    def count(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, n = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["created_at", "id"])
        starts, places = [], []
        for at in rows["created_at"]:
            if start is None or at >= start + width:
                start, n = at, 0
            n += 1
            starts.append(start)
            places.append(n)
        state.update((int(start.value // 1000), n))
        state.setTimeoutTimestamp(max(int((start + width).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        rows = rows.assign(window_start=starts, n=places)
        yield rows.assign(allowed=rows["n"] <= limit, remaining=(limit - rows["n"]).clip(lower=0))[["id", "api_key_id", "created_at", "window_start", "n", "allowed", "remaining"]]

    rows = usage.select("id", "api_key_id", "created_at").withWatermark("created_at", f"{seconds} seconds")
    return rows.groupBy("api_key_id").applyInPandasWithState(count, "id long, api_key_id long, created_at timestamp, window_start timestamp, n long, allowed boolean, remaining long", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


#: Folders that the evidence store deals its claims into; a micro-batch reads only those that it touches.
BUCKETS = 64


def _bucket(claim: str = "claim_id") -> Column:
    return F.pmod(F.xxhash64(claim), F.lit(BUCKETS)).cast("int")


def stored_evidence(spark: SparkSession, store: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The items of the store with seq (order of arrival), parent_id, root_id and the time of the last fetch. before: only batches up to this one, exclusive; buckets: only these."""

    def part(name: str) -> DataFrame:
        rows = spark.read.option("basePath", f"{store}/{name}").parquet(f"{store}/{name}")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    fetches = part("fetches").groupBy(F.col("id").alias("_f")).agg(F.max("fetched_at").alias("_at"))
    rows = part("items").join(fetches, F.col("id") == F.col("_f"), "left")
    return rows.withColumn("fetched_at", F.greatest("fetched_at", "_at")).drop("_f", "_at")


def stored_pairs(spark: SparkSession, store: str) -> DataFrame:
    """item_id, candidate_id, similarity of the near copies found so far."""
    return spark.read.parquet(f"{store}/pairs").select("item_id", "candidate_id", "similarity").distinct()


def evidence_seen(spark: SparkSession, store: str) -> DataFrame:
    """claim_id and the time of its newest evidence (A5)."""
    return stored_evidence(spark, store).groupBy("claim_id").agg(F.max("published_at").alias("last_evidence_at"))


def start_evidence_store(spark: SparkSession, store: str, schema: StructType) -> None:
    """Empty first folders with the schema of the items, so that there are tables to read."""
    empty = spark.createDataFrame([], schema)
    at = F.struct("fetched_at", "id")
    items = empty.select("*", F.struct(F.lit(0).cast("long").alias("batch"), at.alias("at")).alias("seq"), F.col("id").alias("parent_id"), F.col("id").alias("root_id"))
    first = "batch=-1/bucket=-1"
    items.write.mode("overwrite").parquet(f"{store}/items/{first}")
    empty.select("id", "fetched_at").write.mode("overwrite").parquet(f"{store}/fetches/{first}")
    empty.select(F.col("id").alias("item_id"), F.col("id").alias("candidate_id"), F.lit(0.0).alias("similarity")).write.mode("overwrite").parquet(f"{store}/pairs/batch=-1")


def update_evidence(batch: DataFrame, number: int, sources: DataFrame, store: str) -> None:
    """Takes one micro-batch into the store (see stream_evidence). The same number again gives the same store."""
    spark = batch.sparkSession
    batch = io.materialise(batch.withColumn("bucket", _bucket()), "evidence-batch")
    touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most BUCKETS
    claims = batch.select(F.col("claim_id").alias("_c")).distinct()
    old = io.materialise(stored_evidence(spark, store, number, touched).join(claims, F.col("claim_id").eqNullSafe(F.col("_c")), "left_semi"), "evidence-old")
    first = ev.ingest_evidence(batch, old)
    new = io.materialise(first.withColumn("seq", F.struct(F.lit(number).cast("long").alias("batch"), F.struct("fetched_at", "id").alias("at"))), "evidence-new")
    columns = ["id", "claim_id", "source_id", "published_at", "seq", "text"]
    every = old.select(*columns, F.lit(False).alias("fresh")).unionByName(new.select(*columns, F.lit(True).alias("fresh")))
    parents = ev.attribution_parents(every, ev.match_cited_source(new, sources)).withColumnRenamed("id", "_i")
    linked = new.select("id").join(parents, F.col("id") == F.col("_i"), "left").select("id", "parent_id")
    # a stored item's root ends its chain
    roots = ev.resolve_roots(old.select("id", F.col("root_id").alias("parent_id")).unionByName(linked)).withColumnRenamed("id", "_r")
    of = linked.join(roots, F.col("id") == F.col("_r")).select(F.col("id").alias("_i"), "parent_id", "root_id")
    done = new.join(of, F.col("id") == F.col("_i")).drop("_i")
    pairs = ev.near_duplicate_pairs(every, fresh="fresh")
    known = old.select("canonical_url", "claim_id", "id").unionByName(new.select("canonical_url", "claim_id", "id")).withColumnsRenamed({"canonical_url": "_u", "claim_id": "_c", "id": "_id"})
    again = batch.join(known, F.col("canonical_url").eqNullSafe(F.col("_u")) & F.col("claim_id").eqNullSafe(F.col("_c"))).groupBy(F.col("_id").alias("id"), "bucket").agg(F.max("fetched_at").alias("fetched_at"))
    done.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/items/batch={number}")
    again.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/fetches/batch={number}")
    pairs.write.mode("overwrite").parquet(f"{store}/pairs/batch={number}")


def stream_evidence(items: DataFrame, sources: Callable[[SparkSession], DataFrame], store: str, checkpoint: str):
    """Keeps the evidence store up to date with each micro-batch (ST7). items: id, claim_id, source_id, canonical_url, published_at, fetched_at, text; sources: id, name.

    An item whose (url, claim) is there only moves the time of the last fetch, the first content stays. New items get the parent that
    they cite among the claim's items before them, its root, and their near copies on the claim. The store is dealt into BUCKETS folders by a hash of the claim, and a
    batch reads the folders and claims that it touches, not the store. Items of one batch come in order of fetched_at and id. Every batch writes folders of its own, writes over them
    when it is run again, and reads only those of earlier batches, so a replay leaves nothing twice. `compact_evidence` joins small folders.
    """
    start_evidence_store(items.sparkSession, store, items.schema)
    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: update_evidence(batch, number, sources(batch.sparkSession), store)).start()


def compact_evidence(spark: SparkSession, store: str, to: str) -> None:
    """The whole store as the first folders of a new one, one set of files a bucket; streams go on there with any batch number."""
    rows = stored_evidence(spark, store)
    rows.drop("batch").repartition("bucket", "claim_id").write.partitionBy("bucket").parquet(f"{to}/items/batch=-1")
    rows.select("id", "fetched_at", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{to}/fetches/batch=-1")
    stored_pairs(spark, store).write.parquet(f"{to}/pairs/batch=-1")
