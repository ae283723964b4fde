"""Keyed streams against their batch twins."""

from datetime import datetime, timedelta

from tidewire.operators import evidence, outcomes
from tidewire.streaming import jobs

T0 = datetime(2025, 1, 1)


def test_rate_limits_equal_batch(spark, tmp_path):
    kind = "id long, api_key_id long, created_at timestamp"
    rows = [(i, i % 2, T0 + timedelta(seconds=7 * i)) for i in range(40)]
    for k in range(2):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_rate_limits(stream, 3, 60).writeStream.outputMode("append").format("memory").queryName("limits").start()
    q.processAllAvailable()
    q.stop()
    cols = ["id", "api_key_id", "window_start", "n", "allowed", "remaining"]
    want = outcomes.rate_limit_audit(spark.createDataFrame(rows, kind), 3, 60)
    assert {tuple(r) for r in spark.table("limits").select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}


def fed(spark, rows, kind, folder, parts):
    """A stream of the rows, one file a micro-batch."""
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], kind).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(stream, name, spark):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_late_reports_join_the_rumour_of_their_time(spark, tmp_path):
    import random

    rng = random.Random(3)
    kind = "id long, player_id long, from_club_id long, to_club_id long, rumour_date timestamp"
    rows = [(i, i % 3, None if i % 2 else 5, 9, T0 + timedelta(hours=rng.randrange(24 * 40))) for i in range(150)]
    # out of order, but no more than three days late
    fed_rows = sorted(rows, key=lambda r: r[4] + timedelta(hours=rng.randrange(72))) + [(999, 7, 7, 7, T0 + timedelta(days=400))]
    stream = fed(spark, fed_rows, kind, str(tmp_path / "in"), 6)
    got = {r.id: r.anchor for r in collected(jobs.stream_assign_rumours(stream, 7, "3 days"), "assigned", spark)}
    want = {r.id: r.anchor for r in outcomes.assign_rumours(spark.createDataFrame(rows, kind), 7).collect()}
    assert {k: v for k, v in got.items() if k != 999} == want


def test_source_scores_do_not_depend_on_arrival(spark, tmp_path):
    import random

    rng = random.Random(4)
    kind = "rumour_id long, source_id long, at timestamp, hit boolean"
    rows = [(i, 1 if i < 60 else 2 if i < 75 else 3, T0 + timedelta(hours=rng.randrange(3000)), rng.random() < 0.4) for i in range(79)]
    arrived = rows + rng.sample(rows, 20)  # repeats, months later
    rng.shuffle(arrived)
    last = {r.source_id: (r.hits, r.misses, round(r.score, 9)) for r in collected(jobs.stream_source_reliability(fed(spark, arrived, kind, str(tmp_path / "in"), 5), (0.6, 1, 2)), "scores", spark)}
    sources = spark.createDataFrame([(s, 0.6, 1, 2) for s in (1, 2, 3)], "id long, reliability double, hit_count long, miss_count long")
    batch = outcomes.source_reliability(spark.createDataFrame(rows, kind).withColumnRenamed("rumour_id", "id"), sources)
    assert last == {r.id: (r.hits, r.misses, round(r.score, 9)) for r in batch.collect()}


EVIDENCE = "id long, claim_id long, source_id long, canonical_url string, published_at timestamp, fetched_at timestamp, text string"


def articles():
    import random

    rng = random.Random(6)
    names = {1: "Sky Sports", 2: "Daily Mail", 3: "Marca"}
    rows = []
    for i in range(48):
        cites = rng.choice([None, "Sky Sports", "Daily Mail", "Marca"])
        said = " ".join(rng.choice(["player", "deal", "club", "fee", "agent", "loan"]) for _ in range(6)) + f" w{i % 7} x{i % 5}"
        rows.append((i, rng.choice([1, 2, None]), rng.choice([1, 2, 3]), f"u{i % 30}", T0 + timedelta(hours=rng.randrange(200)), T0 + timedelta(days=10, minutes=i), said + (f", according to {cites}, today" if cites else "")))
    return rows, names


def test_evidence_store_equals_the_batch_chain(spark, tmp_path):
    from pyspark.sql import functions as F

    rows, names = articles()
    store = str(tmp_path / "store")
    sources = spark.createDataFrame(list(names.items()), "id long, name string")
    q = jobs.stream_evidence(fed(spark, rows, EVIDENCE, str(tmp_path / "in"), 4), lambda s: sources, store, str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r[3], r[1])
    first, fetched = {}, {}
    for r in rows:
        first.setdefault(key(r), r)
        fetched[key(r)] = r[5]
    got = {r.id: r for r in jobs.stored_evidence(spark, store).collect()}
    assert set(got) == {r[0] for r in first.values()} and all(got[r[0]].text == r[6] and got[r[0]].fetched_at == fetched[k] for k, r in first.items())
    # the batch operators over the whole table
    every = jobs.stored_evidence(spark, store).drop("parent_id", "root_id")
    parents = {r.id: r.parent_id for r in evidence.attribution_parents(every, evidence.match_cited_source(every, sources)).collect()}
    assert {i: r.parent_id for i, r in got.items() if r.parent_id is not None} == parents and len(parents) > 5
    roots = evidence.resolve_roots(spark.createDataFrame([(i, parents.get(i)) for i in got], "id long, parent_id long"))
    assert {i: r.root_id for i, r in got.items()} == {r.id: r.root_id for r in roots.collect()}
    pairs = lambda df: {(r.item_id, r.candidate_id, round(r.similarity, 6)) for r in df.collect()}
    found = pairs(evidence.near_duplicate_pairs(every))
    assert pairs(jobs.stored_pairs(spark, store)) == found != set()
    assert {r.claim_id: r.last_evidence_at for r in jobs.evidence_seen(spark, store).collect()} == {c: max(r[4] for r in first.values() if r[1] == c) for c in (1, 2, None)}
    # the last batch again, as after a lost driver, then in a compacted store
    last = spark.createDataFrame(rows[36:], EVIDENCE)
    for where in (store, str(tmp_path / "compact")):
        if where != store:
            jobs.compact_evidence(spark, store, where)
        jobs.update_evidence(last, 3, sources, where)
        assert {r.id: (r.root_id, r.fetched_at) for r in jobs.stored_evidence(spark, where).collect()} == {i: (r.root_id, r.fetched_at) for i, r in got.items()}
        assert pairs(jobs.stored_pairs(spark, where)) == found
    assert spark.read.parquet(f"{store}/items").where(F.col("batch") == 3).count() < 12


def test_change_feed_says_every_change_once(spark, tmp_path):
    import json

    path = str(tmp_path / "feed")
    states = [{1: (10.0, "PENDING"), 2: (20.0, "PENDING")}, {1: (75.0, "HOT"), 2: (20.0, "PENDING"), 3: (5.0, "PENDING")}, {1: (75.0, "HOT"), 3: (5.0, "PENDING")}]
    now = {"k": 0}
    score = lambda s: s.createDataFrame([(i, *v) for i, v in states[now["k"]].items()], "id long, likelihood double, status string")
    kind, touched = "signal_id long, rumour_id long", [[(1, 1), (2, 2), (3, None)], [(4, 1), (5, 2), (6, 3)], [(7, 2), (8, 3)]]
    for k, rows in enumerate(touched):
        now["k"] = k
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.stream_change_feed(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), score, path, str(tmp_path / "state"))
        q.processAllAvailable()
        q.stop()
    events = spark.read.json(f"{path}/events").collect()
    told = {}
    for r in events:
        told.setdefault(r.batch, []).append((r.event, json.loads(r.data)))
    brief = {b: sorted((e, d.get("id"), d.get("likelihood")) for e, d in v if e != "ingest:totals") for b, v in told.items()}
    assert brief == {0: [("rumour:new", 1, 10.0), ("rumour:new", 2, 20.0)], 1: [("rumour:new", 3, 5.0), ("rumour:updated", 1, 75.0)], 2: [("rumour:removed", 2, None)]}
    assert [d for e, d in sum(told.values(), []) if e == "ingest:totals" and d["matched"] == 2 and d["signals"] == 3]
    from tidewire.sources import io

    assert {r.id: (r.likelihood, r.status) for r in io.live_state(spark, path).collect()} == states[2]
    # the live state follows from the feed alone
    log = spark.createDataFrame([(d["id"], d["likelihood"], d["status"], b) for b, v in told.items() for e, d in v if e in ("rumour:new", "rumour:updated")], "id long, likelihood double, status string, ts long")
    assert {r.id: r.likelihood for r in jobs.stream_live_state(log).collect()} == {1: 75.0, 2: 20.0, 3: 5.0}
