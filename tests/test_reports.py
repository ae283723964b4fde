"""Citations with the own source taken out, rescoring of a stream, and reports on odd tables."""

from pyspark.sql import functions as F


def test_own_source_is_taken_out_before_the_choice(spark):
    from tidewire.operators import evidence

    sources = spark.createDataFrame([(1, "Sky Sports"), (2, "Sky Sports News"), (3, "Marca")], "id long, name string")
    items = spark.createDataFrame([(10, 1, "A deal, according to Sky Sports News Desk, is near"), (11, 3, "A deal, according to Marca, is near"), (12, None, "A deal, according to Marca, is near")], "id long, source_id long, text string")
    got = {r.id: r.cited_source_id for r in evidence.match_cited_source(items, sources).collect()}
    assert got == {10: 2, 12: 3}


def test_stream_rescore_scores_what_a_batch_touched(spark, tmp_path):
    from tidewire.streaming.jobs import stream_rescore

    for n, rows in enumerate(([(1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (7, "2024-01-01 00:00:00")], [(2, "2024-01-03 00:00:00"), (1, "2024-01-03 12:00:00")])):
        spark.createDataFrame(rows, "rumour_id long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.json(f"{tmp_path}/in/{n}")
        touched = spark.readStream.schema("rumour_id long, at timestamp").option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
        run = stream_rescore(touched, lambda s: s.createDataFrame([(1, 40.0), (2, 55.0), (3, 60.0)], "id long, likelihood double"), f"{tmp_path}/out", f"{tmp_path}/state")
        run.processAllAvailable()
        run.stop()
    got = sorted((r.rumour_id, r.likelihood, str(r.recorded_at)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 40.0, "2024-01-02 00:00:00"), (1, 40.0, "2024-01-03 12:00:00"), (2, 55.0, "2024-01-03 00:00:00")]


def test_external_ids_and_nearest_points(spark):
    from tidewire.operators import reports

    rows = spark.createDataFrame([("p1", "c1", None), ("p9", "c1", "c1"), ("p1", "c8", "c1")], "player_external_id string, from_club_external_id string, to_club_external_id string")
    players = spark.createDataFrame([(5, "p1"), (4, "p1"), (6, None)], "id long, external_id string")
    clubs = spark.createDataFrame([(2, "c1")], "id long, external_id string")
    got = sorted((r.player_id, r.from_club_id or 0, r.to_club_id or 0) for r in reports.resolve_external_ids(rows, players, clubs).collect())
    assert got == [(4, 0, 2), (4, 2, 0)]
    series = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-03"), (1, "2024-01-09")], "claim_id long, at string").select("claim_id", F.to_timestamp("at").alias("predicted_at"))
    events = spark.createDataFrame([(1, 1, "2024-01-02"), (1, 2, "2024-01-20"), (2, 3, "2024-01-02")], "claim_id long, id long, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.id: str(r.nearest)[:10] for r in reports.nearest_point(series, events).collect()}
    assert got == {1: "2024-01-01", 2: "2024-01-09"}


def test_events_are_stripped_to_allowed_keys(spark):
    from tidewire.operators import reports

    rows = spark.createDataFrame([("upgrade", '{"featureKey": "x", "claimId": 3}'), ("panel", '{"claimId": 3}'), ("other", "{}"), (None, None), ("upgrade", None)], "event_type string, metadata string")
    got = [(r.valid, r.metadata) for r in reports.validate_product_events(rows, {"upgrade": ("featureKey",), "panel": ()}).collect()]
    assert got == [(True, '{"featureKey":"x"}'), (True, None), (False, None), (False, None), (True, None)]
