"""Factors, questions, provenance graphs, enrichment and the likelihood forest on small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import enrichment, explain, forecast

T0 = datetime(2025, 1, 1)
EVIDENCE = "id long, claim_id long, source_id long, published_at timestamp, direction string, source_type string, root_id long, parent_id long, title string"
CLAIMS = "id long, player_id long, from_club_id long, to_club_id long, window string, stated_fee double, last_evidence_at timestamp"


def cases(spark):
    claims = spark.createDataFrame([(1, 7, 1, 2, "SUMMER", 5.0, T0), (2, 7, None, 2, None, None, T0), (3, 8, 1, 2, "WINTER", None, T0), (4, 7, 1, 2, "SUMMER", None, T0)], CLAIMS)
    news = "NEWS_OUTLET"
    rows = [(10, 1, 1, T0, "SUPPORTS", news, None, None, "a"), (11, 1, 2, T0, "SUPPORTS", news, 10, 10, "b"), (12, 1, 2, T0 + timedelta(1), "CONTRADICTS", news, None, None, "c"), (13, 1, 3, T0 + timedelta(2), "CONFIRMS", "CLUB_OFFICIAL", None, None, "d")]
    rows += [(20, 2, 1, T0, "SUPPORTS", news, None, None, None), (21, 2, 1, T0, "SUPPORTS", news, 20, None, None), (40, 4, 9, T0, "DENIES", "CLUB_OFFICIAL", None, None, "x"), (99, 77, 1, T0, "SUPPORTS", news, None, None, "no claim")]
    return claims, spark.createDataFrame(rows, EVIDENCE)


def test_factors(spark):
    claims, evidence = cases(spark)
    sources = spark.createDataFrame([(2, "Daily"), (3, None)], "id long, name string")
    factors = explain.forecast_factors(claims, evidence, F.lit(T0 + timedelta(30)), sources)
    got = {(r.claim_id, r.factor, r.direction, round(r.magnitude, 6), r.evidence_id) for r in factors.collect()}
    assert got == {
        (1, "Official club confirmation", "positive", 1.0, 13), (1, "3 independent sources", "positive", 0.45, 10), (1, "Conflicting report", "negative", 0.5, 12), (1, "Specific fee reported", "positive", 0.25, None),
        (2, "Single original source", "negative", 0.4, 20), (2, "Evidence has gone quiet", "negative", 0.25, None),
        (3, "No corroborating evidence", "negative", 0.5, None), (3, "Evidence has gone quiet", "negative", 0.25, None), (4, "Official club denial", "negative", 1.0, 40),
    }
    told = {(r.claim_id, r.factor): r.explanation for r in factors.collect()}
    assert told[1, "Official club confirmation"] == "The club has officially confirmed this." and told[1, "Conflicting report"] == "Daily published a report that contradicts this claim."
    assert told[1, "Specific fee reported"] == "A specific fee (€5M) has been reported, suggesting detailed sourcing rather than speculation."
    assert told[2, "Single original source"].startswith("All 2 articles trace back") and told[2, "Evidence has gone quiet"] == "No new evidence in 30 days."
    assert [r.factor for r in explain.top_factors(factors, "positive", 2).where("claim_id = 1").orderBy("rank").collect()] == ["Official club confirmation", "3 independent sources"]
    assert explain.forecast_factors(claims.limit(0), evidence, F.lit(T0)).count() == 0
    assert {r.factor for r in explain.forecast_factors(claims, evidence.limit(0), F.lit(T0)).collect()} == {"No corroborating evidence", "Specific fee reported"}


def test_open_questions(spark):
    got = {}
    for r in explain.open_questions(*cases(spark)).collect():
        got.setdefault(r.claim_id, set()).add(r.question)
    assert got == {1: {"denial", "time"}, 2: {"confirmation", "denial", "corroboration"}, 3: {"confirmation", "denial", "corroboration", "time"}, 4: {"confirmation", "corroboration", "time"}}


def test_provenance_graph(spark):
    claims, evidence = cases(spark)
    players = spark.createDataFrame([(7, "P")], "id long, name string")
    clubs = spark.createDataFrame([(1, "One", None), (2, "Two", "T")], "id long, name string, short_name string")
    sources = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, None)], "id long, name string")
    edges = {(r.kind, r.source, r.target) for r in explain.provenance_edges(claims, evidence, players, clubs).where("claim_id = 1").collect()}
    assert edges == {
        ("originated", "claim-1", "player-7"), ("originated", "claim-1", "club-1"), ("originated", "claim-1", "club-2"),
        ("originated", "source-1", "evidence-10"), ("originated", "source-2", "evidence-11"), ("originated", "source-2", "evidence-12"), ("originated", "source-3", "evidence-13"),
        ("cited", "evidence-11", "evidence-10"), ("corroborated", "evidence-10", "claim-1"), ("confirmed", "evidence-13", "claim-1"),
    }
    nodes = [(r.id, r.label) for r in explain.provenance_nodes(claims, evidence, sources, players, clubs).where("claim_id = 1").collect()]
    assert sorted(nodes) == sorted([("claim-1", "Claim #1"), ("player-7", "P"), ("club-1", "One"), ("club-2", "T"), ("evidence-10", "a"), ("evidence-11", "b"), ("evidence-12", "c"), ("evidence-13", "d"), ("source-1", "S1"), ("source-2", "S2"), ("source-3", "Source #3")])


def test_enrichment_keeps_known_values(spark):
    now = datetime(2026, 6, 1)
    players = spark.createDataFrame([(1, "Ann", 30, "ST", "Peru", None, None), (2, "Bea", None, None, None, None, now - timedelta(3)), (3, "Cid", None, None, None, None, now - timedelta(8)), (4, None, 5, None, None, None, None), (5, "Dov", 9, None, None, None, None)], "id long, name string, age int, position string, nationality string, kb_id string, enriched_at timestamp")
    found = spark.createDataFrame([("Ann", 1, "Q1", "Other", "football fan"), ("Ann", 3, "Q2", "ANN", "Footballer"), ("Bea", 1, "Q2", "Bea", "football"), ("Cid", 1, "Q3", "C", None), ("Cid", 2, "Q4", "El Cid", "football"), ("Dov", 1, "Q5", "Dov", "football"), (None, 1, "Q2", None, "football")], "name string, rank int, kb_id string, label string, description string")
    player = [enrichment.FOOTBALLER]
    entities = spark.createDataFrame([("Q1", player, "+1990", None, None), ("Q2", player, None, "Q200479", "N1"), ("Q4", player, "+2000-00-00", "Q7", "N9"), ("Q5", ["Q1"], "+1990", None, None)], "kb_id string, occupations array<string>, born string, position string, nationality string")
    labels = spark.createDataFrame([("N1", "Chile")], "kb_id string, label string")
    got = {r.id: (r.kb_id, r.age, r.position, r.nationality, r.enriched_at == now) for r in enrichment.enrich_players(players, found, entities, labels, F.lit(now)).collect()}
    assert got == {1: ("Q2", 30, "GK", "Chile", True), 2: (None, None, None, None, False), 3: ("Q4", 26, None, None, True), 4: (None, 5, None, None, False), 5: (None, 9, None, None, False)}


def test_likelihood_forest(spark):
    rows = [(i, 1 + i % 2, 1, None, 10.0, "COMPLETED" if i % 2 else "FAILED", T0, None, 1 + i % 3) for i in range(300)] + [(900, 1, 1, None, None, "HOT", T0, None, 1)]
    rumours = spark.createDataFrame(rows, "id long, source_id long, player_id long, fee_min double, fee_max double, status string, rumour_date timestamp, base_probability double, source_count int")
    sources = spark.createDataFrame([(1, 0.1), (2, 0.9)], "id long, reliability double")
    players = spark.createDataFrame([(1, None, None)], "id long, market_value double, contract_end timestamp")
    x = forecast.likelihood_features(rumours, sources, players)
    first = x.where("rumour_id = 900").first()
    assert (first.monthsToContractExpiry_missing, first.feeMid_missing, first.baseProbability_missing) == (1.0, 1.0, 1.0)
    model, metrics, importances = forecast.train_likelihood(x, trees=5, depth=3)
    assert metrics["test_r2"] > 0.9 and max(importances, key=importances.get) == "sourceReliability"
    scored = {r.rumour_id: r.score for r in forecast.score_likelihood(x, model).collect()}
    assert scored[900] < 10 and scored[1] > 90
    assert forecast.score_likelihood(x).where("score is null or score < 0 or score > 100").count() == 0
    with pytest.raises(ValueError):
        forecast.train_likelihood(x.where("rumour_id < 50"))


def test_forest_likelihood_fails_where_training_fails(spark, monkeypatch):
    from tidewire.plans import catalog

    rumours = spark.range(300).selectExpr("id", "1L source_id", "1L player_id", "1d fee_min", "2d fee_max", "if(id % 2 = 0, 'COMPLETED', 'FAILED') status", "timestamp'2026-01-01' rumour_date", "0.5d base_probability", "1 source_count")
    tables = {"sources": spark.sql("SELECT 1L id, 0.5d reliability"), "players": spark.sql("SELECT 1L id, 3d market_value, timestamp'2027-01-01' contract_end")}
    monkeypatch.setattr(catalog, "view", lambda spark, d, name: (tables | {"rumours": rumours}).get(name))
    query = catalog.forest_likelihood

    def broken(df, name):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")

    with monkeypatch.context() as patch:
        patch.setattr(forecast, "materialise", broken)
        with pytest.raises(ValueError, match="checkpoint"):
            query(spark, "")
    rumours = rumours.where("id < 50")
    assert [r.scored_by for r in query(spark, "").select("scored_by").distinct().collect()] == ["heuristic"]


def test_likelihood_forest_runs_on_all_cores(spark, monkeypatch):
    rows = spark.range(900).coalesce(1).withColumnRenamed("id", "rumour_id")
    dealt = forecast.over_all_cores(rows, 900)
    sizes = lambda df: df.groupBy(F.spark_partition_id()).count().collect()
    cores = spark.sparkContext.defaultParallelism
    assert rows.rdd.getNumPartitions() == 1 and len(sizes(dealt)) == cores and dealt.count() == 900
    monkeypatch.setattr(forecast, "TASK_ROWS", 100)
    assert len(sizes(forecast.over_all_cores(rows, 900))) == max(cores, 9)


def test_factors_read_the_evidence_once(spark, tmp_path):
    items = [(1, 10, 1, None, "CONFIRMS", "CLUB_OFFICIAL", 5), (1, 11, 2, 10, "CONFIRMS", "CLUB_OFFICIAL", 6), (1, 12, 3, None, "CONTRADICTS", "NEWS_OUTLET", 7), (1, 13, 1, None, "CONTRADICTS", "NEWS_OUTLET", 7), (2, 20, 2, None, "DENIES", "CLUB_OFFICIAL", 1), (2, 21, 9, 20, "SUPPORTS", "NEWS_OUTLET", 2)]
    spark.createDataFrame(items, "claim_id long, id long, source_id long, root_id long, direction string, source_type string, marker_s long").write.parquet(f"{tmp_path}/evidence")
    ev = spark.read.parquet(f"{tmp_path}/evidence").withColumn("published_at", F.timestamp_seconds("marker_s"))
    claims = spark.createDataFrame([(1, None, 0), (2, None, 0), (3, None, 0)], "id long, stated_fee double, s long").select("id", "stated_fee", F.timestamp_seconds("s").alias("last_evidence_at"))
    sources = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, name string")
    found = explain.forecast_factors(claims, ev, F.timestamp_seconds(F.lit(60)), sources)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("marker_s#") <= 4  # one relation and its uses
    got = {(r.claim_id, r.factor, r.evidence_id, r.explanation.split(" ")[0]) for r in found.collect()}
    assert got == {(1, "Official club confirmation", 11, "B"), (1, "3 independent sources", 10, "3"), (1, "Conflicting report", 12, "A"), (2, "Official club denial", 20, "B"), (2, "Single original source", 20, "All"), (3, "No corroborating evidence", None, "No")}


def test_evidence_is_numbered_by_tasks_of_bounded_size(spark, monkeypatch):
    from tidewire.plans import domain

    views = lambda: [domain.view(spark, "/root/testdata/sf0.001", n) for n in ("claims", "evidence", "sources", "players", "clubs")]
    want = sorted(map(tuple, explain.provenance_nodes(*views()).collect()), key=str)
    monkeypatch.setattr(domain, "TASK_ROWS", 500)
    evidence = views()[1].select("claim_id", "id")
    assert evidence.rdd.getNumPartitions() >= 10  # some 6,000 items, where the session's shuffles have 4 tasks
    assert sorted(map(tuple, explain.provenance_nodes(*views()).collect()), key=str) == want
