"""Rules, evidence, outcomes and forecasts on small fixtures."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.functions import rules, text
from tidewire.operators import evidence, forecast, outcomes, serving
from tidewire.sources import io

T0 = datetime(2025, 1, 1)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_rules(spark):
    h = F.col("h")
    assert one(spark, text.detect_outcome(h), h="Deal confirmed, but saga over") == "COMPLETED"
    assert one(spark, text.detect_outcome(h), h="He is not joining") == "FAILED"
    assert one(spark, text.is_transfer_related(h, F.lit("")), h="Mercato : le capitaine") is True
    assert one(spark, text.is_transfer_related(h, F.lit("")), h="Training ground photos") is False
    assert one(spark, text.implied_reliability(h), h="[Tier 3] news") == 0.6
    assert one(spark, text.normalise(h), h="Saint-Germain\nÉtienne") == "saintgermainetienne"
    assert one(spark, text.resolve_alias(h), h="Spurs") == "Tottenham"
    assert one(spark, text.cited_name(h), h="out, according to Fabrizio Romano, today") == "Fabrizio Romano"
    assert one(spark, text.contains_whole_token(h, F.lit("ham")), h="west ham won") is True
    assert one(spark, text.name_similarity(h, F.lit("José Álvarez")), h="jose alvarez") == 1.0
    assert one(spark, text.text_similarity(h, F.lit("a b c d")), h="a b c e") == 0.6


def test_likelihood_is_monotone_and_bounded(spark):
    rows = spark.createDataFrame([(r, m, n) for r in (0.0, 0.5, 1.0) for m in (0.0, 12.0, 30.0) for n in (1, 3, 9)], "r double, m double, n int")
    none = F.lit(None).cast("double")
    got = {(x.r, x.m, x.n): x.s for x in rows.select("*", rules.likelihood_score(F.col("r"), F.col("m"), none, none, none, F.col("n"), none).alias("s")).collect()}
    assert all(0 <= s <= 100 for s in got.values())
    assert got[1.0, 0.0, 9] > got[0.5, 0.0, 9] > got[0.0, 0.0, 9] and got[0.5, 0.0, 3] > got[0.5, 12.0, 3] > got[0.5, 30.0, 3]


def test_window_cutoffs(spark):
    at = lambda w, *day: one(spark, rules.window_cutoff(F.col("w"), F.col("d")), w=w, d=datetime(*day))
    assert at("SUMMER", 2026, 7, 1) == datetime(2026, 8, 31, 23, 59, 59) and at("SUMMER", 2026, 9, 1) == datetime(2027, 8, 31, 23, 59, 59)
    assert at("WINTER", 2026, 10, 1) == datetime(2027, 1, 31, 23, 59, 59) and at("FREE_AGENT", 2026, 1, 1) is None


def test_anchored_fold(spark):
    rows = [(i, 1, None, 2, T0 + timedelta(days=d), 1) for i, d in enumerate((0, 6, 8, 14, 15, 16))]
    df = spark.createDataFrame(rows, "id long, player_id long, from_club_id long, to_club_id long, rumour_date timestamp, source_id long")
    got = [(r.anchor - T0).days for r in outcomes.assign_rumours(df).orderBy("id").collect()]
    assert got == [0, 0, 8, 8, 8, 16]


def test_reliability_closed_form_equals_fold(spark):
    import random

    random.seed(2)
    outs, srcs, want = [], [], {}
    for s, n in enumerate((0, 1, 19, 20, 21, 60)):
        score, h0, m0 = 0.5, s % 3, s % 2
        hits, total = h0, h0 + m0
        for k in range(n):
            hit = random.random() < 0.7
            outs.append((s * 1000 + k, s, T0 + timedelta(hours=k), hit))
            hits, total = hits + hit, total + 1
            w = min(total / 20, 1)
            score = min(0.99, max(0.1, score * (1 - w) + hits / total * w))
        srcs.append((s, 0.5, h0, m0))
        want[s] = (hits, total - hits, round(score, 9))
    o = spark.createDataFrame(outs, "id long, source_id long, at timestamp, hit boolean")
    got = outcomes.source_reliability(o, spark.createDataFrame(srcs, "id long, reliability double, hit_count long, miss_count long"))
    assert {r.id: (r.hits, r.misses, round(r.score, 9)) for r in got.collect()} == want


def test_five_copies_are_one_source(spark):
    sources = spark.createDataFrame([(i, n) for i, n in enumerate(["Fabrizio Romano", "Sky Sports", "Sky Sports News", "Le Monde", "Kicker"])], "id long, name string")
    says = ["The deal is near", "as reported by Fabrizio Romano", "according to Fabrizio Romano", "citing fabrizio", "via Fabrizio Romano"]
    ev = spark.createDataFrame([(10 + i, 1, i, i, T0 + timedelta(hours=i), t) for i, t in enumerate(says)], "id long, claim_id long, source_id long, seq long, published_at timestamp, text string")
    parents = evidence.attribution_parents(ev, evidence.match_cited_source(ev, sources))
    roots = evidence.resolve_roots(ev.select("id").join(parents, "id", "left"))
    got = {r.id: r.root_id for r in roots.collect()}
    assert got == {10: 10, 11: 10, 12: 10, 13: 13, 14: 10}
    counted = evidence.independent_source_count(ev.join(roots, "id")).first()
    assert (counted.independent, counted.evidence) == (2, 5)


def test_near_duplicates_equal_naive_join(spark):
    import random

    random.seed(4)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, i % 3, i, " ".join(random.choices(words, k=random.randint(0, 9)))) for i in range(90)]
    got = {(r.item_id, r.candidate_id) for r in evidence.near_duplicate_pairs(spark.createDataFrame(rows, "id long, claim_id long, seq long, text string")).collect()}
    sets = {i: set(t.split()) for i, _, _, t in rows}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    first = {i: min(j for j, d, _, _ in rows if c == d and sets[j] == sets[i]) for i, c, _, _ in rows}
    assert sum(first[i] != i for i in first) > 3
    whole = {(i, j) for i, c, _, _ in rows for j, d, _, _ in rows if c == d and j < i and like(sets[i], sets[j]) >= 0.55}
    assert got == {(i, j) for i, j in whole if first[i] == i and first[j] == j} | {(i, first[i]) for i in first if first[i] != i}


def test_near_duplicates_of_nulls_and_long_texts(spark):
    rows = [(1, None, 1, None), (2, None, 2, ".."), (3, None, 3, "a b c d"), (4, None, 4, "a b c e"), (5, 7, 5, ""), (6, 7, 6, None), (7, 7, 7, "a b c d"), (8, 7, 8, "D C b a a"), (9, 8, 9, " ".join(f"x{i}" for i in range(30_000))), (10, 8, 10, " ".join(f"x{i}" for i in range(29_000)))]
    got = {(r.item_id, r.candidate_id, round(r.similarity, 3)) for r in evidence.near_duplicate_pairs(spark.createDataFrame(rows, "id long, claim_id long, seq long, text string")).collect()}
    assert got == {(2, 1, 1.0), (4, 3, 0.6), (6, 5, 1.0), (8, 7, 1.0), (10, 9, 0.967)}


def test_near_duplicates_lose_nothing_at_any_threshold(spark):
    import random

    random.seed(6)
    words = [f"w{i}" for i in range(60)]
    base = [random.choices(words, k=random.randint(5, 40)) for _ in range(12)]
    rows = [(i, i % 2, i, " ".join(w if random.random() > 0.15 else random.choice(words) for w in random.choice(base))) for i in range(160)]
    sets = {i: frozenset(t.split()) for i, _, _, t in rows}
    df = spark.createDataFrame(rows, "id long, claim_id long, seq long, text string")
    for t in (0.3, 0.55, 0.8):
        got = {(r.item_id, r.candidate_id) for r in evidence.near_duplicate_pairs(df, t).collect()}
        first = {i: min(j for j, d, _, _ in rows if c == d and sets[j] == sets[i]) for i, c, _, _ in rows}
        want = {(i, j) for i, c, _, _ in rows for j, d, _, _ in rows if c == d and j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t and first[i] == i and first[j] == j}
        assert got == want | {(i, first[i]) for i in first if first[i] != i} and len(want) > 20


def test_near_duplicates_across_small_blocks(spark, monkeypatch):
    import random

    random.seed(8)
    monkeypatch.setattr(evidence, "BLOCK", 5)
    monkeypatch.setattr(evidence, "BLOCK_BITS", 2_000)
    monkeypatch.setattr(evidence, "TILE", 2)
    base = [[f"w{random.randrange(500)}" for _ in range(random.randint(1, 90))] for _ in range(9)]
    rows = [(i, i % 2 if i % 7 else None, 200 - i, " ".join(w for w in random.choice(base) if random.random() > 0.2)) for i in range(130)]
    sets = {i: frozenset(t.split()) for i, _, _, t in rows}
    got = {(r.item_id, r.candidate_id) for r in evidence.near_duplicate_pairs(spark.createDataFrame(rows, "id long, claim_id long, seq long, text string")).collect()}
    first = {i: max(j for j, d, _, _ in rows if c == d and sets[j] == sets[i]) for i, c, _, _ in rows}  # later ids come earlier
    like = lambda a, b: len(a & b) / max(1, len(a | b))
    want = {(i, j) for i, c, _, _ in rows for j, d, _, _ in rows if c == d and i < j and like(sets[i], sets[j]) >= 0.55 and first[i] == i and first[j] == j}
    assert got == want | {(i, first[i]) for i in first if first[i] != i} and len(want) > 20


def test_features_do_not_see_the_future(spark):
    ev = spark.createDataFrame([(1, 1, 1, datetime(2025, 1, 5), "SUPPORTS", "NEWS_OUTLET", 0.9, None), (2, 1, 1, datetime(2025, 2, 1), "CONFIRMS", "CLUB_OFFICIAL", 0.9, None)], "id long, claim_id long, source_id long, published_at timestamp, direction string, source_type string, confidence double, root_id long")
    claims = spark.createDataFrame([(1, 7, None, None, "LOAN", None, T0)], "id long, player_id long, stated_fee double, stated_months int, transfer_type string, window string, first_seen_at timestamp")
    players = spark.createDataFrame([(8, T0)], "id long, contract_end timestamp")
    src = spark.createDataFrame([(1, 2)], "id long, tier int")
    asked = spark.createDataFrame([(1, datetime(2025, 1, 10)), (1, datetime(2025, 1, 2)), (1, datetime(2024, 12, 1))], "claim_id long, as_of timestamp")
    f = {r.as_of: r for r in forecast.evidence_features(asked, ev, src, claims, players).collect()}
    now, before = f[datetime(2025, 1, 10)], f[datetime(2025, 1, 2)]
    assert datetime(2024, 12, 1) not in f  # the claim was not there yet
    assert (now.evidenceCount, now.hasOfficialConfirmation, now.independentRootCount, now.monthsToContractExpiry, now.windowDaysRemaining) == (1, 0, 1, -1, -1)
    assert (before.evidenceCount, before.hasEvidence, before.mostRecentEvidenceAgeHours, before.sourceTierScore) == (0, 0, 8760, 0.5)


def test_forecast_training(spark):
    import random

    random.seed(1)
    rows = []
    for i in range(400):
        x = [random.random() for _ in forecast.FEATURES]
        rows.append((i, T0 + timedelta(days=i), *x, int(x[2] + 0.3 * random.random() > 0.6)))
    df = spark.createDataFrame(rows, ["claim_id", "as_of", *forecast.FEATURES, "label"])
    split = forecast.time_split(df)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 240, "validation": 80, "test": 80}
    model, isotonic, metrics = forecast.train_forecast(split)
    assert metrics.first().brier < 0.12
    assert forecast.score_forecasts(split, model, isotonic).where("p between 0 and 1").count() == 400


def test_dashboard_and_links(spark):
    clubs = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    players = spark.createDataFrame([(5, 1)], "id long, current_club_id long")
    rum = spark.createDataFrame([(1, 1, 2, 10.0, 20.0, 50.0, "HOT"), (2, 1, 2, None, None, 50.0, "PENDING"), (3, 2, 1, 1.0, 2.0, 99.0, "FAILED")], "id long, from_club_id long, to_club_id long, fee_min double, fee_max double, likelihood double, status string")
    got = {r.id: (r.squad, r.n_in, r.n_out, r.expected_spend) for r in serving.club_dashboard(clubs, players, rum).collect()}
    assert got == {1: (1, 0, 2, 0.0), 2: (0, 2, 0, 3.0)}
    links = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("", 4), ("b", 5)], "link string, n int").withColumns({"published_at": F.timestamp_seconds("n"), "headline": F.lit("h")})
    assert {r.n for r in io.drop_seen(links, links.where("link = 'b'")).collect()} == {1, 3, 4}


def test_readers(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Tier 1: deal near</title><link>u1</link><pubDate>Tue, 05 Aug 2025 10:00:00 GMT</pubDate><description>x</description></item><item><title>Photos</title><link>u2</link></item></channel></rss>")
    r = io.read_feed_items(spark, str(tmp_path / "f.xml"), "feed", F.lit(T0)).collect()
    assert [(x.link, x.implied_reliability, x.published_at) for x in r] == [("u1", 1.0, datetime(2025, 8, 5, 10))]
    (tmp_path / "t.json").write_text('{"data":[{"id":589042,"player_id":1,"from_team_id":2,"to_team_id":3,"date":"2025-07-01","completed":true,"amount":null,"extra":1}]}')
    t = io.read_provider_transfers(spark, str(tmp_path / "t.json"), F.lit(T0)).first()
    assert (t.external_id, t.base_probability, t.fee_min, t.window) == ("sm-589042", 1.0, None, "SUMMER")


def test_stream_equals_batch(spark, tmp_path):
    from tidewire.streaming import jobs

    rows = [(i % 3, float(i), "HOT" if i > 4 else "PENDING", T0 + timedelta(minutes=i)) for i in range(9)]
    spark.createDataFrame(rows, "id long, likelihood double, status string, ts timestamp").write.parquet(str(tmp_path / "in"))
    live = jobs.stream_live_state(spark.readStream.schema("id long, likelihood double, status string, ts timestamp").parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("live").collect()} == {(0, 6.0, "HOT"), (1, 7.0, "HOT"), (2, 8.0, "HOT")}


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)


def test_anchors_equal_a_plain_fold(spark):
    import random

    random.seed(9)
    rows = [(i, random.choice([1, 2, None]), None, random.choice([3, None]), T0 + timedelta(hours=random.randint(0, 2000)), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, player_id long, from_club_id long, to_club_id long, rumour_date timestamp, source_id long")
    want, at = {}, {}
    for i, a, b, c, t, _ in sorted(rows, key=lambda r: r[4]):
        if (a, b, c) not in at or t > at[a, b, c] + timedelta(days=7):
            at[a, b, c] = t
        want[i] = at[a, b, c]
    assert {r.id: r.anchor for r in outcomes.assign_rumours(df).collect()} == want


def test_auc_and_history_by_slices(spark):
    import random

    random.seed(10)
    rows = [(random.randint(0, 300) / 300, int(random.random() < 0.3)) for _ in range(900)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(forecast.rank_auc(spark.createDataFrame(rows, "p double, y int")).first().auc - want) < 1e-12
    assert forecast.rank_auc(spark.createDataFrame([], "p double, y int")).first().auc is None
    done = [(i, random.choice([1, 1, 1, 2]), T0 + timedelta(hours=random.randint(0, 99)), random.random() < 0.5) for i in range(500)]
    none = spark.createDataFrame([], "id long, reliability double, hit_count long, miss_count long")
    got = {r.id: (r.hits, r.misses) for r in outcomes.reliability_history(spark.createDataFrame(done, "id long, source_id long, at timestamp, hit boolean"), none).collect()}
    for i, s, t, _ in done:
        seen = [h for j, z, u, h in done if z == s and (u, j) <= (t, i)]
        assert got[i] == (sum(seen), len(seen) - sum(seen))
