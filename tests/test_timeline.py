"""As-of timelines against direct comparison: nulls, equal times, hot keys, before and after."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators.timeline import as_of, changes


def case(seed=5):
    rng = random.Random(seed)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(40), rng.randrange(1, 9)) for _ in range(400)]
    seen = {}
    for k, t, v in events:
        seen[k, t] = seen.get((k, t), 0) + v
    asks = [(rng.choice([1, 2, 3, 4, None]), rng.randrange(-3, 45)) for _ in range(150)] + [(1, None)]
    return [(k, t, v, t) for (k, t), v in seen.items()], asks


@pytest.mark.parametrize(("after", "strict"), [(False, False), (False, True), (True, False), (True, True)])
def test_as_of_equals_direct_comparison(spark, after, strict):
    events, asks = case()
    e = spark.createDataFrame(events, "k long, us long, v long, at long").withColumn("at", -F.col("at") if after else F.col("at"))
    got = {(r.k, r.us): (r.v, r["at"]) for r in as_of(e, spark.createDataFrame(asks, "k long, us long"), ["k"], ["v"], ["at"], after, strict).collect()}
    fits = {(False, False): lambda t, u: t <= u, (False, True): lambda t, u: t < u, (True, False): lambda t, u: t >= u, (True, True): lambda t, u: t > u}[after, strict]
    want = {}
    for k, u in asks:
        if u is not None:
            met = [(t, v) for c, t, v, _ in events if c == k and fits(t, u)]
            want[k, u] = (sum(v for _, v in met), None if not met else -min(t for t, _ in met) if after else max(t for t, _ in met))
    assert got == want


def test_as_of_without_events_or_asks(spark):
    events, asks = case()
    e, a = spark.createDataFrame(events, "k long, us long, v long, at long"), spark.createDataFrame(asks, "k long, us long")
    assert as_of(e, a.limit(0), ["k"], ["v"]).count() == 0
    assert {r.v for r in as_of(e.limit(0), a, ["k"], ["v"], ["at"]).collect()} == {0}


def test_changes_are_those_between_neighbours(spark):
    rng = random.Random(2)
    values = {(rng.choice([1, 1, 1, 2, None]), t): rng.randrange(2) for t in rng.sample(range(300), 200)}
    got = {(r.k, r.us): (r.first, r.delta) for r in changes(spark.createDataFrame([(k, t, v) for (k, t), v in values.items()], "k long, us long, v long"), ["k"], "v").collect()}
    want, last = {}, {}
    for (k, t), v in sorted(values.items(), key=lambda x: x[0][1]):
        want[k, t] = (k not in last, v - last.get(k, 0))
        last[k] = v
    assert got == want


def test_nearest_point_of_two(spark):
    from tidewire.operators import reports

    series = spark.createDataFrame([(1, 10), (1, 20), (1, 20), (2, 5), (None, 7)], "claim_id long, s long").select("claim_id", F.timestamp_seconds("s").alias("predicted_at"))
    events = spark.createDataFrame([(1, 1, 3), (1, 2, 14), (1, 3, 15), (1, 4, 16), (1, 5, 99), (2, 6, 5), (3, 7, 5), (None, 8, 9)], "claim_id long, id long, s long").select("claim_id", "id", F.timestamp_seconds("s").alias("at"))
    got = {r.id: int(r.n) for r in reports.nearest_point(series, events).select("id", F.unix_seconds("nearest").alias("n")).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 20, 5: 20, 6: 5, 8: 7}


def test_numbers_of_a_hot_key_over_many_ranges(spark):
    from tidewire.operators.slices import numbered

    rng = random.Random(9)
    rows = [(None if i % 50 == 0 else 1 if i % 3 else i % 7, rng.randrange(5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, id long").repartition(6)
    got = {r.id: r.n for r in numbered(df, ["k"], [F.desc("t"), F.col("id")], "n").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want
    assert numbered(df.limit(0), ["k"], [F.col("t")], "n").count() == 0


@pytest.mark.parametrize("after", [False, True])
def test_long_keys_are_cut_into_slices(spark, monkeypatch, after):
    from tidewire.operators import slices

    events, asks = case(7)
    e, a = spark.createDataFrame(events, "k long, us long, v long, at long"), spark.createDataFrame(asks, "k long, us long")
    turns = e.select("k", "us", "v")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = rows(as_of(e, a, ["k"], ["v"], ["at"], after)), rows(changes(turns, ["k"], "v"))
    monkeypatch.setattr(slices, "HOT", 30)
    assert slices.long_keys(turns, ["k"]).count() > 0
    assert (rows(as_of(e, a, ["k"], ["v"], ["at"], after)), rows(changes(turns, ["k"], "v"))) == whole


def test_evidence_of_long_claims_adds_up_as_that_of_short_ones(spark, monkeypatch):
    from tidewire.operators import forecast, slices

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(4), rng.choice([None, i // 3]), rng.randrange(60), rng.choice(["SUPPORTS", "DENIES", "CONFIRMS", "CONTEXTUAL"]), rng.choice(["CLUB_OFFICIAL", "NEWS_OUTLET"]), float(rng.randrange(5))) for i in range(200)]
    ev = spark.createDataFrame(rows, "claim_id long, id long, source_id long, root_id long, s long, direction string, source_type string, confidence double").withColumn("published_at", F.timestamp_seconds("s"))
    asks = spark.createDataFrame([(c, t) for c in (1, 2, 3, 4, None) for t in range(-1, 70, 7)], "claim_id long, s long").select("claim_id", F.timestamp_seconds("s").alias("as_of"))
    sources = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "id long, tier int")
    got = lambda: {(r.claim_id, str(r.as_of)): (r.n, r.roots, r.sources, r.siding, r.conf, r.pro, r.newest) for r in forecast.evidence_as_of(asks, ev, sources).collect()}
    whole = got()
    for (claim, _), (n, roots, seen, siding, *_) in zip(sorted(whole, key=str), [whole[k] for k in sorted(whole, key=str)], strict=True):
        assert siding <= seen <= 4 and roots <= n
    last = {c: [r for r in rows if r[0] == c] for c in (1, 2, 3, None)}
    end = max(k[1] for k in whole)
    for c, of in last.items():
        sides = {s: max((r[4], r[1], r[5] in ("SUPPORTS", "CONFIRMS")) for r in of if r[2] == s)[2] for s in {r[2] for r in of}}
        assert whole[c, end][:4] == (len(of), len({r[1] if r[3] is None else r[3] for r in of}), len(sides), sum(sides.values()))
    monkeypatch.setattr(slices, "HOT", 40)
    assert got() == whole


def test_nearest_points_of_long_claims(spark, monkeypatch):
    from tidewire.operators import reports, slices

    rng = random.Random(4)
    points, at = [(rng.choice([1, 1, 2, None]), rng.randrange(100)) for _ in range(60)], [(rng.choice([1, 1, 2, 3, None]), i, rng.randrange(-5, 110)) for i in range(90)]
    series = spark.createDataFrame(points, "claim_id long, s long").select("claim_id", F.timestamp_seconds("s").alias("predicted_at"))
    events = spark.createDataFrame(at, "claim_id long, id long, s long").select("claim_id", "id", F.timestamp_seconds("s").alias("at"))
    want = {i: min((abs(p - t), p) for k, p in points if k == c)[1] for c, i, t in at if any(k == c for k, _ in points)}
    for most in (slices.HOT, 12):
        monkeypatch.setattr(slices, "HOT", most)
        assert {r.id: r.n for r in reports.nearest_point(series, events).select("id", F.unix_seconds("nearest").alias("n")).collect()} == want
