"""Watchlists in order: the cap, removals, tiers; and outcomes with their history."""

from datetime import datetime, timedelta

from tidewire.operators import outcomes, watchlists

T0 = datetime(2025, 1, 1)
KIND = "id long, user_id long, player_id long, action string, tier string, created_at timestamp"


def replayed(spark, steps, users=None):
    rows = [(i, u, p, a, t, T0 + timedelta(minutes=i)) for i, (u, p, a, t) in enumerate(steps)]
    users = users and spark.createDataFrame(users, "id long, tier string")
    return {r.id: (r.accepted, r.was_created, r.held) for r in watchlists.watchlist_replay(spark.createDataFrame(rows, KIND), users).collect()}


def test_free_cap_removals_and_repeats(spark):
    steps = [(1, p, "ADD", None) for p in range(5)] + [(1, 9, "ADD", None), (1, 0, "ADD", None), (1, 3, "REMOVE", None), (1, 9, "ADD", None), (1, 77, "REMOVE", None), (1, 8, "OTHER", None)]
    got = replayed(spark, steps)
    assert [got[i] for i in range(11)] == [(True, True, i + 1) for i in range(5)] + [(False, False, 5), (True, False, 5), (True, False, 4), (True, True, 5), (True, False, 5), (False, False, 5)]


def test_tiers_lift_and_bring_back_the_cap(spark):
    steps = [(2, p, "ADD", None) for p in range(6)] + [(2, None, "TIER", "PRO")] + [(2, p, "ADD", None) for p in range(5, 8)] + [(2, None, "TIER", "FREE"), (2, 1, "ADD", None), (2, 50, "ADD", None)]
    steps += [(2, p, "REMOVE", None) for p in range(4)] + [(2, 50, "ADD", None), (3, 1, "ADD", None)] + [(4, p, "ADD", None) for p in range(9)] + [(None, 1, "ADD", None)]
    got = replayed(spark, steps, [(4, "RESEARCH"), (2, "FREE")])
    assert got[5] == (False, False, 5) and got[9] == (True, True, 8) and got[11] == (True, False, 8) and got[12] == (False, False, 8)
    assert got[17] == (True, True, 5) and got[18] == (True, True, 1) and got[27] == (True, True, 9) and got[28] == (True, True, 1)
    assert watchlists.watchlist_replay(spark.createDataFrame([], KIND)).count() == 0


def test_outcomes_write_one_history_row(spark):
    rumours = spark.createDataFrame([(1, "PENDING", 40.0), (2, "COMPLETED", 100.0), (3, "FAILED", 0.0), (4, "HOT", 75.0), (5, "HOT", 75.0)], "id long, status string, likelihood double")
    at = lambda d: T0 + timedelta(days=d)
    said = [(1, at(2), "FAILED", False), (1, at(1), "COMPLETED", False), (2, at(1), "FAILED", False), (3, at(1), "COMPLETED", True), (3, at(2), "FAILED", True), (4, at(1), "DENIED", True), (9, at(1), "FAILED", False)]
    df = spark.createDataFrame(said, "rumour_id long, at timestamp, status string, forced boolean")
    assert {r.id: (r.status, r.likelihood) for r in outcomes.apply_outcomes(rumours, df).collect()} == {1: ("COMPLETED", 100.0), 2: ("COMPLETED", 100.0), 3: ("FAILED", 0.0), 4: ("DENIED", 0.0), 5: ("HOT", 75.0)}
    assert {(r.rumour_id, r.status, r.likelihood, r.recorded_at) for r in outcomes.outcome_history(rumours, df).collect()} == {(1, "COMPLETED", 100.0, at(1)), (4, "DENIED", 0.0, at(1))}


def test_running_score_is_the_fold_at_every_step(spark):
    import random

    rng = random.Random(1)
    rows = [(i, s, T0 + timedelta(hours=i), rng.random() < 0.5) for s, n in ((1, 40), (2, 7), (3, 19), (None, 3)) for i in range(s * 100 if s else 900, (s * 100 if s else 900) + n)]
    stored = {1: (0.7, 0, 0), 2: (0.4, 8, 6), 3: (0.9, 1, 0)}
    sources = spark.createDataFrame([(k, *v) for k, v in stored.items()], "id long, reliability double, hit_count long, miss_count long")
    got = {r.id: (r.hits, r.misses, round(r.score, 9)) for r in outcomes.reliability_history(spark.createDataFrame(rows, "id long, source_id long, at timestamp, hit boolean"), sources).collect()}
    want = {}
    for s in (1, 2, 3, None):
        score, h, m = stored.get(s, (0.5, 0, 0))
        for i, _, _, hit in sorted((r for r in rows if r[1] == s), key=lambda r: r[2]):
            h, m = h + hit, m + (not hit)
            w = min((h + m) / 20, 1)
            score = max(0.1, min(0.99, score * (1 - w) + h / (h + m) * w))
            want[i] = (h, m, round(score, 9))
    assert got == want
