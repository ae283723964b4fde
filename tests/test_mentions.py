"""Mentions, outcome fallback and catalogue upkeep against plain Python."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import mentions

T0 = datetime(2025, 1, 1)


def test_players_and_mononyms(spark):
    signals = spark.createDataFrame([(1, "Vitinha linked with Real"), (2, "Vitinha Sousa scores; José Álvarez rests"), (3, None), (4, ""), (5, "Jose Alvarezz bid"), (1, "Vitinha linked with Real")], "id long, text string")
    players = spark.createDataFrame([(1, "Vitinha"), (2, "Vitinha Sousa"), (3, "Jose Álvarez"), (4, None), (5, "")], "id long, name string")
    found = mentions.match_players(signals, players)
    assert {(r.id, r.player_id, r.in_context) for r in found.collect()} == {(1, 1, True), (2, 1, False), (2, 2, False), (2, 3, False)}
    assert {(r.id, r.player_id) for r in mentions.drop_shadowed_mononyms(found).collect()} == {(1, 1), (2, 2), (2, 3)}
    assert mentions.match_players(signals.limit(0), players).count() == mentions.match_players(signals, players.limit(0)).count() == 0


def test_clubs_by_name_short_name_and_nickname(spark):
    signals = spark.createDataFrame([(1, "Spurs agree deal with Real Betis"), (2, "PSG want Tottenham winger"), (3, "nothing here")], "id long, text string")
    clubs = spark.createDataFrame([(1, "Tottenham", None), (2, "Real Betis", "Betis"), (3, "Paris SG", "PSG")], "id long, name string, short_name string")
    assert {(r.id, r.club_id) for r in mentions.match_clubs(signals, clubs).collect()} == {(1, 1), (1, 2), (2, 3), (2, 1)}
    assert {(r.id, r.club_id) for r in mentions.best_club(signals, clubs).collect()} == {(1, 1), (2, 3)}


def test_misspelt_clubs_equal_the_naive_comparison(spark):
    clubs = [(1, "Manchester City", "Man C"), (2, "Borussia Dortmund", None), (3, "Real Betis", "Betis"), (4, "Tottenham", None), (5, "Ajax", None)]
    texts = ["Mancester City", "Borusia Dortmund", "Real Betys", "spurs", "Totenham", "Ajx", "City", "Borussia", "Mancester City wants a striker", "Real Betis or Mancester City", "", None, "Dortmund Borussia", "man utd", "Betiss"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    c = spark.createDataFrame(clubs, "id long, name string, short_name string")
    labels = [(i, x) for i, n, s in clubs for x in (n, s) if x]
    pairs = [(k, i, x, y) for k, x in enumerate(texts) if x for i, y in labels]
    scored = spark.createDataFrame(pairs, "k long, i long, x string, y string").select("k", "i", text.name_similarity(text.resolve_alias(F.col("x")), F.col("y")).alias("s"))
    want = {}
    for r in scored.collect():
        if r.s >= 0.8:
            want[r.k, r.i] = max(r.s, want.get((r.k, r.i), 0))
    got = {(r.id, r.club_id): r.score for r in mentions.match_clubs(t, c).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert (0, 1) in got and (3, 4) in got and (8, 1) not in got
    best = {r.id: r.club_id for r in mentions.best_club(t, c).collect()}
    assert best[9] == 3 and best[0] == 1


def test_moves_to_a_misspelt_club(spark):
    from tidewire.operators import extraction

    signals = spark.createDataFrame([(1, "Jose Alvarez leaves Arsenal transfer Chelsea talk joins Mancester City", ""), (2, "Jose Alvarez joins Chelsea deal from Arsenal", "")], "id long, headline string, summary string")
    players = spark.createDataFrame([(7, "Jose Alvarez")], "id long, name string")
    clubs = spark.createDataFrame([(1, "Manchester City"), (2, "Arsenal"), (3, "Chelsea")], "id long, name string")
    got = {(r.id, r.from_club, r.to_club) for r in extraction.extract_known(signals.select("id", F.col("headline").alias("text")), players, clubs, inexact=True).select("id", F.col("from_club.name").alias("from_club"), F.col("to_club.name").alias("to_club")).collect()}
    assert got == {(1, "Arsenal", "Manchester City"), (2, "Arsenal", "Chelsea")}


def test_contained_parts_equal_naive_join(spark):
    random.seed(6)
    word = lambda n: "".join(random.choices("abc", k=n))
    texts = [(i, word(random.randint(0, 40))) for i in range(60)] + [(60, None)]
    parts = [(i % 25, word(random.randint(1, 6))) for i in range(60)]
    got = mentions.contained_parts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(parts, "owner long, part string"))
    assert {tuple(r) for r in got.collect()} == {(i, o) for i, t in texts for o, p in parts if t and len(p) >= 4 and p in t}


def test_outcome_fallback(spark):
    signals = spark.createDataFrame([(1, "Deal confirmed: Martinez to Betis"), (2, "Martinez to Betis fell through"), (3, "Martinez trains in Betis")], "id long, text string")
    players = spark.createDataFrame([(7, "Lautaro Martinez"), (8, "Bo Li")], "id long, name string")
    clubs = spark.createDataFrame([(1, "Betis"), (2, "Ajax")], "id long, name string")
    rumours = spark.createDataFrame([(10, 7, 1, "HOT", T0), (11, 7, 2, "HOT", T0), (12, 7, 1, "FAILED", T0), (13, 7, 1, "PENDING", datetime(2024, 1, 1))], "id long, player_id long, to_club_id long, status string, rumour_date timestamp")
    got = mentions.outcome_fallback(signals, players, clubs, rumours, F.lit(datetime(2025, 1, 10))).collect()
    assert [tuple(r) for r in got] == [(10, 1, "COMPLETED")]


def test_catalogue(spark):
    clubs = spark.createDataFrame([(1, "a", "A", "L1", "Unknown"), (2, "a", "A2", "Cup", "Spain"), (3, "a", "A3", "L1", "Italy"), (4, "b", "B", "L2", "Unknown")], "seq long, external_id string, name string, league string, country string")
    assert {tuple(r) for r in mentions.merge_clubs(clubs).collect()} == {("a", "A", "L1, Cup", "Spain"), ("b", "B", "L2", "Unknown")}
    old = spark.createDataFrame([(1, "x1", "One", T0), (2, None, "St. Two", T0), (3, None, "Three", None), (4, None, "Three", None)], "id long, external_id string, name string, contract_end timestamp")
    new = spark.createDataFrame([("x1", "Uno", None), ("x2", "st two", None), ("x3", "Three", None), (None, "New", T0)], "external_id string, name string, contract_end timestamp")
    got = {tuple(r) for r in mentions.reconcile_catalog(old, new, text.normalise_club_name).drop("ambiguous").collect()}
    assert got == {("update", 1, "x1", "Uno", T0), ("adopt", 2, "x2", "St. Two", T0), ("create", None, "x3", "Three", None), ("create", None, None, "New", T0)}


def test_parts_that_resemble_one_another_meet_only_as_a_whole(spark):
    rng = random.Random(6)
    parts = [(i, f"customer#{i % 90:06d}") for i in range(120)] + [(200, "cust"), (201, "custo"), (202, "#00000"), (203, "abc"), (204, "ñandú"), (205, None)]
    texts = [(i, f"{'Ab' * rng.randrange(3)}Customer#{rng.randrange(100):06d}{rng.choice(['', '7', ' to', 'CUSTO'])}") for i in range(60)] + [(90, "los ÑANDÚs"), (91, "cus"), (92, None), (93, "")]
    got = {(r.id, r.owner) for r in mentions.contained_parts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(parts, "owner long, part string")).collect()}
    assert got == {(i, o) for i, t in texts for o, p in parts if t and p and len(p) >= 4 and p in t.lower()} and len(got) > 100


def test_words_keep_their_meaning_with_and_without_accents(spark):
    texts = ["Müller\tto FC Köln\n", "plain text,\r\nwith  marks!", "Łódź – Nómada", "", None, "A B"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    source, target = text._accents()
    slow = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.translate(F.regexp_replace("text", r"\s", " "), source, target), "[̀-ͯ]", "")), "[^a-z0-9 ]", ""))
    for r in rows.select(mentions._words(F.col("text")).alias("w"), F.array_remove(F.split(slow, " "), "").alias("x")).collect():
        assert r.w == r.x
