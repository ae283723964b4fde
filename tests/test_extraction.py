"""Extraction of moves: names, clauses, directions and whole headlines."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import extraction as ex
from tidewire.operators import mentions

# Catalogue of the cases.
CLUBS = [(1, "RC Strasbourg", "Strasbourg"), (2, "Ipswich Town", "Ipswich"), (3, "Arsenal", None), (4, "Newcastle United", "Newcastle"), (5, "FC Barcelona", "Barcelona"), (6, "Manchester City", "Man City"), (7, "Tottenham", "Spurs"), (8, "Monaco", None), (9, "Liverpool", None), (10, "Astana", "AST"), (11, "Real Madrid", None), (12, "Aston Villa", None)]
PLAYERS = [(1, "Abdoul Ouattara"), (2, "Bruno Guimarães"), (3, "Bruno"), (4, "Rodri"), (5, "Cristian Romero"), (6, "Folarin Balogun"), (7, "Morgan Rogers"), (8, "Youssef Chermiti"), (9, None)]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(PLAYERS, "id long, name string"), spark.createDataFrame(CLUBS, "id long, name string, short_name string")


def moves(spark, catalogue, *rows):
    signals = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r, r) for i, r in enumerate(rows)], "id long, headline string, summary string")
    return {(r.id, r.player_name, r.from_club, r.to_club, r.from_inferred, r.auto_created) for r in ex.extract_rumours(signals, *catalogue).collect()}


def test_candidate_names(spark):
    rows = [
        "Bruno Silva joins Arsenal", "Arsenal sign Bruno Guimarães from Newcastle", "Mikel Arteta told Arsenal winger", "Diego Simeone confirms Julian Alvarez transfer", "Here we go! Ruben Amorim agrees to become Milan boss",
        "Chelsea chase Man City's Dias", "Fulham sign Northern Ireland midfielder from Southampton", "Forest sign Sporting's Ivory Coast defender Diomande", "News: Ana Braga to Porto", "Leeds United to win", "Lee Young 2 joins", None, "",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, h string")
    got = {r.id: [(x.name, round(x.confidence, 2)) for x in r.c or []] for r in df.select("id", ex.candidate_names(F.col("h")).alias("c")).collect()}
    assert got == {0: [("Bruno Silva", 0.9)], 1: [("Bruno Guimarães", 0.88)], 8: [("Ana Braga", 0.84)]} | {i: [] for i in (2, 3, 4, 5, 6, 7, 9, 10, 11, 12)}


def test_club_candidates(spark):
    df = spark.createDataFrame([("Derby County beat Malmo FC and FC Porto, Derby County won; Real Oviedo at Sheffield Wednesday",), (None,)], "h string")
    got = [r.c for r in df.select(ex.club_candidates(F.col("h")).alias("c")).collect()]
    assert got == [["Malmo FC", "FC Porto", "Derby County", "Sheffield Wednesday", "Real Oviedo"], []]


def test_clauses(spark):
    rows = [
        ("Rashford bombshell, Rodri to Barcelona, Arsenal update", "Rodri", " Rodri to Barcelona"),
        ("Balogun to Spurs? Neto to City?", "Balogun", "Balogun to Spurs"),
        ("Could Romero join? He may", "Romero", "Could Romero join? He may"),
        ("a - Rodri leaves - b", "Rodri", "- Rodri leaves"),
        ("x" * 200 + "Rodri" + "y" * 200, "Rodri", "x" * 150 + "Rodri" + "y" * 150),
        ("no mention", "Rodri", "no mention"),
    ]
    df = spark.createDataFrame(rows, "t string, n string, want string")
    got = df.select(ex.clause_around(F.col("t"), F.position("n", "t") - 1, F.length("n")).alias("c"), "want").collect()
    assert [r.c for r in got] == [r.want for r in got]


def test_directions(spark, catalogue):
    got = moves(
        spark, catalogue,
        ("Abdoul Ouattara deal: quitte Strasbourg pour Ipswich", ""), ("Abdoul Ouattara transfer: leaves Strasbourg for Ipswich", ""), ("Strasbourg man Abdoul Ouattara joins Ipswich Town", ""),
        ("Strasbourg and Ipswich both interested in Abdoul Ouattara", ""), ("Reports from Strasbourg: Abdoul Ouattara deal with Ipswich", ""), ("Abdoul Ouattara linked: to leave Strasbourg for Ipswich", ""),
        ("Abdoul Ouattara deal Strasbourg, Ipswich, Arsenal", None), (None, None),
    )
    name, a, b = "Abdoul Ouattara", "RC Strasbourg", "Ipswich Town"
    assert got == {(0, name, a, b, False, False), (1, name, a, b, False, False), (2, name, a, b, True, False), (5, name, a, b, False, False)}


def test_replayed_headlines(spark, catalogue):
    got = moves(
        spark, catalogue,
        ("Arsenal sign Bruno Guimarães from Newcastle", "Bruno Guimarães has joined Arsenal from Newcastle United, the club has confirmed."),
        ("Rodri to Barcelona transfer twist after Man City respond to £38m offer - Standard", "Rodri to Barcelona transfer twist after Man City respond to £38m offer  Standard"),
        "News: Huge Vinicius Jr to Arsenal update, Man Utd £60m talks, Bruno Guimaraes bid - mirror.co.uk",
        "Transfer News: Rashford bombshell, Rodri to Barcelona, Arsenal update - footballtransfers.com",
        "Football transfer rumours: Folarin Balogun to Spurs? Pedro Neto to Manchester City? - theguardian.com",
        "Aston Villa linked with bargain Real Madrid transfer to replace Morgan Rogers - Daily Mirror",
        "Arsenal backed to hijack £100m Liverpool transfer after Bruno Guimaraes signing - Metro.co.uk",
    )
    assert {m[:4] for m in got} == {(0, "Bruno Guimarães", "Newcastle United", "Arsenal"), (1, "Rodri", "Manchester City", "FC Barcelona")}


def test_new_names_and_clubs(spark, catalogue):
    rows = ["Joao Pedrinho joins Arsenal from Derby County", "Bruno Guimaraez joins Arsenal from Monaco", "Ana Braga joins Arsenal", "Ana Braga signs for Monaco from Liverpool"]
    signals = spark.createDataFrame(list(enumerate(rows)), "id long, headline string").withColumn("summary", F.lit(None).cast("string"))
    got = {tuple(r) for r in ex.extract_rumours(signals, *catalogue).where("auto_created").drop("confidence", "auto_created").collect()}
    assert got == {(0, None, "Joao Pedrinho", None, "Derby County", 3, "Arsenal", False), (3, None, "Ana Braga", 9, "Liverpool", 8, "Monaco", False)}


def test_empty_tables(spark, catalogue):
    players, clubs = catalogue
    signals = spark.createDataFrame([(1, "Rodri joins Arsenal from Monaco", "")], "id long, headline string, summary string")
    for args in ((signals.limit(0), players, clubs), (signals, players, clubs.limit(0))):
        assert ex.extract_rumours(*args).count() == 0


def test_similar_names_equal_all_pairs(spark):
    random.seed(4)
    names = ["".join(random.choices("abc ", k=random.randint(5, 12))).strip() or "aaaaa" for _ in range(70)]
    labels = names[:20] + ["".join(random.choices("abc ", k=random.randint(2, 12))) for _ in range(70)]
    a, b = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(x,) for x in labels], "label string")
    for least in (0.65, 0.7):
        squeezed = lambda c: F.regexp_replace(c, " +", " ")
        want = a.distinct().crossJoin(b.distinct()).where(F.trim("label") != "").where(text.name_similarity(squeezed("name"), squeezed("label")) >= least)
        assert {(r.name, r.known) for r in mentions.similar_names(a, b, least).collect()} == {(r.name, r.label) for r in want.collect()}
