"""Readers and writers on small landed files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import evidence, mentions, outcomes
from tidewire.sources import catalogue, io

def now():
    return F.lit(datetime(2026, 8, 1))


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data))


def test_catalogue_of_many_files(spark, tmp_path):
    team = lambda i, name, country, code=None: {"id": i, "name": name, "short_code": code, "image_path": None, "country_id": country, "extra": 1}
    leagues, squads = tmp_path / "leagues", tmp_path / "squads"
    put(leagues, "1328.json", {"data": {"currentseason": {"teams": [team(591, "Paris", None, "PSG")]}}})
    put(leagues, "2.json", {"data": {"currentseason": {"teams": [team(591, "Paris SG", 17, "P"), team(9, "City", 99)]}}})
    put(leagues, "5.json", {"data": {"currentseason": None}})
    put(leagues, "777.json", {"data": {"currentseason": {"teams": [team(1, "Elsewhere", 17)]}}})
    put(leagues, "2286.json", '{"data": {"currentseason": {"teams": [')
    member = lambda i, name, **more: {"player_id": i, "position_id": 24, "detailed_position_id": None, "player": {"id": i, "display_name": name, "date_of_birth": "1998-12-20", "image_path": "p", "nationality": {"name": "France"}}} | more
    put(squads, "591.json", {"data": [member(1, "Keeper", end="2028-06-30"), member(2, "Back", detailed_position_id=155), member(3, "Odd", detailed_position_id=5, end=None)]})
    put(squads, "9.json", {"data": [member(4, "No birth") | {"player": {"id": 4, "display_name": "No birth", "date_of_birth": None, "image_path": None, "nationality": None}}]})
    put(squads, "1.json", {"data": [member(5, "Elsewhere")]})
    put(squads, "8.json", "not json")
    countries = spark.createDataFrame([(17, "France")], "id long, name string")
    clubs, players, broken = catalogue.read_catalog(spark, str(leagues), str(squads), countries, now())
    got = {r.external_id: r for r in clubs.collect()}
    assert set(got) == {"sm-club-591", "sm-club-9"}
    # the Champions League comes first in the list of leagues, whatever the order of files
    assert (got["sm-club-591"].name, got["sm-club-591"].short_name, got["sm-club-591"].league, got["sm-club-591"].country) == ("Paris SG", "P", "Champions League, UEFA Super Cup", "France")
    assert (got["sm-club-9"].league, got["sm-club-9"].country) == ("Champions League", "Unknown")
    p = {r.name: r for r in players.collect()}
    assert set(p) == {"Keeper", "Back", "Odd", "No birth"}
    assert (p["Keeper"].position, p["Keeper"].age, p["Keeper"].contract_end, p["Keeper"].nationality) == ("GK", 28, datetime(2028, 6, 30), "France")
    assert (p["Back"].position, p["Back"].contract_end, p["Odd"].position, p["No birth"].age, p["No birth"].nationality) == ("LB", None, None, None, None)
    assert {(r.kind, r.key) for r in broken.collect()} == {("league", "2286"), ("squad", "8")}


def test_feeds_by_folder(spark, tmp_path):
    rss = lambda *titles: "<rss><channel>" + "".join(f"<item><title>{t}</title><link>http://x/{i}</link><pubDate>Tue, 05 Aug 2025 10:00:00 GMT</pubDate><description>d</description></item>" for i, t in enumerate(titles)) + "</channel></rss>"
    registry = catalogue.feed_registry(spark)
    names = {r.key: r for r in registry.collect()}
    assert len(names) == 12 and names["l-equipe-mercato"]["default"] == 0.75 and names["reddit-soccer"]["default"] == 0.4
    put(tmp_path / "bbc-sport", "1.xml", rss("Club sign player", "Garden show"))
    put(tmp_path / "reddit-transfers", "a.xml", rss("[Tier 1] striker bid agreed"))
    put(tmp_path / "reddit-transfers", "b.xml", rss("striker loan talk"))
    put(tmp_path / "strange", "1.xml", rss("transfer of unknown feed"))
    got = {r.headline: r for r in catalogue.read_feeds(spark, str(tmp_path), now()).collect()}
    assert {h: (r.source_name, r.reliability) for h, r in got.items()} == {"Club sign player": ("BBC Sport", 0.8), "[Tier 1] striker bid agreed": ("Reddit Transfers", 1.0), "striker loan talk": ("Reddit Transfers", 0.45)}
    assert got["Club sign player"].published_at == datetime(2025, 8, 5, 10)


def test_declared_tables(spark, tmp_path):
    spark.createDataFrame([(1, "One", "x")], "id long, name string, other string").write.parquet(f"{tmp_path}/clubs.parquet")
    got = catalogue.read_stored(spark, str(tmp_path), "clubs")
    assert got.schema == spark.createDataFrame([], catalogue.TABLES["clubs"]).schema and got.first()["short_name"] is None
    with pytest.raises(ValueError, match="no table"):
        catalogue.read_stored(spark, str(tmp_path), "clubz")
    for name, columns in catalogue.TABLES.items():
        assert spark.createDataFrame([], columns).columns, name


def test_jdbc_reads_in_ranges(spark):
    o = catalogue.jdbc_options("jdbc:postgresql://db/x", "users", 1, 1000, 8, user="u")
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"], o["user"]) == ("id", "1", "1000", "8", "u")
    with pytest.raises(ValueError, match="parts"):
        catalogue.jdbc_options("jdbc:x", "users", 5, 1, 8)
    url = "jdbc:derby:memory:tables;create=true"
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") % 3 == 0, "PRO").otherwise("FREE").alias("tier"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="users", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = catalogue.read_jdbc(spark, url, "users", 10, 90, 4, driver="org.apache.derby.jdbc.EmbeddedDriver", pushDownPredicate="true")
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_provider_rows_in_one_shape(spark, tmp_path):
    put(tmp_path / "sm", "1.json", {"data": [{"id": 589042, "player_id": 7, "from_team_id": 1, "to_team_id": 2, "date": "2025-07-01", "completed": True, "amount": None, "more": 1}, {"id": 2, "player_id": 8, "from_team_id": 1, "to_team_id": 3, "date": None, "completed": False, "amount": 10.0}]})
    move = lambda kind, date: {"date": date, "type": kind, "teams": {"in": {"id": 5, "name": "In"}, "out": {"id": 4, "name": "Out"}}}
    put(tmp_path / "apf", "1.json", {"response": [{"player": {"id": 9, "name": "N"}, "update": "u", "transfers": [move("Free", "2024-01-10"), move("N/A", "2023-07-02")]}]})
    both = io.union_providers(io.read_provider_transfers(spark, str(tmp_path / "sm"), now()), io.read_apifootball_transfers(spark, str(tmp_path / "apf"), now()))
    got = {r.external_id: r for r in both.collect()}
    assert set(got) == {"sm-589042", "sm-2", "apf-9-4-5-2024-01-10", "apf-9-4-5-2023-07-02"}
    assert {k: r.base_probability for k, r in got.items()} == {"sm-589042": 1.0, "sm-2": 0.5, "apf-9-4-5-2024-01-10": 0.9, "apf-9-4-5-2023-07-02": 0.6}
    assert (got["sm-2"].fee_min, round(got["sm-2"].fee_max, 6), got["sm-2"].rumour_date, got["sm-589042"].fee_min) == (9.0, 11.0, datetime(2026, 8, 1), None)
    assert got["apf-9-4-5-2024-01-10"].window == "WINTER" and got["sm-589042"].window == "SUMMER"


def test_watchlist_csv_is_safe(spark, tmp_path):
    rows = [('=HYPERLINK("x")', "+1", datetime(2025, 1, 1, 8)), ('An "odd" name', None, datetime(2025, 1, 2)), ("@x", "-y", datetime(2025, 1, 3))]
    io.export_watchlist_csv(spark.createDataFrame(rows, "player string, current_club string, added_at timestamp").coalesce(1), str(tmp_path / "out"))
    told = "".join(sorted(p.read_text() for p in (tmp_path / "out").glob("*.csv")))
    assert told.splitlines() == ['"player","current_club","added_at"', '"\'=HYPERLINK(""x"")","\'+1","2025-01-01T08:00:00.000Z"', '"An ""odd"" name","","2025-01-02T00:00:00.000Z"', '"\'@x","\'-y","2025-01-03T00:00:00.000Z"']


def test_history_is_appended_by_day(spark, tmp_path):
    for day, score in ((1, 10.0), (2, 20.0), (1, 30.0)):
        io.append_history(spark.createDataFrame([(7, score, datetime(2025, 1, day, 5))], "rumour_id long, likelihood double, recorded_at timestamp"), str(tmp_path / "h"), "recorded_at")
    got = spark.read.parquet(str(tmp_path / "h"))
    assert sorted((r.likelihood, str(r.dt)) for r in got.collect()) == [(10.0, "2025-01-01"), (20.0, "2025-01-02"), (30.0, "2025-01-01")]


def test_change_feed_by_full_comparison(spark):
    kind = "id long, likelihood double, status string"
    before = spark.createDataFrame([(1, 1.0, "PENDING"), (2, 2.0, "PENDING"), (3, None, "HOT")], kind)
    after = spark.createDataFrame([(1, 1.0, "PENDING"), (2, 2.0, "HOT"), (4, 9.0, "PENDING")], kind)
    assert {(r.event, json.loads(r.data)["id"]) for r in io.change_feed(before, after).collect()} == {("rumour:updated", 2), ("rumour:removed", 3), ("rumour:new", 4)}


def test_positions_of_the_provider(spark):
    ids = spark.createDataFrame([(i,) for i in (24, 148, 158, 163, 5, None)], "p long")
    assert [r.x for r in ids.select(text.map_position(F.col("p")).alias("x")).collect()] == ["GK", "CB", "RM", "CF", None, None]


def test_sources_are_made_once(spark):
    signals = spark.createDataFrame([("a", None, 1, "x"), ("a", 0.8, 2, "y"), ("b", 0.6, 1, "z"), ("c", None, 1, "w"), ("old", 0.9, 1, "v")], "source_name string, implied_reliability double, published_at long, link string")
    old, defaults = spark.createDataFrame([("old",)], "name string"), spark.createDataFrame([("a", 0.7), ("b", 0.1)], "name string, default double")
    assert {r.name: (r.type, r.reliability) for r in outcomes.ensure_sources(signals, old, defaults).collect()} == {"a": ("AGGREGATOR", 0.7), "b": ("AGGREGATOR", 0.6), "c": ("AGGREGATOR", 0.5)}


def test_claims_are_found_null_safe(spark):
    seen = spark.createDataFrame([(1, None, 2, 5), (1, None, 2, 3), (1, 9, 2, 4), (2, 1, 1, 1)], "player_id long, from_club_id long, to_club_id long, seen_at long")
    claims = spark.createDataFrame([(10, 1, None, 2, "ACTIVE"), (11, 1, None, 2, "ACTIVE"), (12, 1, 9, 2, "DENIED")], "id long, player_id long, from_club_id long, to_club_id long, claim_status string")
    got = {(r.player_id, r.from_club_id): (r.claim_id, r.first_seen_at, r.last_evidence_at) for r in evidence.find_or_create_claims(seen, claims).collect()}
    assert got == {(1, None): (10, 3, 5), (1, 9): (None, 4, 4), (2, 1): (None, 1, 1)}


def test_reviews_move_one_item_and_stamp_both_kinds(spark):
    rows = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "id long, root_id long")
    decisions = spark.createDataFrame([(1, 2, True), (1, 3, False)], "item_id long, candidate_id long, merge boolean")
    assert {r.id: r.root_id for r in evidence.resolve_duplicates(rows, decisions).collect()} == {1: 1, 2: 1, 3: 2}
    pairs = spark.createDataFrame([(1, 2, None), (1, 3, None), (2, 3, None)], "item_id long, candidate_id long, reviewed_at timestamp")
    assert {(r.item_id, r.candidate_id): r.reviewed_at for r in evidence.review_duplicates(pairs, decisions, now()).collect()} == {(1, 2): datetime(2026, 8, 1), (1, 3): datetime(2026, 8, 1), (2, 3): None}


def test_clusters_list_their_copies(spark):
    day = lambda d: datetime(2025, 1, d)
    rows = [(10, 1, None, day(5)), (11, 1, 10, day(3)), (12, 1, 10, day(2)), (13, 1, 77, day(4)), (14, 1, 77, day(6)), (15, None, None, day(1))]
    got = {r.id: (r.root_id, r.syndicated, r.nth) for r in evidence.cluster_members(spark.createDataFrame(rows, "id long, claim_id long, root_id long, published_at timestamp")).collect()}
    assert got == {10: (10, False, 0), 12: (10, True, 1), 11: (10, True, 2), 13: (77, False, 0), 14: (77, True, 1), 15: (15, False, 0)}


def test_same_named_newcomers_are_marked(spark):
    old = spark.createDataFrame([(1, "x1", "FC One", None), (2, None, "Two", None)], "id long, external_id string, name string, contract_end timestamp")
    new = spark.createDataFrame([("x1", "Two", None), ("n1", "two", None), ("n2", "T-wo", None), ("n3", "TWO", None)], "external_id string, name string, contract_end timestamp")
    got = {r.external_id: (r.action, r.id, r.ambiguous) for r in mentions.reconcile_catalog(old, new, text.normalise_club_name).collect()}
    assert got == {"x1": ("update", 1, False), "n1": ("adopt", 2, True), "n2": ("create", None, False), "n3": ("adopt", 2, True)}


def test_parents_in_a_cycle_are_an_error(spark):
    for cycle in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1), (5, None)]):
        with pytest.raises(ValueError, match="cycle"):
            evidence.resolve_roots(spark.createDataFrame(cycle, "id long, parent_id long"))


def test_every_outcome_pattern(spark):
    told = {
        "COMPLETED": ["Here we go!", "transfer confirmed", "Deal confirmed", "signing confirmed", "passes medical", "officially signed", "completed his move", "joins on a 4-year deal", "announced as new", "clubs have confirmed the signing"],
        "FAILED": ["deal has collapsed", "transfer off", "not joining", "saga is over", "denies interest", "no deal", "fell through", "called off the move"],
        None: ["dealt", "a confirmed fan", "saga goes on", "medical staff", "called the move"],
    }
    assert [len(v) for v in told.values()] == [len(text.COMPLETED), len(text.FAILED), 5]
    df = spark.createDataFrame([(k, h) for k, v in told.items() for h in v], "want string, h string")
    assert [(r.h, r.want, r.got) for r in df.select("*", text.detect_outcome(F.col("h")).alias("got")).collect() if r.want != r.got] == []
