"""Registry of the library's queries over the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import rules, text
from tidewire.operators import evidence as ev
from tidewire.operators import enrichment, explain, extraction, forecast, mentions, models, outcomes, reports, serving, watchlists
from tidewire.plans.domain import CLUBS, NOW, ctes, view
from tidewire.sources import catalogue, io

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _scored(spark, d):
    wide = serving.with_dimensions(view(spark, d, "rumours"), view(spark, d, "players"), view(spark, d, "clubs"), view(spark, d, "sources"))
    months = rules.months_to(F.col("player_contract_end"), F.expr(NOW))
    return wide.withColumn("score", rules.likelihood_score(F.coalesce("source_reliability", F.lit(0.5)), months, F.col("fee_min"), F.col("fee_max"), F.col("player_market_value"), F.col("source_count"), F.col("base_probability")))


_SCORE = f"""{ctes("rumours", "players", "sources", "clubs")}, parts AS (
  SELECT r.*, p.current_club_id, p.position, p.market_value, coalesce(s.reliability, 0.5) AS rel, (epoch_ms(p.contract_end) - epoch_ms({NOW})) / (30.44 * 86400000) AS months,
    coalesce((fee_min + fee_max) / 2, fee_min, fee_max) AS fee
  FROM rumours r JOIN players p ON r.player_id = p.id LEFT JOIN sources s ON r.source_id = s.id),
scored AS (SELECT *, floor(greatest(0, least(100,
    greatest(0, least(1, rel)) * 28 + CASE WHEN months IS NULL THEN 8 ELSE (1 - greatest(0, least(1, months / 24))) * 20 END
    + CASE WHEN fee IS NOT NULL AND market_value <> 0 THEN greatest(0, 1 - abs(fee / market_value - 1) * 1.5) * 12 ELSE 3.6 END
    + 12.0 + least(1, 1 - exp(-source_count * 0.5)) * 15 + CASE WHEN base_probability = 0 THEN 2.5 ELSE base_probability * 5 END)) + 0.5) AS score FROM parts)"""


@query(f"""{_SCORE}, live AS (SELECT *, score AS l FROM scored WHERE status IN ('PENDING', 'HOT')),
 a AS (SELECT current_club_id AS c, count(*) AS squad FROM players GROUP BY 1),
 b AS (SELECT to_club_id AS c, count(*) AS n_in, sum(coalesce(CASE WHEN fee_max IS NULL THEN 0 ELSE coalesce(fee_min, fee_max) / 2 END, 0) * l / 100) AS spend FROM live GROUP BY 1),
 o AS (SELECT from_club_id AS c, count(*) AS n_out FROM live GROUP BY 1)
 SELECT id, name, coalesce(squad, 0) AS squad, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, floor(coalesce(spend, 0) + 0.5) AS expected_spend
 FROM clubs LEFT JOIN a ON id = a.c LEFT JOIN b ON id = b.c LEFT JOIN o ON id = o.c""")
def club_dashboard(spark, d):
    fresh = _scored(spark, d).select("id", "player_id", "from_club_id", "to_club_id", "fee_min", "fee_max", "status", F.col("score").alias("likelihood"))
    return serving.club_dashboard(view(spark, d, "clubs"), view(spark, d, "players"), fresh)


@query(f"{_SCORE} SELECT id, score, CASE WHEN score >= 70 THEN 'HOT' ELSE 'PENDING' END AS new_status FROM scored WHERE status IN ('PENDING', 'HOT')")
def rescore(spark, d):
    return serving.active_rumours(_scored(spark, d)).select("id", "score", rules.score_status(F.col("score")).alias("new_status"))


@query(f"{ctes('rumours')} SELECT count(*) AS total, count(*) FILTER (status = 'HOT') AS hot, count(*) FILTER (status = 'COMPLETED') AS completed FROM rumours")
def overview(spark, d):
    return serving.overview_counts(view(spark, d, "rumours"))


@query(f"{ctes('sources', 'rumours')} SELECT s.id, s.name, round(s.reliability, 6) AS reliability, count(r.id) AS rumours, hit_count AS hits, miss_count AS misses FROM sources s LEFT JOIN rumours r ON r.source_id = s.id GROUP BY ALL")
def source_stats(spark, d):
    return serving.source_stats(view(spark, d, "sources"), view(spark, d, "rumours")).withColumn("reliability", F.round("reliability", 6))


@query(f"{ctes('rumours', 'players')} SELECT to_club_id, position, floor(sum(coalesce(fee_max, fee_min, 0) * likelihood / 100) + 0.5) AS spend FROM rumours r JOIN players p ON r.player_id = p.id WHERE status IN ('PENDING', 'HOT') GROUP BY 1, 2")
def spend_by_position(spark, d):
    return serving.spend_by_position(view(spark, d, "rumours"), view(spark, d, "players"))


@query(f"{ctes('rumours')} SELECT id, likelihood, status, (SELECT count(*) FROM rumours) AS total FROM rumours ORDER BY likelihood DESC, id OFFSET 20 LIMIT 20")
def rumour_page(spark, d):
    return serving.rumour_page(view(spark, d, "rumours"), 2, 20).select("id", "likelihood", "status", "total")


@query(f"{ctes('rumours')} SELECT to_club_id, id, likelihood, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY to_club_id ORDER BY likelihood DESC, id) AS rank FROM rumours) WHERE rank <= 5")
def top_rumours_per_club(spark, d):
    return serving.top_per_key(view(spark, d, "rumours"), "to_club_id", 5, F.desc("likelihood"), F.col("id")).select("to_club_id", "id", "likelihood", "rank")


@query(f"{ctes('rumours', 'clubs')} SELECT r.id, r.status FROM rumours r WHERE window_name = 'SUMMER' AND (from_club_id IN (SELECT id FROM clubs WHERE lower(league) LIKE '%nation_1%') OR to_club_id IN (SELECT id FROM clubs WHERE lower(league) LIKE '%nation_1%'))".replace("nation_1%", "nation\\_1%").replace("%'", "%' ESCAPE '\\'"))
def filtered_rumours(spark, d):
    return serving.filter_rumours(view(spark, d, "rumours"), view(spark, d, "clubs"), league="NATION_1", club_id=3, window="SUMMER").select("id", "status")


@query(f"{ctes('players')} SELECT id, name FROM players WHERE contains(lower(name), '00012') ORDER BY name, id LIMIT 20")
def player_search(spark, d):
    return serving.search_names(view(spark, d, "players"), "00012").select("id", "name")


@query(f"{ctes('rumours', 'players')} SELECT r.id, CASE WHEN from_club_inferred AND current_club_id IS NOT NULL AND current_club_id <> from_club_id THEN current_club_id ELSE from_club_id END AS origin_club_id, coalesce(from_club_inferred AND current_club_id IS NOT NULL AND current_club_id <> from_club_id, false) AS unconfirmed FROM rumours r JOIN players p ON p.id = r.player_id")
def display_origin(spark, d):
    p = view(spark, d, "players").select(F.col("id").alias("_p"), F.col("current_club_id").alias("player_current_club_id"))
    return serving.display_origin(view(spark, d, "rumours").join(p, F.col("player_id") == F.col("_p")))


@query(f"{ctes('claims')} SELECT id, player_id, claim_status FROM claims WHERE claim_status IN ('CONFIRMED', 'DENIED', 'EXPIRED') ORDER BY first_seen_at DESC, id LIMIT 500")
def historical_claims(spark, d):
    return serving.historical_claims(view(spark, d, "claims")).select("id", "player_id", "claim_status")


_TOP = ", top AS (SELECT * FROM rumours WHERE status IN ('PENDING', 'HOT', 'COMPLETED') ORDER BY likelihood DESC, id LIMIT 200)"
_EDGES = ", edges AS (SELECT id AS rumour_id, 'edge-' || id AS edge, 'club-' || from_club_id AS source, 'player-' || player_id AS target, 'rumour-from' AS way, likelihood, status, player_id AS labelled FROM top UNION ALL SELECT id, 'edge-' || id || '-to', 'player-' || player_id, 'club-' || to_club_id, 'rumour-to', likelihood, status, NULL FROM top)"


@query(f"{ctes('rumours', 'players')}{_TOP}{_EDGES} SELECT rumour_id, edge, source, target, way, name || ' (' || CAST(floor(likelihood + 0.5) AS BIGINT) || '%)' AS label, round(likelihood / 100, 6) AS weight, greatest(1.0, likelihood / 25) AS size, status, CASE status WHEN 'HOT' THEN '#f97316' WHEN 'PENDING' THEN '#94a3b8' ELSE '#22c55e' END AS colour FROM edges LEFT JOIN players p ON p.id = labelled")
def network_edges(spark, d):
    return serving.transfer_network(view(spark, d, "rumours"), view(spark, d, "players"))[1].withColumn("weight", F.round("weight", 6))


@query(f"{ctes('rumours', 'players', 'clubs')}{_TOP} SELECT DISTINCT 'player-' || player_id AS id, 'player' AS kind, p.name AS label, round(greatest(6.0, least(18.0, coalesce(market_value, 20.0) / 8)), 6) AS size, '#60a5fa' AS colour FROM top LEFT JOIN players p ON p.id = player_id UNION SELECT 'club-' || c, 'club', k.name, 14.0, '#8b5cf6' FROM (SELECT from_club_id AS c FROM top UNION SELECT to_club_id FROM top) LEFT JOIN clubs k ON k.id = c")
def network_nodes(spark, d):
    return serving.transfer_network(view(spark, d, "rumours"), view(spark, d, "players"), view(spark, d, "clubs"))[0].withColumn("size", F.round("size", 6))


@query(f"{ctes('rumours')}{_TOP} SELECT (SELECT count(DISTINCT player_id) FROM top) + (SELECT count(*) FROM (SELECT from_club_id FROM top UNION SELECT to_club_id FROM top)) AS node_count, (SELECT 2 * count(*) FROM top) AS edge_count")
def network_counts(spark, d):
    return serving.network_counts(*serving.transfer_network(view(spark, d, "rumours"), view(spark, d, "players")))


@query(f"{ctes('rumours')}{_TOP}{_EDGES} SELECT node, count(DISTINCT other) AS n FROM (SELECT source AS node, target AS other FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY node")
def network_neighbours(spark, d):
    return serving.neighbours(serving.transfer_network(view(spark, d, "rumours"), view(spark, d, "players"))[1]).select("node", "n")


@query(f"{ctes('rumours')}, h AS (SELECT player_id AS rumour_id, rumour_date AS recorded_at, likelihood, id FROM rumours), w AS (SELECT *, lag(likelihood) OVER o AS previous, lead(likelihood) OVER o AS nxt FROM h WINDOW o AS (PARTITION BY rumour_id ORDER BY recorded_at, likelihood)) SELECT rumour_id, recorded_at, likelihood, previous, likelihood - previous AS change, likelihood >= 70 AS hot FROM w WHERE previous IS NOT NULL OR nxt IS NOT NULL")
def likelihood_timeline(spark, d):
    return serving.likelihood_timeline(view(spark, d, "rumours").select(F.col("player_id").alias("rumour_id"), F.col("rumour_date").alias("recorded_at"), "likelihood"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def usage_metrics(spark, d):
    return serving.usage_metrics(io.read_table(spark, d, "events"))


@query("SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') AS kept FROM events")
def purge(spark, d):
    return serving.purge_older_than(io.read_table(spark, d, "events"), F.expr("TIMESTAMP '2024-04-15 00:00:00'"), 90, "ts")[1].select("deleted", "kept")


@query(f"""{ctes('signals')} SELECT id, regexp_matches(lower(headline), 'transfer|sign|bid|offer|deal|move|loan|fee|rumou?r|target|linked|interest|approach|negotiate|contract|here we go|medical|agreed|swap|sell|buy|complete|mercato') AS related,
 CASE WHEN lower(headline) LIKE '%january%' OR lower(headline) LIKE '%winter%' THEN 'WINTER' WHEN regexp_matches(lower(headline), 'summer|july|august|june') THEN 'SUMMER' WHEN month(published_at) BETWEEN 6 AND 8 THEN 'SUMMER' ELSE 'WINTER' END AS win,
 CASE WHEN lower(headline) LIKE '%tier 2%' THEN 0.8 END AS implied, CASE WHEN headline LIKE '%here we go%' THEN 'COMPLETED' WHEN headline LIKE '%deal collapsed%' OR headline LIKE '%transfer off%' THEN 'FAILED' END AS outcome,
 CASE WHEN headline LIKE '%according to%' THEN 'Sky Sports' END AS cited FROM signals""")
def signal_rules(spark, d):
    h = F.col("headline")
    return view(spark, d, "signals").select("id", text.is_transfer_related(h, F.lit("")).alias("related"), text.guess_window_from_text(h, F.col("published_at")).alias("win"), text.implied_reliability(h).alias("implied"), text.detect_outcome(h).alias("outcome"), text.cited_name(h).alias("cited"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', '', 'g'), ' ') AS norm FROM documents")
def normalised_text(spark, d):
    return io.read_table(spark, d, "documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))


@query(f"{ctes('evidence')} SELECT claim_id, count(DISTINCT coalesce(root_id, id)) AS independent, count(*) AS evidence FROM evidence GROUP BY 1")
def independent_sources(spark, d):
    return ev.independent_source_count(view(spark, d, "evidence"))


@query(f"{ctes('evidence')} SELECT claim_id, count(*) AS evidence, count(DISTINCT coalesce(root_id, id)) AS independent, arg_max(id, (published_at, id)) FILTER (source_type = 'CLUB_OFFICIAL' AND direction = 'CONFIRMS') AS confirmation_id, arg_max(id, (published_at, id)) FILTER (source_type = 'CLUB_OFFICIAL' AND direction = 'DENIES') AS denial_id FROM evidence GROUP BY 1")
def claim_provenance(spark, d):
    return ev.claim_provenance(view(spark, d, "evidence"))


@query(f"{ctes('claims', 'evidence')} SELECT c.id, greatest(c.last_evidence_at, max(e.published_at)) AS last_evidence_at FROM claims c LEFT JOIN evidence e ON e.claim_id = c.id GROUP BY c.id, c.last_evidence_at")
def last_evidence(spark, d):
    return ev.last_evidence_at(view(spark, d, "claims"), view(spark, d, "evidence"))


@query(f"{ctes('claims', 'evidence', 'sources')} SELECT id FROM claims WHERE id IN (SELECT claim_id FROM evidence WHERE source_id IN (SELECT id FROM sources WHERE tier <= 1))")
def claims_by_tier(spark, d):
    return ev.claims_with_source_tier(view(spark, d, "claims"), view(spark, d, "evidence"), view(spark, d, "sources"), 1).select("id")


@query(f"{ctes('evidence')}, m AS (SELECT *, source_type <> 'CLUB_OFFICIAL' AND direction NOT IN ('DENIES', 'CONTEXTUAL') AND root_id IS NULL AS br FROM evidence), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, br ORDER BY published_at, id) = 1 AS f FROM m) SELECT id, claim_id, concat_ws(',', CASE WHEN source_type = 'CLUB_OFFICIAL' THEN 'official' END, CASE WHEN direction = 'DENIES' THEN 'denial' END, CASE WHEN direction = 'CONTEXTUAL' THEN 'contextual' END, CASE WHEN root_id IS NOT NULL THEN 'syndication' WHEN br THEN CASE WHEN f THEN 'original' ELSE 'corroboration' END END) AS categories FROM r")
def evidence_categories(spark, d):
    return ev.categorise_evidence(view(spark, d, "evidence"))


@query("WITH w AS (SELECT doc_id, source, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''))) AS t FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY source, t) AS f FROM w), r AS (SELECT * FROM k WHERE doc_id = f) SELECT a.doc_id AS item_id, b.doc_id AS candidate_id FROM r a JOIN r b ON a.source = b.source AND b.doc_id < a.doc_id WHERE CASE WHEN len(a.t) + len(b.t) = 0 THEN 1 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END >= 0.55 UNION ALL SELECT doc_id, f FROM k WHERE doc_id <> f")
def near_duplicate_pairs(spark, d):
    # a claim is a source
    rows = io.read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("claim_id"), F.col("doc_id").alias("seq"), "text")
    return ev.near_duplicate_pairs(rows).select("item_id", "candidate_id")


@query("WITH RECURSIVE p AS (SELECT DISTINCT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN doc_id - 1 - doc_id % 3 % (doc_id % 7) END AS par FROM documents), w AS (SELECT id, id AS root_id FROM p WHERE par IS NULL UNION ALL SELECT p.id, w.root_id FROM p JOIN w ON p.par = w.id) SELECT id, root_id FROM w")
def provenance_roots(spark, d):
    ids = io.read_table(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct()
    return ev.resolve_roots(ids.select("id", F.expr("CASE WHEN id % 7 <> 0 THEN id - 1 - id % 3 % (id % 7) END").alias("parent_id")))


_CUTOFF = "CASE window_name WHEN 'SUMMER' THEN CASE WHEN make_timestamp(year(first_seen_at), 8, 31, 23, 59, 59) >= first_seen_at THEN make_timestamp(year(first_seen_at), 8, 31, 23, 59, 59) ELSE make_timestamp(year(first_seen_at) + 1, 8, 31, 23, 59, 59) END WHEN 'WINTER' THEN CASE WHEN make_timestamp(year(first_seen_at), 1, 31, 23, 59, 59) >= first_seen_at THEN make_timestamp(year(first_seen_at), 1, 31, 23, 59, 59) ELSE make_timestamp(year(first_seen_at) + 1, 1, 31, 23, 59, 59) END END"


@query(f"""{ctes('predictions', 'evidence', 'sources', 'claims', 'players')}, m AS (SELECT p.claim_id, p.as_of, e.* EXCLUDE (claim_id), CASE WHEN e.id IS NULL THEN NULL WHEN s.tier IS NULL THEN 0.5 ELSE (6 - greatest(1.0, least(5.0, s.tier))) / 5 END AS score, direction IN ('SUPPORTS', 'CONFIRMS') AS pro, direction IN ('CONTRADICTS', 'DENIES') AS contra
  FROM predictions p LEFT JOIN evidence e ON e.claim_id = p.claim_id AND e.published_at <= p.as_of LEFT JOIN sources s ON s.id = e.source_id),
 l AS (SELECT claim_id, as_of, count(*) AS n, count(*) FILTER (side) AS siding FROM (SELECT claim_id, as_of, source_id, arg_max(pro, (published_at, id)) AS side FROM m WHERE id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
 g AS (SELECT claim_id, as_of, avg(score) AS tiers, count(id) AS n, count(DISTINCT coalesce(root_id, id)) AS roots, count(*) FILTER (pro) AS pro, count(*) FILTER (contra) AS contra, max(published_at) AS newest, avg(confidence) AS conf,
  coalesce(bool_or(source_type = 'CLUB_OFFICIAL' AND direction = 'CONFIRMS'), false) AS yes, coalesce(bool_or(source_type = 'CLUB_OFFICIAL' AND direction = 'DENIES'), false) AS no FROM m GROUP BY 1, 2),
 c AS (SELECT g.*, coalesce(l.n, 0) AS sources, coalesce(siding, 0) AS siding, c.*, (epoch_ms(contract_end) - epoch_ms(as_of)) / (30.44 * 86400000) AS months, (epoch_ms({_CUTOFF}) - epoch_ms(as_of)) / 86400000 AS days_left FROM g LEFT JOIN l USING (claim_id, as_of) JOIN claims c ON c.id = claim_id JOIN players p ON p.id = player_id WHERE first_seen_at <= as_of)
 SELECT claim_id, as_of, round(coalesce(tiers, 0.5), 6) AS sourceTierScore, round(coalesce(tiers, 0.5), 6) AS sourceTrackRecordScore, roots::DOUBLE AS independentRootCount, n::DOUBLE AS evidenceCount, round(CASE WHEN pro + contra = 0 THEN 0.5 ELSE pro / (pro + contra) END, 6) AS evidenceDirectionScore,
  round(coalesce(least(8760.0, (epoch_ms(as_of) - epoch_ms(newest)) / 3600000), 8760.0), 6) AS mostRecentEvidenceAgeHours, (n > 0)::INT::DOUBLE AS hasEvidence, yes::INT::DOUBLE AS hasOfficialConfirmation, no::INT::DOUBLE AS hasOfficialDenial,
  round(((stated_fee IS NOT NULL)::INT + (stated_months IS NOT NULL)::INT + (transfer_type <> 'UNKNOWN')::INT) / 3, 6) AS detailSpecificityScore, round(CASE WHEN sources = 0 THEN 0.5 ELSE greatest(siding, sources - siding) / sources END, 6) AS sourceAgreementScore,
  round(coalesce(months, -1), 6) AS monthsToContractExpiry, (months IS NOT NULL)::INT::DOUBLE AS hasContractInfo, round(coalesce(days_left, -1), 6) AS windowDaysRemaining, (days_left IS NOT NULL)::INT::DOUBLE AS hasWindowInfo, round(coalesce(conf, 0), 6) AS entityMatchConfidence,
  round(((stated_fee IS NOT NULL)::INT + (stated_months IS NOT NULL)::INT + (months IS NOT NULL)::INT + (days_left IS NOT NULL)::INT + (n > 0)::INT) / 5, 6) AS dataCompletenessScore FROM c""")
def asof_features(spark, d):
    f = forecast.evidence_features(view(spark, d, "predictions"), view(spark, d, "evidence"), view(spark, d, "sources"), view(spark, d, "claims"), view(spark, d, "players"))
    return f.select("claim_id", "as_of", *[F.round(c, 6).alias(c) for c in forecast.FEATURES])


@query(f"{ctes('predictions', 'evidence', 'claims')}, d AS (SELECT claim_id, as_of, coalesce(least(as_of + INTERVAL '30' DAY, {_CUTOFF}), as_of + INTERVAL '30' DAY) AS deadline FROM predictions JOIN claims ON id = claim_id), m AS (SELECT d.claim_id, d.as_of, d.deadline, min(e.published_at) AS confirmed_at FROM d LEFT JOIN evidence e ON e.claim_id = d.claim_id AND e.published_at > d.as_of AND e.published_at <= d.deadline AND source_type = 'CLUB_OFFICIAL' AND direction = 'CONFIRMS' GROUP BY 1, 2, 3) SELECT *, CASE WHEN confirmed_at IS NOT NULL THEN 1 WHEN deadline <= {NOW} THEN 0 END AS label FROM m")
def cutoff_labels(spark, d):
    return forecast.resolve_labels(view(spark, d, "predictions"), view(spark, d, "evidence"), view(spark, d, "claims"), F.expr(NOW))


@query(f"{ctes('predictions', 'evidence')}, m AS (SELECT p.claim_id, p.as_of, p.as_of + INTERVAL '30' DAY AS deadline, min(e.published_at) AS confirmed_at FROM predictions p LEFT JOIN evidence e ON e.claim_id = p.claim_id AND e.published_at > p.as_of AND e.published_at <= p.as_of + INTERVAL '30' DAY AND source_type = 'CLUB_OFFICIAL' AND direction = 'CONFIRMS' GROUP BY 1, 2) SELECT *, CASE WHEN confirmed_at IS NOT NULL THEN 1 WHEN deadline <= {NOW} THEN 0 END AS label FROM m")
def forecast_labels(spark, d):
    return forecast.resolve_labels(view(spark, d, "predictions"), view(spark, d, "evidence"), view(spark, d, "claims"), F.expr(NOW), use_cutoff=False)


@query(f"{ctes('predictions')}, r AS (SELECT *, row_number() OVER (ORDER BY as_of, claim_id) - 1 AS k, count(*) OVER () AS n FROM predictions) SELECT claim_id, as_of, CASE WHEN k < floor(0.6 * n) THEN 'train' WHEN k < floor(0.6 * n) + floor(0.2 * n) THEN 'validation' ELSE 'test' END AS split FROM r")
def time_split(spark, d):
    return forecast.time_split(view(spark, d, "predictions"))


_PY = "SELECT o_orderkey, (o_orderkey * 31 % 1000) / 1000.0 AS p, CASE WHEN o_orderkey * 17 % 1000 < o_orderkey * 31 % 1000 THEN 1 ELSE 0 END AS y FROM orders"


def _py(spark, d):
    return io.read_table(spark, d, "orders").select(((F.col("o_orderkey") * 31 % 1000) / 1000.0).alias("p"), F.when(F.col("o_orderkey") * 17 % 1000 < F.col("o_orderkey") * 31 % 1000, 1).otherwise(0).alias("y"))


@query(f"WITH x AS ({_PY}) SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS empirical_rate, count(*) AS n FROM x GROUP BY 1")
def calibration_bins(spark, d):
    return forecast.calibration_bins(_py(spark, d)).select("bin", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("empirical_rate", 6).alias("empirical_rate"), "n")


@query(f"WITH x AS ({_PY}), q AS (SELECT p, y, greatest(1e-6, least(1 - 1e-6, p)) AS c FROM x) SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss FROM q")
def forecast_scores(spark, d):
    return forecast.scores(_py(spark, d)).select(F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query(f"WITH x AS ({_PY}), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY p), w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(CAST(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS DOUBLE), 6) AS auc FROM w")
def rank_auc(spark, d):
    return forecast.rank_auc(_py(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(f"{ctes('rumours')}, x AS (SELECT DISTINCT player_id, to_club_id % 5 AS to_club_id, rumour_date AS t FROM rumours), s AS (SELECT *, row_number() OVER (PARTITION BY player_id, to_club_id ORDER BY t) AS k FROM x), f AS (SELECT player_id, to_club_id, k, t, t AS anchor FROM s WHERE k = 1 UNION ALL SELECT s.player_id, s.to_club_id, s.k, s.t, CASE WHEN s.t > f.anchor + INTERVAL '90' DAY THEN s.t ELSE f.anchor END FROM f JOIN s ON s.player_id = f.player_id AND s.to_club_id = f.to_club_id AND s.k = f.k + 1) SELECT r.player_id, f.to_club_id, anchor, count(*) AS reports, count(DISTINCT source_id) AS sources FROM rumours r JOIN f ON r.player_id = f.player_id AND r.to_club_id % 5 = f.to_club_id AND r.rumour_date = f.t GROUP BY 1, 2, 3".replace("WITH rumours", "WITH RECURSIVE rumours", 1))
def rumour_anchors(spark, d):
    rows = view(spark, d, "rumours").select("id", "player_id", F.lit(None).cast("long").alias("from_club_id"), (F.col("to_club_id") % 5).alias("to_club_id"), "rumour_date", "source_id")
    return outcomes.corroboration_count(outcomes.assign_rumours(rows, 90)).drop("from_club_id")


@query(f"{ctes('usage')}, x AS (SELECT DISTINCT api_key_id, created_at AS t FROM usage), s AS (SELECT *, row_number() OVER (PARTITION BY api_key_id ORDER BY t) AS k FROM x), f AS (SELECT api_key_id, k, t, t AS w FROM s WHERE k = 1 UNION ALL SELECT s.api_key_id, s.k, s.t, CASE WHEN s.t >= f.w + INTERVAL '86400' SECOND THEN s.t ELSE f.w END FROM f JOIN s ON s.api_key_id = f.api_key_id AND s.k = f.k + 1), g AS (SELECT u.id, u.api_key_id, u.created_at, f.w AS window_start, CAST(row_number() OVER (PARTITION BY u.api_key_id, f.w ORDER BY u.created_at, u.id) AS INT) AS n FROM usage u JOIN f ON u.api_key_id = f.api_key_id AND u.created_at = f.t) SELECT *, n <= 5 AS allowed, greatest(0, 5 - n) AS remaining FROM g".replace("WITH usage", "WITH RECURSIVE usage", 1))
def rate_limits(spark, d):
    return outcomes.rate_limit_audit(view(spark, d, "usage"), 5, 86_400)


@query(f"{ctes('rumours')}, live AS (SELECT * FROM rumours WHERE status IN ('PENDING', 'HOT') AND rumour_date >= {NOW} - INTERVAL '900' DAY), j AS (SELECT r.id, l.id AS c, row_number() OVER (PARTITION BY r.id ORDER BY l.likelihood DESC, l.id) AS k FROM rumours r JOIN live l ON l.player_id = r.player_id AND l.to_club_id <> r.to_club_id) SELECT id, c AS contradicts FROM j WHERE k = 1")
def contradictions(spark, d):
    r = view(spark, d, "rumours")
    return outcomes.link_contradictions(r, r, F.expr(NOW), 900)


_OUT = 'SELECT id, source_id, rumour_date AS "at", status = \'COMPLETED\' AS hit FROM rumours WHERE status IN (\'COMPLETED\', \'FAILED\')'


def _outcomes(spark, d):
    return view(spark, d, "rumours").where("status in ('COMPLETED', 'FAILED')").select("id", "source_id", F.col("rumour_date").alias("at"), (F.col("status") == "COMPLETED").alias("hit"))


_RUNNING = f"""{ctes('rumours', 'sources')}, o AS ({_OUT}), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY "at", id) AS k FROM o),
 f AS (SELECT s.id AS source_id, 0::BIGINT AS k, NULL::BIGINT AS id, hit_count::DOUBLE AS h, (hit_count + miss_count)::DOUBLE AS n, reliability::DOUBLE AS score FROM sources s
 UNION ALL SELECT k.source_id, k.k, k.id, h + k.hit::INT, n + 1, greatest(0.1, least(0.99, score * (1 - least((n + 1) / 20, 1)) + (h + k.hit::INT) / (n + 1) * least((n + 1) / 20, 1))) FROM f JOIN k ON k.source_id = f.source_id AND k.k = f.k + 1)""".replace("WITH rumours", "WITH RECURSIVE rumours", 1)


@query(f"{_RUNNING} SELECT source_id AS id, CAST(max(h) AS BIGINT) AS hits, CAST(max(n) - arg_max(h, k) AS BIGINT) AS misses, round(arg_max(score, k), 6) AS score FROM f GROUP BY 1")
def source_outcomes(spark, d):
    return outcomes.source_reliability(_outcomes(spark, d), view(spark, d, "sources")).withColumn("score", F.round("score", 6))


@query(f'{_RUNNING} SELECT f.id, f.source_id, o."at", CAST(h AS BIGINT) AS hits, CAST(n - h AS BIGINT) AS misses, round(score, 6) AS score FROM f JOIN o ON o.id = f.id WHERE k > 0')
def reliability_history(spark, d):
    return outcomes.reliability_history(_outcomes(spark, d), view(spark, d, "sources")).withColumn("score", F.round("score", 6))


@query(f"""{ctes('rumours')}, x AS (SELECT o_orderkey % 997 * 4 + 1 AS k, o_orderdate AS t, CASE o_orderkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'DENIED' END AS s, o_orderkey % 10 = 0 AS forced FROM orders),
 g AS (SELECT k, max(row(t, s)) FILTER (forced) AS f, min(row(t, s)) FILTER (NOT forced) AS u FROM x GROUP BY 1), j AS (SELECT r.id, r.likelihood, r.status, CASE WHEN f IS NOT NULL THEN f WHEN status NOT IN ('COMPLETED', 'FAILED', 'DENIED') THEN u END AS o FROM rumours r JOIN g ON k = r.id)
 SELECT id AS rumour_id, CASE WHEN o[2] = 'COMPLETED' THEN 100.0 ELSE 0.0 END::DOUBLE AS likelihood, o[2] AS status, o[1] AS recorded_at FROM j WHERE o IS NOT NULL AND o[2] <> status""")
def outcome_history(spark, d):
    x = io.read_table(spark, d, "orders").selectExpr("o_orderkey % 997 * 4 + 1 AS rumour_id", "o_orderdate AS at", "CASE o_orderkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'DENIED' END AS status", "o_orderkey % 10 = 0 AS forced")
    return outcomes.outcome_history(view(spark, d, "rumours"), x)


@query("WITH f AS (SELECT event_id AS id, user_id, CAST(value AS BIGINT) % 40 AS player_id, ts, row_number() OVER (PARTITION BY user_id, CAST(value AS BIGINT) % 40 ORDER BY ts, event_id) AS again FROM events WHERE value IS NOT NULL), g AS (SELECT *, sum(CASE WHEN again = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f), h AS (SELECT *, max(CASE WHEN again = 1 AND k <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, player_id) = 1 AS accepted FROM g) SELECT id, user_id, player_id, accepted, accepted AND again = 1 AS was_created FROM h".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def watchlist_admission(spark, d):
    adds = io.read_table(spark, d, "events").where("value is not null").select(F.col("event_id").alias("id"), "user_id", (F.floor("value").cast("long") % 40).alias("player_id"), F.col("ts").alias("created_at"))
    return watchlists.watchlist_admission(adds)


_WATCHED = "SELECT event_id AS id, user_id, CAST(floor(value) AS BIGINT) % 40 AS player_id, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'REMOVE' WHEN 'signup' THEN 'TIER' ELSE 'ADD' END AS action, CASE WHEN event_type <> 'signup' THEN NULL WHEN value > 70 THEN 'PRO' ELSE 'FREE' END AS tier FROM {events} WHERE value IS NOT NULL"


@query(f"""WITH RECURSIVE e AS ({_WATCHED.format(events='events')}), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS k FROM e),
 f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS player_id, ''::VARCHAR AS action, false AS accepted, false AS was_created, []::BIGINT[] AS held, user_id % 11 <> 0 AS free FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT s.user_id, s.k, s.id, s.player_id, s.action, CASE s.action WHEN 'ADD' THEN NOT (free AND len(held) >= 5 AND NOT list_contains(held, s.player_id)) ELSE true END, s.action = 'ADD' AND NOT list_contains(held, s.player_id) AND NOT (free AND len(held) >= 5),
  CASE WHEN s.action = 'REMOVE' THEN list_filter(held, lambda x: x <> s.player_id) WHEN s.action = 'ADD' AND NOT list_contains(held, s.player_id) AND NOT (free AND len(held) >= 5) THEN list_append(held, s.player_id) ELSE held END,
  CASE WHEN s.action = 'TIER' THEN s.tier <> 'PRO' ELSE free END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
 SELECT id, user_id, player_id, action, accepted, was_created, CAST(len(held) AS BIGINT) AS held FROM f WHERE k > 0""")
def watchlist_replay(spark, d):
    events = io.read_table(spark, d, "events")
    users = events.select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 11 == 0, "RESEARCH").otherwise("FREE").alias("tier")).distinct()
    return watchlists.watchlist_replay(spark.sql(_WATCHED, events=events), users)


@query("SELECT event_id % 500 AS link, min(event_id) AS id FROM events WHERE event_id % 500 >= 100 GROUP BY 1")
def unseen_links(spark, d):
    rows = io.read_table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 500).cast("string").alias("link"), F.timestamp_seconds(F.col("event_id")).alias("published_at"), F.lit("h").alias("headline"))
    stored = rows.where(F.col("link").cast("long") < 100).select("link")
    return io.drop_seen(rows, stored).select(F.col("link").cast("long").alias("link"), "id")


@query(f"{ctes('claims')} SELECT id, CASE window_name WHEN 'SUMMER' THEN CASE WHEN make_timestamp(year(first_seen_at), 8, 31, 23, 59, 59) >= first_seen_at THEN make_timestamp(year(first_seen_at), 8, 31, 23, 59, 59) ELSE make_timestamp(year(first_seen_at) + 1, 8, 31, 23, 59, 59) END WHEN 'WINTER' THEN CASE WHEN make_timestamp(year(first_seen_at), 1, 31, 23, 59, 59) >= first_seen_at THEN make_timestamp(year(first_seen_at), 1, 31, 23, 59, 59) ELSE make_timestamp(year(first_seen_at) + 1, 1, 31, 23, 59, 59) END END AS cutoff FROM claims")
def window_cutoffs(spark, d):
    return view(spark, d, "claims").select("id", rules.window_cutoff(F.col("window"), F.col("first_seen_at")).alias("cutoff"))


@query(f"""{ctes("signals", "players")}, m AS (SELECT s.id, p.id AS player_id, s.headline, instr(lower(s.headline), CAST(p.id AS VARCHAR)) - 1 AS position FROM signals s JOIN players p ON split_part(s.headline, ' ', 2) = CAST(p.id AS VARCHAR))
 SELECT id, player_id, CAST(position AS INT) AS position, regexp_matches(substr(headline, 1, position + 60), '{text.CONTEXT}', 'i') AS in_context FROM m""")
def player_mentions(spark, d):
    # the headlines call a player by number
    named = view(spark, d, "players").select("id", F.concat(F.lit("Player "), F.col("id").cast("string")).alias("name"))
    found = mentions.match_players(view(spark, d, "signals").select("id", F.col("headline").alias("text")), named)
    return mentions.drop_shadowed_mononyms(found).select("id", "player_id", "position", "in_context")


@query("WITH n AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS w FROM part), c AS (SELECT w, min(id) AS club_id FROM n GROUP BY 1), t AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part) SELECT id, arg_min(club_id, (k, club_id)) AS club_id FROM t JOIN c USING (w) GROUP BY 1")
def best_club(spark, d):
    # part names stand for texts, their first words for clubs
    parts = io.read_table(spark, d, "part")
    clubs = parts.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).agg(F.min("p_partkey").alias("id"))
    return mentions.best_club(parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), clubs)


_TOLD = "SELECT o_orderkey AS id, o_custkey, concat(lower(c_name), CASE o_orderkey % 3 WHEN 0 THEN ' deal confirmed by ' WHEN 1 THEN ' saga over at ' ELSE ' seen at ' END, lower(s_name)) AS text FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON s_suppkey = o_orderkey % 100"


@query(f"{ctes('rumours')}, told AS ({_TOLD.format(orders='orders', customer='customer', supplier='supplier')}), h AS (SELECT id, o_custkey AS player_id, id % 100 AS to_club_id, CASE id % 3 WHEN 0 THEN 'COMPLETED' ELSE 'FAILED' END AS outcome FROM told WHERE id % 3 < 2) SELECT r.id AS rumour_id, min(h.id) AS signal_id, arg_min(outcome, h.id) AS outcome FROM rumours r JOIN h ON r.player_id = h.player_id AND r.to_club_id = h.to_club_id WHERE status IN ('PENDING', 'HOT') AND rumour_date >= {NOW} - INTERVAL '900' DAY GROUP BY 1")
def outcome_fallback(spark, d):
    told = spark.sql(_TOLD, **{b: io.read_table(spark, d, b) for b in ("orders", "customer", "supplier")}).select("id", "text")
    return mentions.outcome_fallback(told, view(spark, d, "players"), view(spark, d, "clubs"), view(spark, d, "rumours"), F.expr(NOW), 900)


@query("WITH r AS (SELECT c_custkey AS seq, CAST(c_custkey % 40 AS VARCHAR) AS x, c_name, c_mktsegment AS league, CASE WHEN c_nationkey % 2 = 0 THEN 'Unknown' ELSE CAST(c_nationkey AS VARCHAR) END AS country FROM customer), l AS (SELECT x, league, min(seq) AS s FROM r GROUP BY 1, 2), j AS (SELECT x, string_agg(league, ', ' ORDER BY s) AS league FROM l GROUP BY 1) SELECT x AS external_id, arg_min(c_name, seq) AS name, any_value(j.league) AS league, coalesce(arg_min(country, seq) FILTER (country <> 'Unknown'), 'Unknown') AS country FROM r JOIN j USING (x) GROUP BY 1")
def merged_clubs(spark, d):
    c = io.read_table(spark, d, "customer")
    return mentions.merge_clubs(c.select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 40).cast("string").alias("external_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("league"), F.when(F.col("c_nationkey") % 2 == 0, "Unknown").otherwise(F.col("c_nationkey").cast("string")).alias("country")))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'update' WHEN c_custkey % 3 = 1 AND c_custkey % 5 <> 0 THEN 'adopt' ELSE 'create' END AS action, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_custkey % 5 <> 0 THEN c_custkey END AS id, CAST(c_custkey AS VARCHAR) AS external_id, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 5 <> 0 THEN replace(c_name, '#', '.') ELSE replace(c_name, '#', ' ') END AS name, c_custkey % 3 = 2 AND c_custkey % 35 = 0 AS ambiguous FROM customer UNION ALL SELECT 'create', NULL, 'again-' || c_custkey, replace(c_name, '#', ' '), c_custkey % 3 = 2 FROM customer WHERE c_custkey % 35 = 0 AND c_custkey % 3 = 2")
def reconciled_catalog(spark, d):
    c = io.read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("n"), F.lit(None).cast("timestamp").alias("contract_end"))
    key = F.col("id").cast("string")
    old = c.where("id % 3 = 0 or id % 3 = 1 and id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, key).alias("external_id"), F.replace("n", F.lit("#"), F.lit(".")).alias("name"), "contract_end")
    new = c.select(key.alias("external_id"), F.replace("n", F.lit("#"), F.lit(" ")).alias("name"), "contract_end")
    again = c.where("id % 35 = 0 and id % 3 = 2").select(F.concat(F.lit("again-"), key).alias("external_id"), F.replace("n", F.lit("#"), F.lit(" ")).alias("name"), "contract_end")
    return mentions.reconcile_catalog(old, new.unionByName(again), text.normalise_club_name).select("action", "id", "external_id", "name", "ambiguous")


_SUMMED_CORE = f""", e AS (SELECT claim_id, count(*) AS items, count(DISTINCT coalesce(root_id, id)) AS n, arg_max(id, (published_at, id)) FILTER (source_type = 'CLUB_OFFICIAL' AND direction = 'CONFIRMS') AS yes, arg_max(id, (published_at, id)) FILTER (source_type = 'CLUB_OFFICIAL' AND direction = 'DENIES') AS no,
 arg_min(id, (published_at, id)) FILTER (direction = 'CONTRADICTS') AS against, min(id) AS strongest FROM evidence GROUP BY 1),
 s AS (SELECT c.*, coalesce(n, 0) AS n, items, yes, no, against, strongest, (epoch_ms({NOW}) - epoch_ms(last_evidence_at)) / 86400000.0 AS quiet FROM claims c LEFT JOIN e ON e.claim_id = c.id)"""
_SUMMED = ctes("claims", "evidence") + _SUMMED_CORE


@query(f"""{ctes("claims", "evidence", "sources")}{_SUMMED_CORE}, w AS (SELECT e.id, name FROM evidence e JOIN sources s ON s.id = source_id)
 SELECT s.id AS claim_id, 'Official club confirmation' AS factor, 'positive' AS direction, 1.0::DOUBLE AS magnitude, yes AS evidence_id, concat(coalesce(name, 'The club'), ' has officially confirmed this.') AS explanation FROM s LEFT JOIN w ON w.id = yes WHERE yes IS NOT NULL
 UNION ALL SELECT s.id, 'Official club denial', 'negative', 1.0, no, concat(coalesce(name, 'The club'), ' has officially denied this.') FROM s LEFT JOIN w ON w.id = no WHERE no IS NOT NULL
 UNION ALL SELECT id, concat(n, ' independent sources'), 'positive', round(least(n / 5.0, 1.0) * 0.75, 6), strongest, concat(n, ' separately-originating reports corroborate this — counting distinct original stories, not syndicated copies of the same one.') FROM s WHERE n >= 2
 UNION ALL SELECT id, 'Single original source', 'negative', 0.4, strongest, concat('All ', items, ' articles trace back to one original report — republished and syndicated, not independently corroborated.') FROM s WHERE n = 1 AND items > 1
 UNION ALL SELECT id, 'No corroborating evidence', 'negative', 0.5, NULL, 'No evidence has been captured for this claim yet.' FROM s WHERE n = 0
 UNION ALL SELECT s.id, 'Conflicting report', 'negative', 0.5, against, concat(coalesce(name, 'A source'), ' published a report that contradicts this claim.') FROM s LEFT JOIN w ON w.id = against WHERE against IS NOT NULL
 UNION ALL SELECT id, 'Evidence has gone quiet', 'negative', round(least(quiet / 60, 1.0) * 0.5, 6), NULL, concat('No new evidence in ', CAST(floor(quiet + 0.5) AS BIGINT), ' days.') FROM s WHERE yes IS NULL AND no IS NULL AND quiet > 14
 UNION ALL SELECT id, 'Specific fee reported', 'positive', 0.25, NULL, concat('A specific fee (€', CASE WHEN stated_fee = floor(stated_fee) THEN CAST(CAST(stated_fee AS BIGINT) AS VARCHAR) ELSE CAST(stated_fee AS VARCHAR) END, 'M) has been reported, suggesting detailed sourcing rather than speculation.') FROM s WHERE stated_fee IS NOT NULL""")
def forecast_factors(spark, d):
    return explain.forecast_factors(view(spark, d, "claims"), view(spark, d, "evidence"), F.expr(NOW), view(spark, d, "sources")).withColumn("magnitude", F.round("magnitude", 6))


@query(f"""{_SUMMED} SELECT id AS claim_id, 'confirmation' AS question FROM s WHERE yes IS NULL UNION ALL SELECT id, 'denial' FROM s WHERE no IS NULL UNION ALL SELECT id, 'corroboration' FROM s WHERE n < 2 UNION ALL SELECT id, 'time' FROM s WHERE window_name IS NOT NULL""")
def open_questions(spark, d):
    return explain.open_questions(view(spark, d, "claims"), view(spark, d, "evidence"))


@query(f"""{ctes("claims", "evidence", "players", "clubs")}, c AS (SELECT c.id AS claim_id, player_id, from_club_id, to_club_id FROM claims c), i AS (SELECT e.* FROM evidence e JOIN c USING (claim_id))
 SELECT claim_id, 'originated' AS kind, 'claim-' || claim_id AS source, 'player-' || player_id AS target FROM c WHERE player_id IN (SELECT id FROM players) UNION ALL SELECT claim_id, 'originated', 'claim-' || claim_id, 'club-' || from_club_id FROM c WHERE from_club_id IN (SELECT id FROM clubs)
 UNION ALL SELECT claim_id, 'originated', 'claim-' || claim_id, 'club-' || to_club_id FROM c WHERE to_club_id IN (SELECT id FROM clubs) UNION ALL SELECT claim_id, 'originated', 'source-' || source_id, 'evidence-' || id FROM i
 UNION ALL SELECT claim_id, 'cited', 'evidence-' || id, 'evidence-' || parent_id FROM i WHERE parent_id IS NOT NULL UNION ALL SELECT claim_id, CASE WHEN direction = 'DENIES' THEN 'denied' WHEN direction = 'CONFIRMS' AND source_type = 'CLUB_OFFICIAL' THEN 'confirmed' ELSE 'corroborated' END, 'evidence-' || id, 'claim-' || claim_id FROM i WHERE direction = 'DENIES' OR (direction = 'CONFIRMS' AND source_type = 'CLUB_OFFICIAL') OR (root_id IS NULL AND direction IN ('CONFIRMS', 'SUPPORTS'))""")
def provenance_edges(spark, d):
    return explain.provenance_edges(view(spark, d, "claims"), view(spark, d, "evidence"), view(spark, d, "players"), view(spark, d, "clubs"))


@query(f"""{ctes("claims", "evidence", "sources", "players", "clubs")}, i AS (SELECT e.* FROM evidence e WHERE claim_id IN (SELECT id FROM claims))
 SELECT id AS claim_id, 'claim-' || id AS id, 'claim' AS kind, 'Claim #' || id AS label FROM claims UNION ALL SELECT c.id, 'player-' || p.id, 'player', name FROM claims c JOIN players p ON p.id = player_id UNION ALL SELECT c.id, 'club-' || k.id, 'club', name FROM claims c JOIN clubs k ON k.id = from_club_id
 UNION ALL SELECT c.id, 'club-' || k.id, 'club', name FROM claims c JOIN clubs k ON k.id = to_club_id UNION ALL SELECT claim_id, 'evidence-' || id, 'evidence', NULL FROM i UNION ALL SELECT claim_id, 'source-' || source_id, 'source', coalesce(name, 'Source #' || source_id) FROM (SELECT DISTINCT claim_id, source_id FROM i) LEFT JOIN sources s ON s.id = source_id""")
def provenance_nodes(spark, d):
    return explain.provenance_nodes(*(view(spark, d, n) for n in ("claims", "evidence", "sources", "players", "clubs")))


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 6 AS k, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT id, CASE WHEN k IN (0, 1, 2) THEN 'Q' || id END AS kb_id, CAST(CASE WHEN k IN (0, 1) THEN 8 WHEN k IN (4, 5) THEN 20 ELSE 20 END AS INT) AS age, CASE WHEN k IN (0, 1, 2) THEN 'GK' ELSE 'CM' END AS position, CASE WHEN k IN (0, 1, 2) THEN n_name END AS nationality FROM p""")
def enriched_players(spark, d):
    # customers stand for players and for the dump: k tells which search rows and facts each has
    c, n = io.read_table(spark, d, "customer"), io.read_table(spark, d, "nation")
    p = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 6).alias("k"), "c_nationkey", F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("q"))
    row = lambda rank, kb, label, words: F.struct(F.lit(rank).alias("rank"), kb.alias("kb_id"), label.alias("label"), F.lit(words).alias("description"))
    other = F.concat("q", F.lit("x"))
    rows = F.when(F.col("k") == 4, F.array(row(4, F.col("q"), F.col("name"), "football player"))).otherwise(F.array(row(1, other, F.lit("else"), "Football club"), row(2, other, F.col("name"), "river"), row(3, F.col("q"), F.col("name"), "Footballer")))
    found = p.where("k <> 5").select("name", F.explode(rows).alias("r")).select("name", "r.*")
    entities = p.select(F.col("q").alias("kb_id"), F.array(F.when(F.col("k") == 3, "Q1").otherwise(enrichment.FOOTBALLER)).alias("occupations"), F.when(F.col("k") < 2, "+1990-01-01T00:00:00Z").alias("born"), F.lit("Q200479").alias("position"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nationality"))
    labels = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("kb_id"), F.col("n_name").alias("label"))
    none = F.lit(None)
    players = p.select("id", "name", F.lit(20).alias("age"), F.lit("CM").alias("position"), none.cast("string").alias("nationality"), none.cast("string").alias("kb_id"), none.cast("timestamp").alias("enriched_at"))
    return enrichment.enrich_players(players, found, entities, labels, F.expr(NOW)).select("id", "kb_id", "age", "position", "nationality")


@query()
def forest_likelihood(spark, d):
    features = forecast.likelihood_features(view(spark, d, "rumours"), view(spark, d, "sources"), view(spark, d, "players"))
    try:
        model = forecast.train_likelihood(features)[0]
    except forecast.TooFewRumours:  # the heuristic score, which scored_by tells; whatever else fails, fails the query
        model = None
    return forecast.score_likelihood(features, model).select("rumour_id", "score", "scored_by")


_MOVE = """SELECT o_orderkey AS id, replace(c_name, '#', '') AS player, replace(a.s_name, '#', '') AS club_a, replace(b.s_name, '#', '') AS club_b
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} a ON a.s_suppkey = o_orderkey % 10 + 1 JOIN {supplier} b ON b.s_suppkey = o_orderkey % 7 + 1"""
_TOLD_MOVE = f"""SELECT id, CASE id % 5 WHEN 0 THEN concat(player, ' joins ', club_a, ' deal from ', club_b) WHEN 1 THEN concat(player, ' transfer: leaves ', club_b, ' for ', club_a)
 WHEN 2 THEN concat(player, ' linked with ', club_a, ' and ', club_b) WHEN 3 THEN concat(player, ' signs for ', club_a, ', ', club_b, ' news') ELSE concat(club_b, ' man ', player, ' moves to ', club_a) END AS headline, '' AS summary FROM ({_MOVE})"""


@query(f"WITH m AS ({_MOVE.format(orders='orders', customer='customer', supplier='supplier')}) SELECT id, player, club_b AS from_club, club_a AS to_club, id % 5 = 4 AS from_inferred, round(0.92, 6)::DOUBLE AS confidence FROM m WHERE id % 5 IN (0, 1, 4) AND club_a <> club_b")
def extracted_moves(spark, d):
    # orders tell of moves: customers are players, suppliers are clubs
    bases = {b: io.read_table(spark, d, b) for b in ("orders", "customer", "supplier")}
    plain = lambda b, key, name: bases[b].select(F.col(key).alias("id"), F.replace(name, F.lit("#"), F.lit("")).alias("name"))
    found = extraction.extract_rumours(spark.sql(_TOLD_MOVE, **bases), plain("customer", "c_custkey", "c_name"), plain("supplier", "s_suppkey", "s_name"))
    return found.select("id", F.col("player_name").alias("player"), "from_club", "to_club", "from_inferred", F.round("confidence", 6).alias("confidence"))


@query(f"{ctes('evidence')} SELECT id, claim_id, source_id, published_at, source_type, direction, root_id FROM evidence ORDER BY published_at DESC, id DESC LIMIT 500")
def evidence_metadata(spark, d):
    return reports.evidence_metadata(view(spark, d, "evidence"))


@query("SELECT event_id, event_type IN ('view', 'click', 'signup') AS valid, CASE WHEN event_type = 'click' THEN concat('{\"k\":\"', json_extract_string(props, '$.k'), '\"}') END AS props FROM events")
def validated_events(spark, d):
    return reports.validate_product_events(io.read_table(spark, d, "events"), {"view": (), "click": ("k",), "signup": ()}, "props").select("event_id", "valid", "props")


@query(f"{ctes('evidence')} SELECT e.claim_id, e.id, e.published_at, e.root_id, row_number() OVER (PARTITION BY e.claim_id ORDER BY e.published_at, e.id) AS nth, (SELECT min(r.published_at) FROM evidence r WHERE r.claim_id = e.claim_id AND r.id = e.root_id) AS root_published_at FROM evidence e")
def evidence_timeline(spark, d):
    return reports.evidence_timeline(view(spark, d, "evidence"))


@query(f"{ctes('rumours', 'evidence')}, t AS (SELECT id, likelihood FROM rumours ORDER BY likelihood DESC, id LIMIT 50) SELECT t.id, t.likelihood, coalesce(string_agg(CAST(e.id AS VARCHAR), ',' ORDER BY e.published_at DESC, e.id DESC), '') AS articles FROM t LEFT JOIN evidence e ON e.claim_id = t.id GROUP BY 1, 2")
def articles_by_rumour(spark, d):
    out = reports.articles_by_rumour(view(spark, d, "rumours"), view(spark, d, "evidence").withColumnRenamed("claim_id", "rumour_id"))
    return out.withColumn("articles", F.array_join(F.col("articles").cast("array<string>"), ","))


@query(f"{ctes('signals', 'rumours')}, m AS (SELECT id AS s FROM rumours WHERE status IN ('HOT', 'COMPLETED') UNION ALL SELECT id FROM rumours WHERE status = 'HOT') SELECT source_id, count(DISTINCT id) AS signals, count(s) AS matches, count(DISTINCT s) AS matched_signals FROM signals LEFT JOIN m ON id = s GROUP BY 1")
def ingest_totals(spark, d):
    rumours = view(spark, d, "rumours").select(F.col("id").alias("signal_id"), F.col("id").alias("rumour_id"), "status")
    return reports.ingest_totals(view(spark, d, "signals"), rumours.where("status IN ('HOT', 'COMPLETED')").unionByName(rumours.where("status = 'HOT'")))


@query(f"{ctes('signals', 'rumours')} SELECT s.id, r.status = 'HOT' IS TRUE AS matched, CASE WHEN r.status = 'HOT' THEN r.id + 1 END AS rumour_id FROM signals s LEFT JOIN rumours r ON r.id = s.id")
def matched_signals(spark, d):
    hot = view(spark, d, "rumours").where("status = 'HOT'").select(F.col("id").alias("signal_id"), F.explode(F.array("id", F.col("id") + 1)).alias("rumour_id"))
    return reports.mark_matched(view(spark, d, "signals"), hot).select("id", "matched", "rumour_id")


@query("SELECT o_orderkey AS id, c_custkey AS player_id, f.s_suppkey AS from_club_id, t.s_suppkey AS to_club_id FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0 LEFT JOIN supplier f ON f.s_suppkey = o_orderkey % 120 LEFT JOIN supplier t ON t.s_suppkey = o_orderkey % 90")
def resolved_transfers(spark, d):
    rows = io.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("player_external_id"), (F.col("o_orderkey") % 120).cast("string").alias("from_club_external_id"), (F.col("o_orderkey") % 90).cast("string").alias("to_club_external_id"))
    players = view(spark, d, "players").withColumn("external_id", F.when(F.col("id") % 5 != 0, F.col("id").cast("string")))
    return reports.resolve_external_ids(rows, players, view(spark, d, "clubs").withColumn("external_id", F.col("id").cast("string"))).select("id", "player_id", "from_club_id", "to_club_id")


_FORECASTS = "SELECT o_custkey AS claim_id, o_orderdate + o_orderkey % 86400 * INTERVAL '1' SECOND AS predicted_at, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 1000 / CAST(1000 AS DOUBLE) END AS calibrated FROM {orders}"


def _forecasts(spark, d):
    return spark.sql(_FORECASTS, orders=io.read_table(spark, d, "orders")).dropDuplicates(["claim_id", "predicted_at"])


_FORECASTS_SQL = f"WITH g AS ({_FORECASTS.format(orders='orders')}), f AS (SELECT claim_id, predicted_at, min(calibrated) AS calibrated FROM g GROUP BY 1, 2)"


@query(f"{_FORECASTS_SQL} SELECT claim_id, predicted_at, calibrated, row_number() OVER (PARTITION BY claim_id ORDER BY predicted_at) AS nth, CAST(floor(calibrated * 100 + 0.5) AS BIGINT) AS plotted FROM f")
def forecast_history(spark, d):
    return reports.forecast_history(_forecasts(spark, d).groupBy("claim_id", "predicted_at").agg(F.min("calibrated").alias("calibrated")))


@query(f"{_FORECASTS_SQL}, e AS (SELECT o_custkey AS claim_id, l_orderkey * 10 + l_linenumber AS id, min(l_shipdate) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT e.claim_id, e.id, e.at, arg_min(predicted_at, (abs(epoch_us(predicted_at) - epoch_us(e.at)), epoch_us(predicted_at))) AS nearest FROM e JOIN f ON e.claim_id = f.claim_id GROUP BY 1, 2, 3")
def nearest_point(spark, d):
    events = io.read_table(spark, d, "lineitem").join(io.read_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    events = events.groupBy(F.col("o_custkey").alias("claim_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_shipdate").alias("at"))
    return reports.nearest_point(_forecasts(spark, d), events)


@query(f"{ctes('players', 'clubs')}, w AS (SELECT user_id, event_id % 150 + 1 AS player_id, max(ts) AS created_at FROM events GROUP BY 1, 2) SELECT user_id, player_id, p.name AS player, c.name AS club, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, player_id) AS nth FROM w JOIN players p ON p.id = player_id LEFT JOIN clubs c ON c.id = current_club_id")
def watchlist_listing(spark, d):
    watched = io.read_table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 150 + 1).alias("player_id")).agg(F.max("ts").alias("created_at"))
    return reports.watchlist_listing(watched, view(spark, d, "players"), view(spark, d, "clubs"))


_PRODUCT = "CASE WHEN event_type = 'signup' AND value > 60 THEN 'WATCHLIST_CREATED' WHEN event_type = 'view' THEN 'PROVENANCE_PANEL_VIEWED' WHEN event_type = 'click' THEN 'UPGRADE_INTEREST_CLICKED' WHEN event_type = 'purchase' THEN 'FORECAST_HISTORY_VIEWED' ELSE 'ALERT_ACTIVATED' END"


@query(f"WITH e AS (SELECT user_id, {_PRODUCT} AS t FROM events), u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'PRO' ELSE 'FREE' END AS tier FROM customer), c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 80), w AS (SELECT DISTINCT user_id FROM e WHERE t = 'WATCHLIST_CREATED') SELECT (SELECT count(user_id) / count(*) FROM u LEFT JOIN w ON id = user_id) AS activation_rate, (SELECT count(*) FILTER (t IN ('PROVENANCE_PANEL_VIEWED', 'FORECAST_HISTORY_VIEWED')) / count(DISTINCT user_id) FROM e) AS views_per_active_user, (SELECT count(*) FILTER (t = 'UPGRADE_INTEREST_CLICKED') FROM e) AS upgrade_clicks, (SELECT count(user_id) / count(*) FROM u LEFT JOIN c ON id = user_id WHERE tier = 'FREE') AS cap_hit_rate")
def product_metrics(spark, d):
    events = io.read_table(spark, d, "events")
    users = io.read_table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'PRO' ELSE 'FREE' END AS tier")
    return reports.product_metrics(users, events.select("user_id", F.expr(_PRODUCT).alias("event_type")), events.where("event_type = 'error' AND value > 80").select("user_id"))


@query("SELECT json_extract_string(props, '$.k') AS feature_key, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1")
def upgrade_clicks(spark, d):
    events = io.read_table(spark, d, "events").select(F.expr(_PRODUCT).alias("event_type"), F.expr("replace(props, '\"k\"', '\"featureKey\"')").alias("metadata"))
    return reports.upgrade_clicks(events)


@query(f"{ctes('sources')} SELECT id, CASE WHEN tier IS NULL THEN 0.5 ELSE (6 - greatest(1.0, least(5.0, CAST(tier AS DOUBLE)))) / 5 END AS score FROM sources")
def tier_scores(spark, d):
    return view(spark, d, "sources").select("id", rules.tier_score(F.col("tier")).alias("score"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS has_model, CASE WHEN o_orderkey % 5 = 0 THEN 'synthetic' WHEN o_orderkey % 11 <> 0 THEN 'db' END AS src, o_orderkey % 400 AS n_test, 150 + o_orderkey % 3 * 50 AS least, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 100 / 100.0 END AS p, CAST(0 AS DOUBLE) AS low, o_orderkey % 10 / CAST(10 AS DOUBLE) AS high FROM orders),
 g AS (SELECT *, CASE WHEN NOT has_model THEN 1 WHEN coalesce(src, '') <> 'db' THEN 2 WHEN n_test < least THEN 3 WHEN p IS NULL THEN 4 WHEN high - low > 0.4 THEN 5 ELSE 6 END AS rule FROM f)
 SELECT id, CASE rule WHEN 6 THEN 'PRECISE' WHEN 5 THEN 'INTERVAL' ELSE 'INSUFFICIENT_DATA' END AS mode, CASE rule WHEN 1 THEN 'No trained model exists yet for this forecast definition.'
 WHEN 2 THEN 'The current model is trained on synthetic data only — no calibrated probability can be shown until enough resolved real outcomes exist to train on.'
 WHEN 3 THEN concat('Model was evaluated on only ', n_test, ' held-out samples (need ', least, '+) — not enough to trust an out-of-sample estimate.') WHEN 4 THEN 'Forecasting service unavailable.' END AS reason FROM g""")
def display_gates(spark, d):
    k = F.col("o_orderkey")
    gate = rules.display_gate(k % 4 != 0, F.when(k % 5 == 0, "synthetic").when(k % 11 != 0, "db"), k % 400, F.when(k % 7 != 0, k % 100 / 100), F.lit(0.0), k % 10 / F.lit(10.0), 150 + k % 3 * 50)
    return io.read_table(spark, d, "orders").select(k.alias("id"), gate.alias("g")).select("id", "g.mode", "g.reason")


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderkey % 1000 / CAST(1000 AS DOUBLE) AS p FROM orders), c(lo, hi, r, n) AS (VALUES (0.0::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE, 40), (0.2::DOUBLE, 0.4::DOUBLE, 0.35::DOUBLE, 100), (0.6::DOUBLE, 0.8::DOUBLE, 0.7::DOUBLE, 10)),
 k AS (SELECT id, first(r ORDER BY CASE WHEN p BETWEEN lo AND hi THEN 0 ELSE 1 END, CASE WHEN p BETWEEN lo AND hi THEN 0 ELSE abs((lo + hi) / 2 - p) END, lo) AS r, first(n ORDER BY CASE WHEN p BETWEEN lo AND hi THEN 0 ELSE 1 END, CASE WHEN p BETWEEN lo AND hi THEN 0 ELSE abs((lo + hi) / 2 - p) END, lo) AS n FROM p, c GROUP BY id)
 SELECT id, round(greatest(0, least(1, r - 1.96 * sqrt(r * (1 - r) / n))), 9) AS low, round(greatest(0, least(1, r + 1.96 * sqrt(r * (1 - r) / n))), 9) AS high FROM k""")
def uncertainty_bands(spark, d):
    curve = F.array(*[F.struct(F.lit(lo).alias("binLow"), F.lit(hi).alias("binHigh"), F.lit(r).alias("empiricalRate"), F.lit(n).alias("n")) for lo, hi, r, n in ((0.0, 0.2, 0.1, 40), (0.2, 0.4, 0.35, 100), (0.6, 0.8, 0.7, 10))])
    band = rules.uncertainty_band(F.col("o_orderkey") % 1000 / F.lit(1000.0), curve)
    return io.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), band.alias("b")).select("id", F.round("b.low", 9).alias("low"), F.round("b.high", 9).alias("high"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Undisclosed' WHEN 1 THEN concat('€', o_orderkey % 90, 'M') WHEN 2 THEN concat('€', o_orderkey % 90, '.5M') WHEN 3 THEN concat('€', o_orderkey % 90, '–', o_orderkey % 90 + 4, 'M') ELSE concat('€', o_orderkey % 90, 'M') END AS label FROM orders")
def fee_labels(spark, d):
    k = F.col("o_orderkey") % 5
    amount = (F.col("o_orderkey") % 90).cast("double")
    low = F.when(k.isin(1, 3, 4), amount).when(k == 2, amount + 0.5)
    high = F.when(k == 1, amount).when(k == 3, amount + 4)
    return io.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.fee_label(low, high).alias("label"))


# customers stand for registrations of model versions, nations for definitions
_MODELS = """SELECT c_custkey AS id, c_nationkey AS definition_id, concat('forecast-v', c_custkey % 400) AS version, TIMESTAMP '2026-01-01 00:00:00' + c_custkey * 7919 % 5000 * INTERVAL '1' HOUR AS trained_at, CASE WHEN c_custkey % 3 = 0 THEN 'synthetic' ELSE 'db' END AS data_source,
 c_custkey % 500 AS n_test, 150 + c_custkey % 3 * 50 AS min_samples, TIMESTAMP '2026-06-01 00:00:00' + c_custkey * 104729 % 9000 * INTERVAL '1' MINUTE AS registered_at FROM {customer}"""
_DEFINITIONS = "SELECT n_nationkey AS id, n_regionkey + 1 AS version, n_nationkey % 4 <> 1 AS is_active FROM {nation}"
_REGISTRY = f"""m AS ({_MODELS.format(customer='customer')}), one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY version ORDER BY registered_at DESC, id DESC) = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY definition_id ORDER BY registered_at DESC, id DESC) = 1 AS is_current FROM one)"""


def _models(spark, d):
    return spark.sql(_MODELS, customer=io.read_table(spark, d, "customer"))


@query(f"""WITH {_REGISTRY}, d AS ({_DEFINITIONS.format(nation='nation')}), k AS (SELECT r.*, d.version AS definition_version, row_number() OVER (PARTITION BY definition_id ORDER BY trained_at DESC, r.id DESC) AS rank FROM r JOIN d ON d.id = definition_id AND is_active)
 SELECT definition_id, definition_version, CAST(rank AS INT) AS rank, version, trained_at, data_source, is_current, n_test >= min_samples AS enough FROM k WHERE rank <= 5""")
def model_registry(spark, d):
    return models.current_models(_models(spark, d), spark.sql(_DEFINITIONS, nation=io.read_table(spark, d, "nation")))


@query(f"""WITH {_REGISTRY}, c AS (SELECT * FROM r WHERE is_current), f AS (SELECT o_orderkey AS claim_id, o_orderkey % 30 AS definition_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 101 / CAST(100 AS DOUBLE) END AS p, o_orderkey % 11 / CAST(20 AS DOUBLE) AS w FROM orders),
 g AS (SELECT f.*, c.id AS model_id, n_test, min_samples, CASE WHEN c.id IS NULL THEN 1 WHEN data_source <> 'db' THEN 2 WHEN n_test < min_samples THEN 3 WHEN p IS NULL THEN 4 WHEN w > 0.4 THEN 5 ELSE 6 END AS rule FROM f LEFT JOIN c USING (definition_id))
 SELECT claim_id, definition_id, model_id, CASE rule WHEN 6 THEN 'PRECISE' WHEN 5 THEN 'INTERVAL' ELSE 'INSUFFICIENT_DATA' END AS display_mode, CASE WHEN rule > 4 THEN p END AS calibrated, CASE WHEN rule > 4 THEN w END AS high,
 CASE rule WHEN 1 THEN 'No trained model exists yet for this forecast definition.' WHEN 2 THEN 'The current model is trained on synthetic data only — no calibrated probability can be shown until enough resolved real outcomes exist to train on.'
 WHEN 3 THEN concat('Model was evaluated on only ', n_test, ' held-out samples (need ', min_samples, '+) — not enough to trust an out-of-sample estimate.') WHEN 4 THEN 'Forecasting service unavailable.' END AS reason FROM g""")
def gated_forecasts(spark, d):
    k = F.col("o_orderkey")
    p, none = F.when(k % 7 != 0, k % 101 / F.lit(100.0)), F.lit(None).cast("string")
    scored = io.read_table(spark, d, "orders").select(k.alias("claim_id"), (k % 30).alias("definition_id"), p.alias("raw"), p.alias("calibrated"), F.lit(0.0).alias("low"), (k % 11 / F.lit(20.0)).alias("high"), none.alias("model_version"))
    return models.gate(scored, models.registry(_models(spark, d))).select("claim_id", "definition_id", "model_id", "display_mode", "calibrated", "high", "reason")


# suppliers stand for teams of two leagues each, nations for countries, regions for leagues; customers for squad members

@query("""WITH t AS (SELECT s_suppkey AS id, s_name, s_nationkey AS c, k, (s_suppkey + k) % 7 AS league, (s_suppkey + k) % 7 * 10 + k AS seq FROM supplier, (VALUES (0), (1), (3)) v(k)), n AS (SELECT t.*, coalesce(r_name, 'Unknown') AS league_name, CASE WHEN (c + k) % 3 = 0 THEN n_name END AS country FROM t LEFT JOIN region ON r_regionkey = league LEFT JOIN nation ON n_nationkey = c),
 l AS (SELECT id, league_name, min(seq) AS s FROM n GROUP BY 1, 2)
 SELECT concat('sm-club-', id) AS external_id, arg_min(s_name, seq) AS name, (SELECT string_agg(league_name, ', ' ORDER BY s) FROM l WHERE l.id = n.id) AS league, coalesce(arg_min(country, seq) FILTER (country IS NOT NULL), 'Unknown') AS country FROM n GROUP BY id""")
def catalogue_clubs(spark, d):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(3)))
    teams = io.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey", k.alias("k"))
    league = (F.col("id") + F.col("k")) % 7
    teams = teams.select("id", "name", league.cast("string").alias("league_key"), (league * 10 + F.col("k")).alias("seq"), F.lit(None).cast("string").alias("short_code"), F.lit(None).cast("string").alias("image_path"), F.when((F.col("s_nationkey") + F.col("k")) % 3 == 0, F.col("s_nationkey")).alias("country_id"))
    countries = io.read_table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    leagues = io.read_table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name"))
    return catalogue.league_clubs(teams, countries, leagues).select("external_id", "name", "league", "country")


_POSITION_NAMES = "CASE {} WHEN 24 THEN 'GK' WHEN 148 THEN 'CB' WHEN 149 THEN 'CDM' WHEN 150 THEN 'CAM' WHEN 151 THEN 'ST' WHEN 152 THEN 'LW' WHEN 153 THEN 'CM' WHEN 154 THEN 'RB' WHEN 155 THEN 'LB' WHEN 156 THEN 'RW' WHEN 157 THEN 'LM' WHEN 158 THEN 'RM' WHEN 163 THEN 'CF' END"


@query(f"""SELECT concat('sm-player-', c_custkey) AS external_id, c_name AS name, concat('sm-club-', c_custkey % 90) AS current_club_external_id, CASE WHEN c_custkey % 5 <> 0 THEN 18 + c_custkey % 20 END::INT AS age,
 {_POSITION_NAMES.format("CASE WHEN c_custkey % 4 = 0 THEN 24 ELSE 145 + c_custkey % 20 END")} AS position, CASE WHEN c_custkey % 6 <> 0 THEN n_name END AS nationality, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2028-06-30 00:00:00' END AS contract_end FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def catalogue_players(spark, d):
    key = F.col("c_custkey")
    c = io.read_table(spark, d, "customer").join(io.read_table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    born = F.when(key % 5 != 0, F.concat((1980 - key % 20).cast("string"), F.lit("-05-01")))
    player = F.struct(key.alias("id"), F.col("c_name").alias("display_name"), born.alias("date_of_birth"), F.lit(None).cast("string").alias("image_path"), F.when(key % 6 != 0, F.struct(F.col("n_name").alias("name"))).alias("nationality"))
    detailed = F.when(key % 4 != 0, 145 + key % 20)
    members = c.select((key % 90).cast("string").alias("team_key"), F.lit(24).alias("position_id"), detailed.alias("detailed_position_id"), F.when(key % 7 != 0, "2028-06-30").alias("end"), player.alias("player"))
    return catalogue.squad_players(members, F.expr(NOW)).select("external_id", "name", "current_club_external_id", "age", "position", "nationality", "contract_end")


@query(f"{ctes('claims', 'evidence', 'sources')}, f AS (SELECT * FROM claims WHERE claim_status = 'ACTIVE' AND id IN (SELECT claim_id FROM evidence WHERE source_id IN (SELECT id FROM sources WHERE tier <= 2))) SELECT id, player_id, last_evidence_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY last_evidence_at DESC, id OFFSET 50 LIMIT 50")
def claims_page(spark, d):
    return ev.list_claims(view(spark, d, "claims"), view(spark, d, "evidence"), view(spark, d, "sources"), status="ACTIVE", tier=2, page=2, limit=50).select("id", "player_id", "last_evidence_at", "total")


@query(f"{ctes('evidence')}, h AS (SELECT *, coalesce(root_id, id) AS r FROM evidence), k AS (SELECT *, id <> r AS s FROM h) SELECT claim_id, r AS root_id, id, s AS syndicated, CASE WHEN s THEN row_number() OVER (PARTITION BY claim_id, r, s ORDER BY published_at, id) ELSE 0 END AS nth FROM k")
def provenance_clusters(spark, d):
    return ev.cluster_members(view(spark, d, "evidence"))


_DECIDED = "SELECT id AS candidate_id, root_id AS item_id, id % 3 = 0 AS merge FROM {evidence} WHERE parent_id <> root_id AND id % 2 = 0"


@query(f"{ctes('evidence')}, d AS ({_DECIDED.format(evidence='evidence')}) SELECT e.id, e.root_id AS before, CASE WHEN merge THEN item_id ELSE e.parent_id END AS root_id FROM evidence e LEFT JOIN d ON d.candidate_id = e.id")
def resolved_duplicates(spark, d):
    # a copy's root is its parent until a review merges it
    evidence = view(spark, d, "evidence").withColumn("before", F.col("root_id"))
    decisions = spark.sql(_DECIDED, evidence=evidence)
    return ev.resolve_duplicates(evidence.withColumn("root_id", F.col("parent_id")), decisions).select("id", "before", "root_id")


@query(f"{ctes('evidence')}, d AS ({_DECIDED.format(evidence='evidence')}) SELECT e.root_id AS item_id, id AS candidate_id, CASE WHEN merge IS NOT NULL THEN {NOW} END AS reviewed_at FROM evidence e LEFT JOIN d ON d.candidate_id = e.id WHERE e.root_id IS NOT NULL")
def reviewed_duplicates(spark, d):
    evidence = view(spark, d, "evidence")
    candidates = evidence.where("root_id is not null").select(F.col("root_id").alias("item_id"), F.col("id").alias("candidate_id"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    return ev.review_duplicates(candidates, spark.sql(_DECIDED, evidence=evidence), F.expr(NOW))


@query(f"""{ctes('claims')}, s AS (SELECT o_custkey AS player_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % {CLUBS} END AS from_club_id, o_orderkey * 3 % {CLUBS} AS to_club_id, o_orderdate + o_orderkey % 50 * INTERVAL '1' DAY AS seen_at FROM orders),
 n AS (SELECT player_id, from_club_id, to_club_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_evidence_at FROM s GROUP BY 1, 2, 3) SELECT n.*, (SELECT min(c.id) FROM claims c WHERE claim_status = 'ACTIVE' AND c.player_id = n.player_id AND c.to_club_id = n.to_club_id AND c.from_club_id IS NOT DISTINCT FROM n.from_club_id) AS claim_id FROM n""")
def found_claims(spark, d):
    seen = spark.sql(f"SELECT o_custkey AS player_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % {CLUBS} END AS from_club_id, o_orderkey * 3 % {CLUBS} AS to_club_id, o_orderdate + o_orderkey % 50 * INTERVAL '1' DAY AS seen_at FROM {{orders}}", orders=io.read_table(spark, d, "orders"))
    return ev.find_or_create_claims(seen, view(spark, d, "claims"))


@query("""WITH s AS (SELECT 'feed ' || o_custkey % 60 AS name, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 10) / CAST(10 AS DOUBLE) END AS implied, o_orderdate AS t, CAST(o_orderkey AS VARCHAR) AS link FROM orders), f AS (SELECT name, first(implied ORDER BY t, link) AS implied FROM s GROUP BY 1)
 SELECT name, 'AGGREGATOR' AS type, coalesce(implied, CASE WHEN CAST(substr(name, 6) AS INT) % 2 = 0 THEN 0.75 END, 0.5)::DOUBLE AS reliability FROM f WHERE CAST(substr(name, 6) AS INT) >= 20""")
def ensured_sources(spark, d):
    k = F.col("o_orderkey")
    signals = io.read_table(spark, d, "orders").select(F.concat(F.lit("feed "), (F.col("o_custkey") % 60).cast("string")).alias("source_name"), F.when(k % 3 == 0, k % 10 / F.lit(10.0)).alias("implied_reliability"), F.col("o_orderdate").alias("published_at"), k.cast("string").alias("link"))
    names = signals.select(F.col("source_name").alias("name"), F.substring("source_name", 6, 9).cast("int").alias("n")).distinct()
    return outcomes.ensure_sources(signals, names.where("n < 20"), names.where("n % 2 = 0").select("name", F.lit(0.75).alias("default")))
