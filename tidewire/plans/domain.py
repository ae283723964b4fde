"""The library's tables as projections of the generic test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.sources.io import dealt, read_table

NOW = "TIMESTAMP '1998-08-02 00:00:00'"
CLUBS = 100
#: Items of evidence that a task numbers within their claims, about.
TASK_ROWS = 250_000

_HEADLINE = """concat('Player ', CAST(o_custkey AS STRING), CASE o_orderkey % 8
 WHEN 0 THEN ' passes medical, here we go!' WHEN 1 THEN ' linked with summer move' WHEN 2 THEN ' deal collapsed, says agent' WHEN 3 THEN ' wins award'
 WHEN 4 THEN ' target of Tier 2 club in January' WHEN 5 THEN ' contract talks according to Sky Sports' WHEN 6 THEN ' transfer off' ELSE ' trains with squad' END)"""

VIEWS = {
    "clubs": "SELECT s_suppkey AS id, s_name AS name, n_name AS league, r_name AS country FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "players": f"SELECT c_custkey AS id, c_name AS name, c_mktsegment AS position, c_custkey % {CLUBS} AS current_club_id, abs(c_acctbal) / 100 AS market_value, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE TIMESTAMP '1996-01-01 00:00:00' + (c_custkey % 1500) * INTERVAL '1' DAY END AS contract_end FROM {{customer}}",
    "sources": "SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name, CASE WHEN CAST(substr(source, 4) AS BIGINT) % 7 = 0 THEN NULL ELSE 1 + CAST(substr(source, 4) AS BIGINT) % 5 END AS tier, 0.3 + 0.03 * CAST(CAST(substr(source, 4) AS BIGINT) AS DOUBLE) AS reliability, CAST(substr(source, 4) AS BIGINT) % 4 AS hit_count, CAST(substr(source, 4) AS BIGINT) % 3 AS miss_count FROM {documents} WHERE source LIKE 'src%'",
    "rumours": f"""SELECT o_orderkey AS id, o_custkey AS player_id, o_orderkey % {CLUBS} AS from_club_id, (o_orderkey * 7 + 3) % {CLUBS} AS to_club_id, o_orderkey % 20 AS source_id,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 0.9 / 10000 END AS fee_min, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice * 1.1 / 10000 END AS fee_max,
        CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'COMPLETED' WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '2%' THEN 'FAILED' WHEN o_orderkey % 3 = 0 THEN 'HOT' ELSE 'PENDING' END AS status,
        o_orderdate AS rumour_date, CASE WHEN extract(month FROM o_orderdate) BETWEEN 6 AND 8 THEN 'SUMMER' ELSE 'WINTER' END AS window_name, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 0.6 END AS DOUBLE) AS base_probability,
        CAST(o_orderkey * 37 % 101 AS DOUBLE) AS likelihood, 1 + o_orderkey % 4 AS source_count, o_orderkey % 4 = 0 AS from_club_inferred FROM {{orders}}""",
    "signals": f"SELECT o_orderkey AS id, {_HEADLINE} AS headline, o_orderdate AS published_at, o_orderkey % 20 AS source_id FROM {{orders}}",
    "evidence": """SELECT id, claim_id, source_id, published_at, direction, source_type, confidence, CASE WHEN copied THEN first_id END AS root_id,
        CASE WHEN copied THEN coalesce(max(CASE WHEN copied THEN id END) OVER (PARTITION BY claim_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_id) END AS parent_id
        FROM (SELECT *, l_suppkey % 4 = 0 AND id > first_id AS copied FROM (SELECT l_orderkey * 10000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id, l_orderkey * 10000 + 1 AS first_id, l_suppkey,
        l_orderkey AS claim_id, l_suppkey % 20 AS source_id, l_shipdate AS published_at,
        CASE WHEN l_linenumber % 6 = 1 THEN 'CONFIRMS' WHEN l_linenumber % 6 = 2 THEN 'DENIES' WHEN l_returnflag = 'R' THEN 'CONTRADICTS' WHEN l_returnflag = 'A' THEN 'CONTEXTUAL' ELSE 'SUPPORTS' END AS direction,
        CASE WHEN l_linestatus = 'F' AND l_suppkey % 3 = 0 THEN 'CLUB_OFFICIAL' ELSE 'NEWS_OUTLET' END AS source_type, l_discount * 10 AS confidence FROM {lineitem}) n) c""",
    "usage": "SELECT event_id AS id, user_id AS api_key_id, ts AS created_at, event_type FROM {events}",
    "claims": f"""SELECT o_orderkey AS id, o_custkey AS player_id, o_orderkey % {CLUBS} AS from_club_id, o_orderkey * 3 % {CLUBS} AS to_club_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS stated_fee,
        CASE WHEN o_orderkey % 3 = 0 THEN 24 END AS stated_months, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' ELSE 'LOAN' END AS transfer_type, CASE o_orderkey % 3 WHEN 0 THEN 'SUMMER' WHEN 1 THEN 'WINTER' ELSE 'FREE_AGENT' END AS window_name,
        CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'ACTIVE' ELSE 'DENIED' END AS claim_status, o_orderdate AS first_seen_at, o_orderdate AS last_evidence_at FROM {{orders}}""",
    "predictions": "SELECT o_orderkey AS claim_id, o_orderdate + INTERVAL '45' DAY AS as_of FROM {orders}",
}
BASE = ("supplier", "nation", "region", "customer", "orders", "lineitem", "events", "documents")
RENAMES = {"rumours": {"window_name": "window"}, "claims": {"window_name": "window"}}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    bases = {b: read_table(spark, sf_dir, b) for b in BASE if "{" + b + "}" in text}
    if name == "evidence":
        bases["lineitem"] = dealt(bases["lineitem"], "l_orderkey", TASK_ROWS)
    return spark.sql(text, **bases).withColumnsRenamed(RENAMES.get(name, {}))


def ctes(*names: str) -> str:
    """The views as common table expressions of DuckDB."""
    plain = {b: b for b in BASE}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**plain).replace('AS STRING', 'AS VARCHAR')})" for n in names)
