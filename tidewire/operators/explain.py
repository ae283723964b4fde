"""Why a forecast stands where it does: provenance graphs, factors and open questions of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.sources.io import few_broadcast, materialise

QUIET_DAYS = 14


def _name(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def provenance_nodes(claims: DataFrame, evidence: DataFrame, sources: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """(claim_id, id, kind, label): a claim, its player and clubs, its evidence, and each source once.

    Players and clubs that the catalogue lacks have no node; a source without a name is labelled by its number.
    """
    def named(key: str, prefix: str, kind: str, table: DataFrame, label: Column) -> DataFrame:
        known = table.select(F.col("id").alias("_k"), label.alias("label"))
        return claims.select(F.col("id").alias("claim_id"), F.col(key)).join(known, F.col(key) == F.col("_k")).select("claim_id", _name(prefix, key).alias("id"), F.lit(kind).alias("kind"), "label")

    club = F.coalesce("short_name", "name") if "short_name" in clubs.columns else F.col("name")
    title = F.col("title") if "title" in evidence.columns else F.lit(None).cast("string")
    of_claims = evidence.join(claims.select(F.col("id").alias("_c")), F.col("claim_id") == F.col("_c"), "left_semi")
    names = few_broadcast(materialise(sources.select(F.col("id").alias("_s"), "name"), "source-names"))  # a source may have most of the items
    from_sources = of_claims.select("claim_id", "source_id").distinct().join(names, F.col("source_id") == F.col("_s"), "left")
    parts = [
        claims.select(F.col("id").alias("claim_id"), _name("claim-", "id").alias("id"), F.lit("claim").alias("kind"), _name("Claim #", "id").alias("label")),
        named("player_id", "player-", "player", players, F.col("name")),
        named("from_club_id", "club-", "club", clubs, club),
        named("to_club_id", "club-", "club", clubs, club),
        of_claims.select("claim_id", _name("evidence-", "id").alias("id"), F.lit("evidence").alias("kind"), title.alias("label")),
        from_sources.select("claim_id", _name("source-", "source_id").alias("id"), F.lit("source").alias("kind"), F.coalesce("name", _name("Source #", "source_id")).alias("label")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def provenance_edges(claims: DataFrame, evidence: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """(claim_id, kind, source, target): originated, cited, and one of denied, confirmed, corroborated per item.

    A denial comes first, then an official confirmation; a root that supports or confirms corroborates; the rest have none.
    """
    def towards(key: str, prefix: str, table: DataFrame) -> DataFrame:
        known = table.select(F.col("id").alias("_k"))
        return claims.join(known, F.col(key) == F.col("_k"), "left_semi").select(F.col("id").alias("claim_id"), F.lit("originated").alias("kind"), _name("claim-", "id").alias("source"), _name(prefix, key).alias("target"))

    items = evidence.join(claims.select(F.col("id").alias("_c")), F.col("claim_id") == F.col("_c"), "left_semi")
    parent = F.col("parent_id") if "parent_id" in evidence.columns else F.lit(None).cast("long")
    root, direction = F.coalesce("root_id", "id") == F.col("id"), F.col("direction")
    verdict = F.when(direction == "DENIES", "denied").when((direction == "CONFIRMS") & (F.col("source_type") == "CLUB_OFFICIAL"), "confirmed").when(root & direction.isin("SUPPORTS", "CONFIRMS"), "corroborated")
    own = _name("evidence-", "id")
    # The edges of an item in one pass over the evidence.
    edges = F.array_compact(
        F.array(
            F.struct(F.lit("originated").alias("kind"), _name("source-", "source_id").alias("source"), own.alias("target")),
            F.when(parent.isNotNull(), F.struct(F.lit("cited").alias("kind"), own.alias("source"), F.concat(F.lit("evidence-"), parent.cast("string")).alias("target"))),
            F.when(verdict.isNotNull(), F.struct(verdict.alias("kind"), own.alias("source"), _name("claim-", "claim_id").alias("target"))),
        )
    )
    of_items = items.select("claim_id", F.explode(edges).alias("e")).select("claim_id", "e.kind", "e.source", "e.target")
    return towards("player_id", "player-", players).unionByName(towards("from_club_id", "club-", clubs)).unionByName(towards("to_club_id", "club-", clubs)).unionByName(of_items)


def _summed_up(claims: DataFrame, evidence: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Claims with the counts, official words, strongest cluster and earliest contradiction of their evidence, and with the names (`_confirmation_id` and
    so on) of those items' sources if these are given. One pass: sums by root, then by claim."""
    root, official = F.coalesce("root_id", "id"), F.col("source_type") == "CLUB_OFFICIAL"
    rows = evidence.withColumn("_name", F.lit(None).cast("string"))
    if sources is not None:
        names = sources.groupBy(F.col("id").alias("_s")).agg(F.min("name").alias("_name"))
        rows = evidence.join(names, F.col("source_id") == F.col("_s"), "left")
    item = lambda when: F.when(when, F.struct("published_at", "id", "_name"))
    per_root = rows.groupBy("claim_id", root.alias("root")).agg(
        F.count_if(F.col("id") != root).alias("copies"),
        F.count(F.lit(1)).alias("evidence"),
        F.max(item(official & (F.col("direction") == "CONFIRMS"))).alias("c"),
        F.max(item(official & (F.col("direction") == "DENIES"))).alias("d"),
        F.min(item(F.col("direction") == "CONTRADICTS")).alias("a"),
    )
    per = per_root.groupBy(F.col("claim_id").alias("_c")).agg(F.max_by("root", F.struct("copies", -F.col("root"))).alias("strongest"), F.sum("evidence").alias("evidence"), F.count("root").alias("independent"), F.max("c").alias("c"), F.max("d").alias("d"), F.min("a").alias("a"))
    told = [x for key, at in (("confirmation_id", "c"), ("denial_id", "d"), ("contradicting", "a")) for x in (F.col(f"{at}.id").alias(key), F.col(f"{at}._name").alias(f"_{key}"))]
    per = per.select("_c", "strongest", "evidence", "independent", *told)
    rows = claims.join(per, F.col("id") == F.col("_c"), "left")
    return rows.withColumns({"evidence": F.coalesce("evidence", F.lit(0)), "independent": F.coalesce("independent", F.lit(0))})


# Labels and explanations of factors.
LABELS = {
    "confirmation": "Official club confirmation",
    "denial": "Official club denial",
    "independent": "{} independent sources",
    "single": "Single original source",
    "none": "No corroborating evidence",
    "conflict": "Conflicting report",
    "quiet": "Evidence has gone quiet",
    "fee": "Specific fee reported",
}
REASONS = {
    "confirmation": "{} has officially confirmed this.",
    "denial": "{} has officially denied this.",
    "independent": "{} separately-originating reports corroborate this — counting distinct original stories, not syndicated copies of the same one.",
    "single": "All {} articles trace back to one original report — republished and syndicated, not independently corroborated.",
    "none": "No evidence has been captured for this claim yet.",
    "conflict": "{} published a report that contradicts this claim.",
    "quiet": "No new evidence in {} days.",
    "fee": "A specific fee (€{}M) has been reported, suggesting detailed sourcing rather than speculation.",
}


def _filled(told: str, value: Column | None) -> Column:
    if "{}" not in told:
        return F.lit(told)
    before, after = told.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def forecast_factors(claims: DataFrame, evidence: DataFrame, now: Column, sources: DataFrame | None = None) -> DataFrame:
    """(claim_id, factor, direction, magnitude, evidence_id, explanation), one row per factor of a claim.

    With `sources` (id, name) the explanations name the club or outlet; without, or where the name is unknown, they say "The club" or "A source".
    """
    rows = _summed_up(claims, evidence, sources)
    named = {"confirmation_id": "The club", "denial_id": "The club", "contradicting": "A source"}
    who = lambda key: F.coalesce(F.col(f"_{key}"), F.lit(named[key]))
    n, quiet = F.col("independent"), (F.unix_millis(now) - F.unix_millis(F.col("last_evidence_at").cast("timestamp"))) / 86_400_000
    unsaid = F.col("confirmation_id").isNull() & F.col("denial_id").isNull()

    def factor(when: Column, kind: str, sign: str, magnitude: Column, item: Column | None = None, told: Column | None = None) -> Column:
        item = F.lit(None) if item is None else item
        return F.when(when, F.struct(_filled(LABELS[kind], told).alias("factor"), F.lit(sign).alias("direction"), magnitude.cast("double").alias("magnitude"), item.cast("long").alias("evidence_id"), _filled(REASONS[kind], told).alias("explanation")))

    found = F.array_compact(
        F.array(
            factor(F.col("confirmation_id").isNotNull(), "confirmation", "positive", F.lit(1.0), F.col("confirmation_id"), who("confirmation_id")),
            factor(F.col("denial_id").isNotNull(), "denial", "negative", F.lit(1.0), F.col("denial_id"), who("denial_id")),
            factor(n >= 2, "independent", "positive", F.least(n / 5, F.lit(1.0)) * 0.75, F.col("strongest"), n),
            factor((n == 1) & (F.col("evidence") > 1), "single", "negative", F.lit(0.4), F.col("strongest"), F.col("evidence")),
            factor(n == 0, "none", "negative", F.lit(0.5)),
            factor(F.col("contradicting").isNotNull(), "conflict", "negative", F.lit(0.5), F.col("contradicting"), who("contradicting")),
            factor(unsaid & (quiet > QUIET_DAYS), "quiet", "negative", F.least(quiet / 60, F.lit(1.0)) * 0.5, None, F.floor(quiet + 0.5)),
            factor(F.col("stated_fee").isNotNull(), "fee", "positive", F.lit(0.25), None, rules.plain_number(F.col("stated_fee"))),
        )
    )
    return rows.select(F.col("id").alias("claim_id"), F.explode(found).alias("f")).select("claim_id", "f.*")


def top_factors(factors: DataFrame, direction: str, n: int = 3) -> DataFrame:
    """The n largest factors of a direction per claim; ties keep the order of their names."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("magnitude")).alias("m"), "factor", "evidence_id")))
    tops = factors.where(F.col("direction") == direction).groupBy("claim_id").agg(F.slice(ordered, 1, n).alias("t"))
    return tops.select("claim_id", F.posexplode("t").alias("rank", "f")).select("claim_id", (F.col("rank") + 1).alias("rank"), "f.factor", (-F.col("f.m")).alias("magnitude"), "f.evidence_id")


def open_questions(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, question): what could still change a claim: confirmation, denial, corroboration, time."""
    rows = _summed_up(claims, evidence)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("confirmation_id").isNull(), "confirmation"),
            F.when(F.col("denial_id").isNull(), "denial"),
            F.when(F.col("independent") < 2, "corroboration"),
            F.when(F.col("window").isNotNull(), "time"),
        )
    )
    return rows.select(F.col("id").alias("claim_id"), F.explode(kinds).alias("question"))
