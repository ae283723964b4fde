"""Players completed from a knowledge-base dump: joins in place of a request per player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text

# The knowledge base's id of the occupation "association football player", and of positions.
FOOTBALLER = "Q937857"
POSITIONS = {
    "Q200479": "GK",
    "Q1369174": "CB",
    "Q225571": "LB",
    "Q901012": "RB",
    "Q1085854": "RB",
    "Q193592": "CDM",
    "Q1090034": "CM",
    "Q1046830": "CAM",
    "Q11681748": "LW",
    "Q1074319": "LW",
    "Q1627431": "RW",
    "Q10297665": "ST",
    "Q11677751": "ST",
    "Q944060": "CF",
}
CONSIDERED, FRESH_DAYS = 3, 7


def enrich_players(players: DataFrame, found: DataFrame, entities: DataFrame, labels: DataFrame, now: Column) -> DataFrame:
    """players with age, position, nationality, kb_id and enriched_at filled from the dump.

    found: (name, rank, kb_id, label, description), the search rows of a name from rank 1. Of the best three, the first whose label is
    the name and whose description speaks of football is taken, else the first that speaks of football. entities:
    (kb_id, occupations, born, position, nationality), kept if a footballer's. labels: (kb_id, label) of countries. A value that the dump
    lacks leaves the stored one; players enriched in the last seven days, and null names, stay as they are.
    """
    football = F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("football"))
    exact = F.lower("label") == F.lower("_name")
    hits = found.where((F.col("rank") <= CONSIDERED) & football).withColumnRenamed("name", "_name")
    best = hits.groupBy("_name").agg(F.min_by("kb_id", F.struct(F.when(exact, 0).otherwise(1).alias("inexact"), "rank", "kb_id")).alias("_kb"))
    known = entities.where(F.array_contains("occupations", FOOTBALLER)).dropDuplicates(["kb_id"]).select(F.col("kb_id").alias("_e"), "born", F.col("position").alias("_position"), F.col("nationality").alias("_country"))
    countries = labels.dropDuplicates(["kb_id"]).select(F.col("kb_id").alias("_l"), F.col("label").alias("_nationality"))
    facts = best.join(known, F.col("_kb") == F.col("_e")).join(countries, F.col("_country") == F.col("_l"), "left")
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair]), F.col("_position"))
    facts = facts.select("_name", "_kb", text.age_from_birth(F.col("born"), now).alias("_age"), mapped.alias("_mapped"), "_nationality")
    due = F.col("enriched_at").isNull() | (F.col("enriched_at") < now - F.make_dt_interval(F.lit(FRESH_DAYS)))
    rows = players.join(facts, (F.col("name") == F.col("_name")) & due, "left")
    new = {"kb_id": F.coalesce("_kb", "kb_id"), "age": F.coalesce(F.nullif("_age", F.lit(0)), "age"), "position": F.coalesce("_mapped", "position"), "nationality": F.coalesce(F.nullif("_nationality", F.lit("")), "nationality"), "enriched_at": F.when(F.col("_kb").isNotNull(), now).otherwise(F.col("enriched_at"))}
    return rows.withColumns(new).select(*players.columns)
