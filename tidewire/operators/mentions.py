"""Players and clubs that texts mention, outcomes without a tuple, and the catalogue's upkeep.

Names meet texts through equi-joins on word n-grams or on their rarest character gram, so no text is held against
the whole catalogue. Null texts and null names mention nothing; repeated rows with one id count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text
from tidewire.operators.serving import active_rumours
from tidewire.sources.io import few_broadcast, materialise, once

GRAM = 4


def _words(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text.fold_accents(c), r"[\t\n\x0B\f\r]", " "), "[^a-z0-9 ]", "")
    return F.array_remove(F.split(F.trim(plain), " "), "")


def _mentioned(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label_id, label, at, score): labels (label_id, label) that stand in a text as whole words.

    Only word runs that begin with the first word of a label and have the length of one that does are held against the labels."""
    names = once(labels, _n=F.array_join(_words(F.col("label")), " ")).select("label_id", F.col("_n").alias("label")).where("label <> ''").distinct()
    names = materialise(names, "names")
    parts = F.split("label", " ")
    longest = names.agg(F.max(F.size(parts))).first()[0] or 0  # one number
    heads = few_broadcast(materialise(names.groupBy(F.get(parts, F.lit(0)).alias("_head")).agg(F.collect_set(F.size(parts)).alias("_sizes")), "name-heads"))  # a few lengths a word
    rows = once(signals.select("id", "text"), w=_words(F.col("text"))).select("id", "w", F.posexplode("w").alias("at", "_first"))
    rows = rows.select("id", F.slice("w", F.col("at") + 1, F.lit(longest)).alias("w"), F.size("w").alias("size"), "at", "_first")  # no more of the text goes along than a name may need
    rows = rows.join(heads, F.col("_first") == F.col("_head")).select("id", "w", "size", "at", F.explode("_sizes").alias("n")).where(F.col("n") <= F.size("w"))
    runs = rows.select("id", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("gram"), "at", (F.col("n") == F.col("size")).alias("whole"))
    hits = runs.join(names, F.col("gram") == F.col("label"))
    return hits.groupBy("id", "label_id", "label").agg(F.min("at").alias("at"), F.when(F.bool_or("whole"), 1.0).otherwise(0.92).alias("score"))


def match_players(signals: DataFrame, players: DataFrame) -> DataFrame:
    """(id, player_id, score, position, in_context) for each player whose full name a text holds as whole words.

    signals: id, text. The position is that of the last name in the folded text, -1 if punctuation hides it;
    `in_context` tells whether transfer vocabulary stands near it and is true for unknown positions.
    """
    hits = _mentioned(signals, players.select(F.col("id").alias("label_id"), F.col("name").alias("label")))
    texts = signals.dropDuplicates(["id"]).select(F.col("id").alias("_s"), F.col("text").alias("_t"))
    spot = F.position(F.element_at(F.split("label", " "), -1), text.fold_accents(F.col("_t"))) - 1
    near = hits.join(texts, F.col("id") == F.col("_s")).withColumn("position", spot)
    return near.select("id", F.col("label_id").alias("player_id"), "label", "score", "position", text.transfer_context_near(F.col("_t"), F.col("position")).alias("in_context"))


def drop_shadowed_mononyms(matches: DataFrame) -> DataFrame:
    """Matches without the one-word names with which a longer name found in the same text begins."""
    longer = matches.where(F.contains("label", F.lit(" "))).select(F.col("id").alias("_s"), F.split_part("label", F.lit(" "), F.lit(1)).alias("_first")).distinct()
    return matches.join(longer, (F.col("id") == F.col("_s")) & (F.col("label") == F.col("_first")), "left_anti")


def club_labels(clubs: DataFrame) -> DataFrame:
    """(id, label): the names, short names and nicknames of clubs. clubs: id, name, and short_name if there is one."""
    labels = clubs.select("id", F.col("name").alias("label"))
    if "short_name" in clubs.columns:
        labels = labels.unionByName(clubs.select("id", F.col("short_name").alias("label")))
    nicknames = F.create_map(*[F.lit(x) for pair in text.CLUB_ALIASES.items() for x in pair])
    known = clubs.sparkSession.range(1).select(F.explode(nicknames).alias("nick", "full"))
    aliases = labels.join(F.broadcast(known), text.normalise(F.col("label")) == text.normalise(F.col("full")))  # 16 rows
    return labels.unionByName(aliases.select("id", F.col("nick").alias("label")))


def similar_names(names: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(name, known, score): pairs of a name and a known label with a similarity (T3) from `least`, which is 0.65 or more.

    Labels that hold one another meet on word n-grams. Spellings within the edits that `least` allows share at least
    (2 least - 1) n - 1 pairs of letters, hence one of the rarest of either; so they meet on these and are verified. Up to three letters they may share no pair, but
    share a letter.
    """
    a = names.select("name", F.array_join(_words(F.col("name")), " ").alias("x")).where("x <> ''").distinct()
    b = known.select(F.col("label").alias("known"), F.array_join(_words(F.col("label")), " ").alias("y")).where("y <> ''").distinct()

    def letters(rows: DataFrame, c: str) -> DataFrame:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.substr(F.col("s"), i, F.lit(2)))
        each = rows.select(F.col(c).alias("s")).distinct().select("s", F.posexplode(pairs).alias("i", "g"))
        return each.select("s", F.concat_ws("#", "g", F.row_number().over(Window.partitionBy("s", "g").orderBy("i"))).alias("g"))

    of_a, of_b = letters(a, "x"), letters(b, "y")
    often = of_b.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("df"))

    def rare(grams: DataFrame) -> DataFrame:
        n = F.length("s")
        needed = F.greatest(F.lit(1), F.ceil((2 * least - 1) * n - 1 - 1e-9))
        ranked = grams.join(often, F.col("g") == F.col("_g"), "left").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.coalesce("df", F.lit(0)), "g")))
        return ranked.where(F.col("r") <= n - 1 - needed + 1).select("s", "g")

    def short(rows: DataFrame, c: str) -> DataFrame:
        return rows.select(F.col(c).alias("s")).where(F.length("s") <= 3).distinct().select("s", F.explode(F.array_distinct(F.split("s", ""))).alias("g")).where("g <> ''")

    brief = short(a, "x").withColumnRenamed("s", "x").join(short(b, "y").withColumnRenamed("s", "y"), "g").select("x", "y")
    left, right = rare(of_a).select(F.col("s").alias("x"), "g"), rare(of_b).select(F.col("s").alias("y"), "g")
    fits = (F.length("x") >= F.ceil(F.length("y") * least)) & (F.length("y") >= F.ceil(F.length("x") * least))
    spelt = left.join(right, "g").where(fits).select("x", "y").unionByName(brief).distinct()
    held = _mentioned(a.select(F.col("x").alias("id"), F.col("x").alias("text")), b.select(F.col("y").alias("label_id"), F.col("y").alias("label"))).select(F.col("id").alias("x"), F.col("label_id").alias("y"))
    holds = _mentioned(b.select(F.col("y").alias("id"), F.col("y").alias("text")), a.select(F.col("x").alias("label_id"), F.col("x").alias("label"))).select(F.col("label_id").alias("x"), F.col("id").alias("y"))
    scored = spelt.unionByName(held).unionByName(holds).distinct().withColumn("score", text.name_similarity(F.col("x"), F.col("y"))).where(F.col("score") >= least)
    return scored.join(a, "x").join(b, "y").select("name", "known", "score")


SPELT = 0.80  # the similarity from which a whole text is a club's name


def spelt_clubs(texts: DataFrame, column: str, clubs: DataFrame) -> DataFrame:
    """(column, club struct<id, name>, label, score): the clubs whose name, short name or nickname a whole text is nearly (T3 from SPELT on), or is a part of as whole words.

    Only texts that are short enough for that are looked at. They meet labels on rare pairs of letters, see similar_names.
    """
    labels = materialise(club_labels(clubs).join(clubs.dropDuplicates(["id"]).select(F.col("id").alias("_k"), F.col("name").alias("_name")), F.col("id") == F.col("_k")).select(F.struct("id", F.col("_name").alias("name")).alias("club"), "label").where("label is not null").distinct(), "club-labels")
    longest = labels.agg(F.max(F.length(text.normalise(F.col("label"))))).first()[0] or 0  # one number
    short = texts.select(F.col(column).alias("name")).where(F.length(text.normalise(F.col("name"))) <= longest / SPELT).distinct()
    met = similar_names(short, labels.select("label"), SPELT)
    return met.join(labels, F.col("known") == F.col("label")).select(F.col("name").alias(column), "club", "label", "score")


def club_labels_in(signals: DataFrame, clubs: DataFrame) -> DataFrame:
    """(id, club struct<id, name>, label, score): the labels by which each text names clubs."""
    found = _mentioned(signals, club_labels(clubs).select(F.col("id").alias("label_id"), "label"))
    names = clubs.dropDuplicates(["id"]).select(F.col("id").alias("_k"), F.col("name").alias("_name"))
    return found.join(names, F.col("label_id") == F.col("_k")).select("id", F.struct(F.col("label_id").alias("id"), F.col("_name").alias("name")).alias("club"), "label", "score")


def match_clubs(signals: DataFrame, clubs: DataFrame) -> DataFrame:
    """(id, club_id, at, score) for each club that a text names by name, short name or nickname as whole words, or that a whole text nearly is.

    clubs: id, name, and short_name if there is one. A club found by several labels keeps its best score. `at` counts words; for inexact
    spellings, which have no place, it is null.
    """
    found = _mentioned(signals, club_labels(clubs).select(F.col("id").alias("label_id"), "label")).select("id", "label_id", "at", "score")
    texts = signals.select("id", text.resolve_alias(F.col("text")).alias("text")).distinct()
    spelt = spelt_clubs(texts.select("text"), "text", clubs).select(F.col("text").alias("_t"), F.col("club.id").alias("label_id"), "score")
    near = texts.join(spelt, F.col("text") == F.col("_t")).select("id", "label_id", F.lit(None).cast("int").alias("at"), "score")
    return found.unionByName(near).groupBy("id", F.col("label_id").alias("club_id")).agg(F.min("at").alias("at"), F.max("score").alias("score"))


def best_club(signals: DataFrame, clubs: DataFrame) -> DataFrame:
    """(id, club_id): the club named first in each text, of several the one with the higher score, then smaller id; clubs without a place come last."""
    return match_clubs(signals, clubs).groupBy("id").agg(F.min_by("club_id", F.struct(F.coalesce("at", F.lit(1 << 20)).alias("at"), -F.col("score"), "club_id")).alias("club_id"))


def contained_parts(signals: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, owner): owners of a part of at least GRAM characters that a lower-case text holds anywhere, also inside words.

    parts: owner, part. Where a part's first GRAM characters stand in a text, as many characters as such parts have are cut out and looked up among
    the parts. So a text has a few rows for each of its places, however many parts resemble one another.
    """
    parts = materialise(parts.where(F.length("part") >= GRAM).distinct(), "name-parts")
    heads = parts.groupBy(F.left("part", F.lit(GRAM)).alias("_head")).agg(F.collect_set(F.length("part")).alias("_sizes"))
    heads = few_broadcast(materialise(heads, "part-heads"))
    longest = parts.agg(F.max(F.length("part"))).first()[0] or 0  # one number
    low = once(signals.dropDuplicates(["id"]).select("id", "text"), low=F.lower("text")).where(F.length("low") >= GRAM)
    places = low.select("id", "low", F.explode(F.sequence(F.lit(1), F.length("low") - (GRAM - 1))).alias("at"))
    rows = places.select("id", F.substring("low", F.col("at"), F.lit(GRAM)).alias("gram"), F.substring("low", F.col("at"), F.lit(longest)).alias("rest"))
    rows = rows.join(heads, F.col("gram") == F.col("_head")).select("id", "rest", F.explode("_sizes").alias("n")).where(F.col("n") <= F.length("rest"))
    hits = rows.select("id", F.left("rest", F.col("n")).alias("part")).distinct()
    return hits.join(parts, "part").select("id", "owner").distinct()


def outcome_fallback(signals: DataFrame, players: DataFrame, clubs: DataFrame, rumours: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(rumour_id, signal_id, outcome): outcome texts without a tuple settle the live rumours of a player to a club they name.

    Of several signals the smallest id settles a rumour. A player is named by any part of the name, a club by its whole name.
    """
    told = materialise(once(signals.select("id", "text"), outcome=text.detect_outcome(F.col("text"))).where("outcome is not null"), "told")
    who = contained_parts(told, players.select(F.col("id").alias("owner"), F.explode(F.split(F.lower("name"), r"\s+")).alias("part")))
    where = contained_parts(told, clubs.select(F.col("id").alias("owner"), F.lower("name").alias("part")))
    live = active_rumours(rumours).where(F.col("rumour_date") >= now - F.make_dt_interval(F.lit(days))).select(F.col("id").alias("rumour_id"), "player_id", "to_club_id")
    met = live.join(who.select(F.col("id").alias("signal_id"), F.col("owner").alias("player_id")), "player_id")
    met = met.join(where.select(F.col("id").alias("signal_id"), F.col("owner").alias("to_club_id")), ["signal_id", "to_club_id"])
    met = met.join(told.select(F.col("id").alias("signal_id"), "outcome"), "signal_id")
    return met.groupBy("rumour_id").agg(F.min("signal_id").alias("signal_id"), F.min_by("outcome", "signal_id").alias("outcome"))


def merge_clubs(rows: DataFrame) -> DataFrame:
    """One row per external id of (seq, external_id, name, league, country): leagues joined in order of arrival, the first known
    country, the rest from the first row (A14)."""
    seen = F.array_sort(F.collect_list(F.struct("seq", "league")))["league"]
    known = F.min_by("country", F.when(F.col("country") != "Unknown", F.col("seq")))
    return rows.groupBy("external_id").agg(F.min_by("name", "seq").alias("name"), F.array_join(F.array_distinct(seen), ", ").alias("league"), F.coalesce(known, F.lit("Unknown")).alias("country"))


def reconcile_catalog(existing: DataFrame, incoming: DataFrame, name_key=lambda c: c) -> DataFrame:
    """incoming rows as (action, id, external_id, name, contract_end, ambiguous).

    update: the external id is known; adopt: it is not, and one existing row alone has the name under `name_key`, which
    it keeps; create: neither, with a null id. A null contract end leaves the stored one. Null external ids never match. ambiguous: several incoming
    rows without a known id have the name, so that more than one would adopt a row.
    """
    old = existing.select(F.col("id").alias("_id"), F.col("external_id").alias("_x"), F.col("name").alias("_name"), F.col("contract_end").alias("_end"), name_key(F.col("name")).alias("_key"))
    known = old.select(F.struct("_id", "_name", "_end").alias("by_id"), "_x")
    same = old.groupBy("_key").agg(F.count("*").alias("_n"), F.first(F.struct("_id", "_name", "_end")).alias("by_name")).where("_n = 1")
    met = incoming.join(known, F.col("external_id") == F.col("_x"), "left").join(same, name_key(F.col("name")) == F.col("_key"), "left")
    twins = incoming.join(known.select("_x"), F.col("external_id") == F.col("_x"), "left_anti").groupBy(name_key(F.col("name")).alias("_twin")).agg(F.count(F.lit(1)).alias("_many")).where("_many > 1")
    met = met.join(twins, name_key(F.col("name")) == F.col("_twin"), "left")
    action = F.when(F.col("by_id").isNotNull(), "update").when(F.col("by_name").isNotNull(), "adopt").otherwise("create")
    row = F.coalesce("by_id", "by_name")
    ambiguous = F.col("_many").isNotNull() & F.col("by_id").isNull()
    return met.select(action.alias("action"), row["_id"].alias("id"), "external_id", F.when(action == "adopt", row["_name"]).otherwise(F.col("name")).alias("name"), F.coalesce("contract_end", row["_end"]).alias("contract_end"), ambiguous.alias("ambiguous"))
