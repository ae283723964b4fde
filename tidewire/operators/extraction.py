"""From texts to moves: who goes from which club to which, for known and for new names.

All of it is joins and column expressions. A mention is one row (text, player); its clause is cut out by expressions, its direction
cues become rows (mention, side, rank, slice), and the clubs that the clause names meet these slices by the mention's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text
from tidewire.operators import mentions
from tidewire.sources.io import materialise, once

# Shapes of names, and the four phrases around a name.
NAME_WORD = r"\p{Lu}[\p{L}'-]+"
NAME = NAME_WORD + r"(?:\s" + NAME_WORD + r"){1,2}"
NAME_PHRASES = (
    r"^(" + NAME + r")\s+(?:to|joins?|signs? for|moves? to|heading to|completes? move to|set to join)\b",
    r"(?:sign(?:s|ed)?|target(?:s|ed)?|eye(?:s|d)?|want(?:s|ed)?|bid(?:s)? for|keen on|chase(?:s|d)?|linked with|interested in|approach(?:ed)?|agree(?:s|d)? deal for|complete(?:s|d)? signing of)\s+(" + NAME + r")",
    r"(" + NAME + r")\s+(?:completes?|confirms?|announces?|agrees?|passes? medical|here we go)",
    r"[:\-–]\s+(" + NAME + r")\s+(?:to|joins?|signs?)\b",
)
STATEMENT = 2  # the phrase whose name may be that of a speaker
BEST_CONFIDENCE, LESS_PER_PHRASE = 0.90, 0.02
LEADING_POSSESSIVE = r"^(?:\p{Lu}\p{L}*\s+)?\p{Lu}\p{L}*'s\s+"
POSITION_FOLLOWS = r"(?i)^\s*(goalkeeper|defender|midfielder|forward|striker|winger|fullback|sweeper|keeper|attacker)\b"
APPOINTMENT = r"(?i)\b(boss|manager|head coach|assistant coach|director of football|sporting director|technical director)\b"
CLUB_SUFFIX = r"(?i)\b(FC|CF|SC|AFC|RFC|BC|United|City|Athletic|Rovers|Wanderers|Town|County|Rangers|Hotspur|Albion|Palace|Wednesday|Vallecano|Villarreal|Sociedad)\s*$"

# Capitalised words that are no part of a player's name.
NOT_NAMES = (
    "Transfer", "Window", "Premier", "League", "Season", "Summer", "Winter", "January", "August", "United", "City", "Real", "Club",
    "Football", "Champions", "Europa", "Conference", "World", "Cup", "International", "Breaking", "Exclusive", "Report", "Update",
    "Confirmed", "Official", "Deal", "Move", "Sign", "Signs", "Signed", "Agreement", "Contract", "Medical", "Done", "Close", "Complete",
    "Here", "Goes", "According", "Source", "Sources", "Multiple", "Reports", "Latest", "News", "Market", "Value", "Million", "Euro",
    "Pound", "Fee", "Wage", "Goalkeeper", "Defender", "Midfielder", "Forward", "Striker", "Winger", "Fullback", "Sweeper", "Keeper",
    "Attacker", "Cottage", "Park", "Stadium", "Arena", "Ground", "Lane", "Road", "Bridge", "Emirates", "Anfield", "Stamford", "Etihad",
    "Trafford", "Fabrizio", "Romano", "Ornstein", "David", "Florentino", "Athletic", "Sporting", "Dynamo", "Atletico", "Vallecano",
    "English", "Spanish", "German", "French", "Italian", "Dutch", "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
    "Saturday",
)

# The five shapes of club names.
CLUB_SHAPES = (
    r"\b([A-Z][a-z]+ (?:FC|CF|SC|AC|FK|SK|AF))\b",
    r"\b(FC [A-Z][a-z]+)\b",
    r"\b([A-Z][a-z]+ (?:United|City|Athletic|Rovers|Wanderers|Town|County|Rangers|Hotspur|Albion|Palace|Wednesday))\b",
    r"\b((?:Real|Atletico|Sporting|Racing|Deportivo|CA) [A-Z][a-z]+)\b",
    r"\b((?:Manchester|Newcastle|Nottingham|Wolverhampton|Crystal|Sheffield|Brighton|Leicester|Blackburn) [A-Z][a-z]+)\b",
)

# Cues of a destination and of an origin, and what takes their sense away.
TO_CUES = (" to ", " joins ", " signs for ", " moves to ", " heading to ", " rejoint ")
FROM_CUES = (" from ", " leaves ", " leave ", " departs ", " exits ", " quitte ", " quittent ")
TO_VERB = r"(?i)^(leave|leaves|join|joins|sign|signs|complete|completes|become|becomes|move|moves|head|heads|make|makes|watch|watching|monitor|monitoring|scout|scouting|track|tracking|assess|assessing|replace|replaces|hijack|hijacks|bid|bids|bidding)\b"
REPORTED = r"\b(reports?|news|sources?|according)\s*$"
NEAR, AROUND, APART = 40, 150, 80

KNOWN_PLAYER, KNOWN_CLUB, NEW_CLUB, NEW_NAME = 0.70, 0.65, 0.70, 0.85


def is_proper_name(name: Column) -> Column:
    """Two or three capitalised words, 5 to 35 characters, without digits, stop words or a club's ending."""
    words = F.split(F.trim(name), r"\s+")
    stop = F.array(*[F.lit(w) for w in NOT_NAMES])
    shape = F.size(words).between(2, 3) & F.length(name).between(5, 35) & F.forall(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    return shape & ~F.arrays_overlap(words, stop) & ~F.rlike(name, F.lit(CLUB_SUFFIX)) & ~F.rlike(name, F.lit(r"\d"))


def candidate_names(headline: Column) -> Column:
    """Names that stand in a transfer phrase, each once with its best confidence, as array<struct<name, confidence>> (T5).

    Every phrase gives its first match. A name before a position word or an appointment is none, nor is one that makes a
    statement about another name. The text behind the phrase is a further group of the same expression.
    """
    found = []
    for k, phrase in enumerate(NAME_PHRASES):
        pattern = F.lit(phrase + r"((?s).{0," + str(NEAR) + "})")
        name = F.regexp_replace(F.trim(F.regexp_extract(headline, phrase + r"((?s).{0," + str(NEAR) + "})", 1)), LEADING_POSSESSIVE, "")
        behind = F.regexp_extract(headline, phrase + r"((?s).{0," + str(NEAR) + "})", 2)
        good = F.rlike(headline, pattern) & is_proper_name(name) & ~F.rlike(behind, F.lit(POSITION_FOLLOWS)) & ~F.rlike(behind, F.lit(APPOINTMENT))
        if k == STATEMENT:
            other = F.regexp_extract(behind, "(" + NAME + ")", 1)
            good = good & ~((other != "") & is_proper_name(other))
        found.append(F.when(good, F.struct(name.alias("name"), F.lit(BEST_CONFIDENCE - k * LESS_PER_PHRASE).alias("confidence"))))
    names = F.array_compact(F.array(*found))
    return F.filter(names, lambda x, i: F.array_position(F.transform(names, lambda y: y["name"]), x["name"]) == i + 1)


def club_candidates(headline: Column) -> Column:
    """Texts with the shape of a club's name, distinct, shape by shape in order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(headline, F.lit("")), F.lit(shape), 1) for shape in CLUB_SHAPES]))


def clause_around(body: Column, position: Column, length: Column) -> Column:
    """The clause in which a mention stands (T9): 150 characters on both sides, cut at commas, spaced dashes and marks before it; behind it
    at commas and dashes, and at ? or ! if a direction cue stands between. Without a position, the whole text."""
    start = F.greatest(position - AROUND, F.lit(0))
    head = F.regexp_replace(F.substr(body, start + 1, position - start), r"(?s)^.*(?:[,?!]| (?=- ))", "")
    tail = F.substr(body, position + 1, length + AROUND)
    ends = [F.length(F.regexp_extract(tail, r"(?s)^(.*?)(?:,| - |\z)", 1))]
    for mark in "?!":
        at = F.locate(mark, tail)
        before = F.lower(F.substr(tail, F.lit(1), F.greatest(at - 1, F.lit(0))))
        cue = F.lit(False)
        for c in (*TO_CUES, *FROM_CUES):
            cue = cue | F.contains(before, F.lit(c))
        ends.append(F.when((at > 0) & cue, at - 1))
    return F.when(position.isNull() | (position < 0), body).otherwise(F.concat(head, F.substr(tail, F.lit(1), F.least(*ends))))


def departures(low: Column) -> tuple[Column, Column]:
    """Where the first "leave" and the first "quitte" stand in a lower-case text, from 1; 0 without one."""
    return F.regexp_instr(low, F.lit(r"\bleaves?\b")), F.regexp_instr(low, F.lit(r"\bquitte(nt)?\b"))


def direction_cues(body: Column, low: Column | None = None, leave: Column | None = None, quitte: Column | None = None) -> Column:
    """The slices of a text in which an origin or destination is looked for: array<struct<side, rank, slice>>.

    low, leave, quitte: the text in lower case and its departures(), if they are there already."""
    low = F.lower(body) if low is None else low
    leave, quitte = departures(low) if leave is None else (leave, quitte)

    def behind(at: Column, n: int) -> Column:
        return F.substr(body, at + n, F.lit(NEAR))

    origin = F.when(leave > 0, leave).otherwise(quitte)
    marker = F.when(leave > 0, F.lit(" for ")).otherwise(F.lit(" pour "))
    rest = F.substr(low, F.greatest(origin, F.lit(1)))
    apart = F.position(marker, rest) - 1
    paired = (origin > 0) & (apart >= 0) & (apart < APART)
    cue = lambda when, side, rank, part: F.when(when, F.struct(F.lit(side).alias("side"), F.lit(rank).alias("rank"), part.alias("slice")))
    found = [cue(paired, "from", 0, F.substr(body, origin, apart)), cue(paired, "to", 0, F.substr(body, origin + apart + F.length(marker), F.lit(NEAR)))]
    for side, cues in (("to", TO_CUES), ("from", FROM_CUES)):
        for k, word in enumerate(cues):
            at = F.locate(word, low)
            good = at > 0
            if word == " to ":
                good = good & ~F.rlike(behind(at, len(word)), F.lit(TO_VERB))
            if word == " from ":
                first = F.greatest(at - 20, F.lit(1))
                good = good & ~F.rlike(F.substr(low, first, at - first), F.lit(REPORTED))
            found.append(cue(good, side, k + 1, behind(at, len(word))))
    return F.array_compact(F.array(*found))


def resolve_directions(texts: DataFrame, clubs: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """(id, from_club, to_club, from_score, to_score, from_inferred) of every text with both sides known and different.

    texts: id, text. clubs: id, club, label, score: the labels of the clubs that each text names. The first cue whose slice names
    one of these clubs decides a side, within a slice the club that comes first. A slice that names none may be an inexact spelling (mentions.SPELT) of any
    club of the catalogue. With two clubs in play, the side without a cue is the other club.
    """
    told = once(texts.select("id", "text"), low=F.lower("text"))
    told = once(told, **dict(zip(("leave", "quitte"), departures(F.col("low")), strict=True)))
    cues = once(told, cues=direction_cues(F.col("text"), F.col("low"), F.col("leave"), F.col("quitte"))).select("id", F.explode("cues").alias("c")).select("id", "c.*")
    cues = once(cues, _alias=text.resolve_alias(F.col("slice"))).drop("slice")
    cues = cues.select("id", "side", "rank", F.concat(F.lit(" "), F.array_join(mentions._words(F.col("_alias")), " "), F.lit(" ")).alias("slice"))
    cues = materialise(cues, "cues")
    own = once(clubs.select(F.col("id").alias("_id"), "club", F.col("label").alias("_label"), "score"), label=F.array_join(mentions._words(F.col("_label")), " ")).drop("_label")
    at = F.position(F.concat(F.lit(" "), F.col("label"), F.lit(" ")), F.col("slice"))
    hits = cues.join(own, F.col("id") == F.col("_id")).withColumn("at", at).where("at > 0")
    if catalogue is not None:
        hits = materialise(hits.select("id", "side", "rank", "at", "label", "club", "score"), "slice-clubs")
        silent = cues.join(hits.select(F.col("id").alias("_h"), F.col("side").alias("_s"), F.col("rank").alias("_r")).distinct(), (F.col("id") == F.col("_h")) & (F.col("side") == F.col("_s")) & (F.col("rank") == F.col("_r")), "left_anti")
        silent = silent.withColumn("slice", F.trim("slice"))
        spelt = mentions.spelt_clubs(silent.select("slice"), "slice", catalogue).withColumnRenamed("slice", "_slice")
        far = silent.join(spelt, F.col("slice") == F.col("_slice")).select("id", "side", "rank", F.lit(1 << 20).alias("at"), "label", "club", "score")
        hits = hits.unionByName(far)
        told_by = hits.select(F.col("id"), "club", "label", "score").distinct()
        clubs = clubs.select("id", "club", "label", "score").unionByName(told_by)
    order = F.struct("rank", "at", (-F.length("label")).alias("l"), "club")
    side = lambda s: F.min_by("club", F.when(F.col("side") == s, order))
    told = hits.groupBy("id").agg(side("from").alias("f"), side("to").alias("t"))
    named = clubs.groupBy(F.col("id").alias("_n"), "club").agg(F.max("score").alias("score")).groupBy("_n").agg(F.collect_list(F.struct("club", "score")).alias("all"))
    rows = told.join(named, F.col("id") == F.col("_n"))
    two = F.size("all") == 2
    other = lambda c: F.when(two, F.get(F.filter("all", lambda x: x["club"] != F.col(c)), F.lit(0))["club"])
    score = lambda c: F.get(F.filter("all", lambda x: x["club"] == F.col(c)), F.lit(0))["score"]
    rows = rows.withColumn("from_inferred", F.col("f").isNull()).withColumns({"from_club": F.coalesce("f", other("t")), "to_club": F.coalesce("t", other("f"))})
    rows = rows.where(F.col("from_club").isNotNull() & F.col("to_club").isNotNull() & (F.col("from_club") != F.col("to_club")))
    return rows.select("id", "from_club", "to_club", score("from_club").alias("from_score"), score("to_club").alias("to_score"), "from_inferred")


def extract_known(signals: DataFrame, players: DataFrame, clubs: DataFrame, inexact: bool = False) -> DataFrame:
    """Moves of players in the catalogue (J1 to J4, T7 to T9). signals: id, text. inexact: slices that name no club are held against inexact spellings of all clubs."""
    found = mentions.drop_shadowed_mononyms(mentions.match_players(signals, players)).where("in_context")
    bodies = signals.dropDuplicates(["id"]).select(F.col("id").alias("_s"), F.col("text").alias("_t"))
    last = F.length(F.element_at(F.split("label", " "), -1))
    at = found.join(bodies, F.col("id") == F.col("_s")).withColumn("clause", clause_around(F.col("_t"), F.col("position"), last))
    clauses = at.groupBy(F.col("id").alias("text_id"), "player_id").agg(F.max("score").alias("player_score"), F.min_by("clause", "label").alias("text"))
    clauses = materialise(clauses.withColumn("id", F.monotonically_increasing_id()), "clauses")  # a number joins and sorts faster than a pair
    named = materialise(mentions.club_labels_in(clauses.select("id", "text"), clubs), "clause-clubs")
    several = named.groupBy(F.col("id").alias("_m")).agg(F.count_distinct("club").alias("n")).where("n > 1")
    named = named.join(several, F.col("id") == F.col("_m"), "left_semi")
    moves = resolve_directions(clauses.select("id", "text"), named, clubs if inexact else None)
    scores = clauses.select(F.col("id").alias("_c"), "text_id", "player_id", "player_score")
    moves = moves.join(scores, F.col("id") == F.col("_c"))
    names = players.dropDuplicates(["id"]).select(F.col("id").alias("_p"), F.col("name").alias("player_name"))
    out = moves.join(names, F.col("player_id") == F.col("_p"))
    mean = (F.col("player_score") + F.col("from_score") + F.col("to_score")) / 3
    return out.select(F.col("text_id").alias("id"), "player_id", "player_name", F.col("from_club"), "to_club", "from_inferred", mean.alias("confidence"), F.lit(False).alias("auto_created"))


def new_names(signals: DataFrame, matched: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """(id, name, confidence): names in headlines that neither the signal's moves nor the catalogue know.

    A fuzzy anti join: similarity of 0.80 to a player already matched there, 0.70 to any player or 0.65 to any club excludes a name.
    signals: id, headline. matched: id, player_name.
    """
    told = once(signals.dropDuplicates(["id"]).select("id", "headline"), names=candidate_names(F.col("headline"))).select("id", F.explode("names").alias("c")).select("id", "c.name", "c.confidence").where(F.col("confidence") >= NEW_NAME)
    told = materialise(told, "candidate-names")
    names = told.select("name").distinct()
    labels = mentions.club_labels(clubs).select("label").distinct()
    # Matched players are in the catalogue, so the bound of 0.70 covers theirs of 0.80 too.
    known = mentions.similar_names(names, players.select(F.col("name").alias("label")), KNOWN_PLAYER).select("name").unionByName(mentions.similar_names(names, labels, KNOWN_CLUB).select("name"))
    gone = matched.select(F.col("id").alias("_i"), text.normalise(F.col("player_name")).alias("_n"))
    fresh = told.join(known.distinct(), "name", "left_anti")
    return fresh.join(gone, (F.col("id") == F.col("_i")) & (text.normalise(F.col("name")) == F.col("_n")), "left_anti").select("id", "name", "confidence")


def extract_new(signals: DataFrame, matched: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """Moves of players that the catalogue lacks, also between clubs that it lacks (J5). signals: id, headline.

    Where a headline names fewer than two known clubs, texts with a club's shape that resemble none (0.70) stand for new clubs.
    """
    fresh = materialise(new_names(signals, matched, players, clubs), "new-names")
    heads = signals.dropDuplicates(["id"]).join(fresh.select(F.col("id").alias("_f")).distinct(), F.col("id") == F.col("_f"), "left_semi").select("id", F.col("headline").alias("text"))
    named = materialise(mentions.club_labels_in(heads, clubs), "headline-clubs")
    enough = named.groupBy(F.col("id").alias("_e")).agg(F.count_distinct("club").alias("n")).where("n > 1")
    shaped = heads.join(enough, F.col("id") == F.col("_e"), "left_anti").select("id", F.explode(club_candidates(F.col("text"))).alias("name"))
    shaped = materialise(shaped, "shaped-clubs")
    close = mentions.similar_names(shaped.select("name").distinct(), mentions.club_labels(clubs).select("label").distinct(), NEW_CLUB)
    new = shaped.join(close.select("name").distinct(), "name", "left_anti")
    found = named.unionByName(new.select("id", F.struct(F.lit(None).cast(clubs.schema["id"].dataType).alias("id"), F.col("name")).alias("club"), F.col("name").alias("label"), F.lit(0.90).alias("score")))
    several = found.groupBy(F.col("id").alias("_m")).agg(F.count_distinct("club").alias("n")).where("n > 1")
    moves = resolve_directions(heads, found.join(several, F.col("id") == F.col("_m"), "left_semi"))
    out = moves.join(fresh.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
    return out.select("id", F.lit(None).cast(players.schema["id"].dataType).alias("player_id"), F.col("name").alias("player_name"), "from_club", "to_club", "from_inferred", "confidence", F.lit(True).alias("auto_created"))


def extract_rumours(signals: DataFrame, players: DataFrame, clubs: DataFrame, inexact: bool = False) -> DataFrame:
    """One row per (id, player, from, to) that a signal tells (J6): known players first, then new names of the headline.

    signals: id, headline, summary; players: id, name; clubs: id, name, short_name. New players and clubs have a null id. Null headlines and
    summaries are empty. Clubs are found by whole words. Of inexact spellings those of new names and clubs are weighed, and with `inexact` those behind a
    direction cue, which costs much more (see README).
    """
    rows = signals.select("id", F.coalesce("headline", F.lit("")).alias("headline"), F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit(""))).alias("text"))
    known = materialise(extract_known(rows.select("id", "text"), players, clubs, inexact), "known-moves")
    both = known.unionByName(extract_new(rows.select("id", "headline"), known, players, clubs))
    return both.select("id", "player_id", "player_name", F.col("from_club.id").alias("from_club_id"), F.col("from_club.name").alias("from_club"), F.col("to_club.id").alias("to_club_id"), F.col("to_club.name").alias("to_club"), "from_inferred", "confidence", "auto_created")
