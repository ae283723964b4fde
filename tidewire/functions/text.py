"""Column functions over headlines, names and article text; all JVM expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mark transfer news.
TRANSFER_WORDS = ("transfer", "sign", "signing", "bid", "offer", "deal", "move", "loan", "fee", "rumour", "rumor", "target", "linked", "interest", "approach", "negotiate", "contract", "here we go", "medical", "agreed", "swap", "sell", "buy", "complete", "mercato")
WINTER_WORDS = ("winter", "january")
SUMMER_WORDS = ("summer", "july", "august", "june")

# Patterns of a completed and of a failed transfer.
COMPLETED = (
    r"here we go[!?]*",
    r"\btransfer confirmed\b",
    r"\bdeal confirmed\b",
    r"\bsigning confirmed\b",
    r"\bpass(es|ed)? medical\b",
    r"\bofficial(ly)? (sign(s|ed)?|join(s|ed)?|complet(es|ed)?)\b",
    r"\bcomplete(s|d)? (the |his |her )?move\b",
    r"\bjoins? on (a |an )?[0-9]+[-−]year (deal|contract)\b",
    r"\bannounced (as|as a new)\b",
    r"\b(clubs?) (have |has )?confirmed (the |a )?signing\b",
)
FAILED = (
    r"\bdeal (has |is )?(fallen?|collapsed?|off|dead)\b",
    r"\btransfer (fallen?|collapsed?|fail(s|ed)?|off)\b",
    r"\bnot (happening|going ahead|joining)\b",
    r"\bsaga (is |has )?(over|ended?)\b",
    r"\bdeni(es|ed) (interest|links?|move|transfer)\b",
    r"\bno deal\b",
    r"\bfell? through\b",
    r"\bcall(s|ed)? off (the |a )?(deal|transfer|move)\b",
)

# Club nicknames.
CLUB_ALIASES = {
    "man city": "Manchester City",
    "man utd": "Manchester United",
    "man united": "Manchester United",
    "spurs": "Tottenham",
    "barca": "FC Barcelona",
    "bvb": "Borussia Dortmund",
    "inter": "Inter Milan",
    "psv": "PSV Eindhoven",
    "ajax": "Ajax",
    "wolves": "Wolverhampton",
    "villa": "Aston Villa",
    "newcastle": "Newcastle United",
    "west ham": "West Ham United",
    "chelski": "Chelsea",
    "arsenal": "Arsenal",
    "liverpool": "Liverpool",
}

# Provider position ids.
POSITIONS = {24: "GK", 148: "CB", 149: "CDM", 150: "CAM", 151: "ST", 152: "LW", 153: "CM", 154: "RB", 155: "LB", 156: "RW", 157: "LM", 158: "RM", 163: "CF"}

# Fixed value: the phrases before a cited name, and the name.
CITATION = r"\b(?:according to|as (?:first )?reported by|as per|per|citing|via)\s+([A-Z][\w'.-]*(?:\s+[A-Z][\w'.-]*){0,3})"

# Fixed value: words that make a mention a transfer mention.
CONTEXT = r"\b(transfer|sign(?:s|ed)? for|joins?|joined|joining|moves? to|moved to|deal|bid|target(?:ed|s)?|linked|rumou?r|loan|medical|hijack|swoop|agreement|agrees? (?:a )?deal|chase(?:s|d)?|keen on|interested in|approach(?:ed)?)\b"


def _any_contains(text: Column, words) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def is_transfer_related(title: Column, summary: Column) -> Column:
    """Whether title or summary hold a transfer word anywhere, also inside other words (F1)."""
    return _any_contains(F.lower(F.concat_ws(" ", title, summary)), TRANSFER_WORDS)


def guess_window_from_date(date: Column) -> Column:
    """SUMMER for June to August, else WINTER."""
    return F.when(F.month(date).between(6, 8), "SUMMER").otherwise("WINTER")


def guess_window_from_text(text: Column, now: Column) -> Column:
    """The window that a text names, else the one of `now` (F2)."""
    low = F.lower(text)
    return F.when(_any_contains(low, WINTER_WORDS), "WINTER").when(_any_contains(low, SUMMER_WORDS), "SUMMER").otherwise(guess_window_from_date(now))


def implied_reliability(title: Column) -> Column:
    """1 for "tier 1" down by 0.2 a tier, within 0 and 1; null without a tier."""
    tier = F.nullif(F.regexp_extract(title, r"(?i)tier\s*(\d)", 1), F.lit("")).cast("double")
    return F.when(tier.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (tier - 1) * 0.2)))


def detect_outcome(text: Column) -> Column:
    """COMPLETED, FAILED or null; completion wins."""
    return F.when(F.rlike(text, F.lit("(?i)" + "|".join(COMPLETED))), "COMPLETED").when(F.rlike(text, F.lit("(?i)" + "|".join(FAILED))), "FAILED")


@functools.cache
def _accents() -> tuple[str, str]:
    """Latin letters that decompose into a plain letter and marks, and the plain letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    pairs += [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x1E00, 0x1F00) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(s: Column) -> Column:
    """Lower case without combining marks, for Latin script."""
    source, target = _accents()
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.lower(F.regexp_replace(F.translate(s, source, target), "[̀-ͯ]", "")))  # of one byte a character: no marks


def normalise(s: Column) -> Column:
    """Folded, with every character outside a-z, 0-9 and space deleted, trimmed."""
    return F.trim(F.regexp_replace(fold_accents(s), "[^a-z0-9 ]", ""))


def contains_whole_token(hay: Column, needle: Column) -> Column:
    """Whether the needle stands in the text between white space or its ends; an empty needle never does."""
    pad = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"\s", " "), F.lit(" "))
    return (needle != "") & F.contains(pad(hay), pad(needle))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.92 if one holds the other as whole tokens, else 1 - edit distance / longer length, normalised."""
    x, y = normalise(a), normalise(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when(contains_whole_token(x, y) | contains_whole_token(y, x), 0.92).otherwise(1 - F.levenshtein(x, y) / longer)


def resolve_alias(s: Column) -> Column:
    """The full club name of a nickname, else the text itself (T4)."""
    names = F.create_map(*[F.lit(x) for pair in CLUB_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, normalise(s)), s)


def map_position(position_id: Column) -> Column:
    """The position of a provider id, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair]), position_id.cast("int"))


def age_from_birth(born: Column, now: Column) -> Column:
    """Years between the calendar years; null if there is no year."""
    year = F.regexp_extract(born, r"^[+-]?(\d{4})", 1)
    return F.when(year != "", F.year(now) - F.nullif(year, F.lit("")).cast("int"))


def transfer_context_near(text: Column, position: Column, radius: int = 60) -> Column:
    """Whether transfer vocabulary stands within `radius` of a mention (from 0); true if its place is unknown."""
    start = F.greatest(position - radius, F.lit(0))
    window = F.substring(text, start + 1, position + radius - start)
    return position.isNull() | (position < 0) | F.rlike(window, F.lit("(?i)" + CONTEXT))


def tokens(s: Column) -> Column:
    """Distinct lower-case tokens; every character outside a-z, 0-9 and white space separates."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(s), r"[^a-z0-9\s]", " "), r"\s+")), "")


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard of token sets; two empty texts are alike, one empty text is not."""
    x, y = tokens(a), tokens(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(both / F.when(either == 0, 1).otherwise(either))


def cited_name(text: Column) -> Column:
    """The first name cited by "according to", "via" and the like, up to four capitalised words; else null."""
    return F.nullif(F.trim(F.regexp_extract(text, CITATION, 1)), F.lit(""))


def source_key(name: Column) -> Column:
    """Source names as they are compared: lower case, other characters as spaces, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalise_club_name(s: Column) -> Column:
    """Lower case, - . , ' and its variants as spaces, squeezed; accents stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), "[-.,'’`]", " "), r"\s+", " "))


def json_number(c: Column) -> Column:
    """A double as JSON writes it: 45, 0.5, 0.00025; exponents only beyond 1e21 and below 1e-6. Null is null."""
    text = c.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(F.abs(c).cast("string"), "E", 1), r"\.0$", ""), r"\.", "")
    power = -F.substring_index(text, "E", -1).cast("int")
    small = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), power - 1), digits)
    large = F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    tiny = (F.abs(c) < 1e-3) & (F.abs(c) >= 1e-6)
    return F.when(c.isNull(), "null").when(whole, F.floor(c).cast("long").cast("string")).when(tiny, small).when(F.abs(c) >= 1e7, large).otherwise(text)


def feature_hash(claim_id: Column, as_of: Column, features: dict[str, Column]) -> Column:
    """SHA-256 over the JSON of claimId, asOf (ISO, UTC) and the features with sorted keys."""
    at = F.date_format(F.to_utc_timestamp(as_of.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), json_number(features[k].cast("double"))) for k in sorted(features)])
    return F.sha2(F.concat(F.lit('{"claimId":'), claim_id.cast("string"), F.lit(',"asOf":"'), at, F.lit('","features":{'), pairs, F.lit("}}")), 256)


def fee_label(low: Column, high: Column) -> Column:
    """Undisclosed, one amount, or a range."""
    plain = lambda c: F.regexp_replace(F.format_string("%.1f", c), r"\.0$", "")
    return F.when(low.isNull() & high.isNull(), "Undisclosed").when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(F.lit("€"), plain(low), F.lit("–"), plain(high), F.lit("M"))).otherwise(F.concat(F.lit("€"), plain(F.coalesce(low, high)), F.lit("M")))
