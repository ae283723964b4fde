"""Line dedup: segment-partition edit join over the distinct lines of a corpus, DataFrame functions only.

A line is compared in a normal form (lower case, white space squeezed). Two lines are copies if their normal forms agree, and
near copies if their edit distance is at most `edits` and at most the share 1 - `similarity` of the shorter one's length. A line is
dropped if a copy or near copy of it comes earlier in (doc_id, row, position) order; blank lines stay. The row
is a number of its own for each input row, as ids may be null or repeat.

For k edits a line is cut into k + 1 even segments. Two lines within k edits have an alignment in which some segment i of the shorter
(or equally long) line, counted from 0, stands unchanged in the other with exactly i edits before and at most k - i after it. So its place there is
shifted by at most i, and by at most k - i from the difference of the lengths. Every line posts its own segments and, for each length from its
own down to k less, the substrings at those places (k = 1: four keys a line whatever its length, k = 2: twelve). Lines that share a key with few others
are paired and verified with the banded `levenshtein`.

A crowded key (a segment that many lines share) is not joined with itself: what it leaves open, the parts on its two sides with a mark
between them, is within k edits too, and is cut into segments in its turn, under the key so far, until a key is no longer crowded or the
open part is a few characters. Those post their forms: strings with exactly k wild cards, each for one character or none, set in all ways. Two
open parts are within k edits if and only if they share a form, so all lines of a form are near copies of each other and the earliest decides:
a group of any size costs rows in proportion to its lines and never its pairs. With k = 1 an open part is half as long at each step; with more edits
it shrinks more slowly and has more segments, so crowded keys cost far more: the pipeline uses 1. The marks between parts are not edited, so a distance found in the open part
is one of the whole lines.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, small_or_shuffled

#: Edits that near copies may differ by, and the similarity that they keep.
EDITS, SIMILARITY = 1, 0.8
#: Lines on one key up to which pairs are verified one by one.
CROWD = 16
#: Characters of an open part from which it is not cut again.
OPEN = 8
#: Rows of a (key, count) table up to which it is broadcast: 16 bytes each.
KEYS = 1_000_000
#: A wild card, the mark between two open parts, and what stands for either in a text.
WILD, MARK, OTHER = "\x01", "\x02", "\x03"


def normal_line(line: Column) -> Column:
    odd = F.contains(line, F.lit("  "))
    for space in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(space))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def allowed(n: Column, edits: int, similarity: float) -> Column:
    """Edits that a line of n characters may have."""
    return F.least(F.lit(edits), F.floor(n * F.lit(round(1 - similarity, 9)) + 1e-9).cast("int"))


def segments(rest: Column, group: Column, edits: int) -> list[tuple[Column, bool, Column, Column]]:
    """Key, own or probe, open length and open part of a line's (or open part's) posts; key is null where a place does not exist.

    The open length is that of the posts which own the segment, so it is the same for all posts of a key.
    """
    n, found = F.length(rest), []
    for less in range(edits + 1):
        size = n - less
        for i in range(edits + 1):
            first, end = (F.floor(size * j / (edits + 1)).cast("int") for j in (i, i + 1))
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                start, length = first + shift, end - first
                there = (start >= 0) & (start + length <= n) & (size > edits)
                key = F.when(there, F.xxhash64(group, size, F.lit(i), F.substring(rest, start + 1, length)))
                still = F.concat(F.substring(rest, F.lit(1), start), F.lit(MARK), F.substring(rest, start + length + 1, n))
                found.append((key, less == 0 and shift == 0, F.length(still) - less, still))
    return found


def keys_of(plain: Column, edits: int) -> Column:
    return F.array(*[key for key, _, _, _ in segments(plain, F.lit(0), edits)])


def posts_of(rest: Column, group: Column, edits: int) -> Column:
    return F.array(*[F.struct(key.alias("key"), F.lit(own).alias("own"), size.alias("open"), still.alias("rest")) for key, own, size, still in segments(rest, group, edits)])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, as the output of a generator: an expression that later ones use many times is not merged into each of them."""
    kept = df.columns
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _plain(norm: Column) -> Column:
    """Texts that hold the wild card or the mark themselves get a stand-in; the two count as equal there."""
    return F.translate(norm, WILD + MARK, OTHER * 2)


def forms(rest: Column, count: int) -> Column:
    """All strings with `count` wild cards that the open part matches: each is put in place of a character or between two."""

    def one_more(text: Column) -> Column:
        n = F.length(text)
        before = lambda j: F.concat(F.substring(text, F.lit(1), j - 1), F.lit(WILD))
        between = F.transform(F.sequence(F.lit(1), n + 1), lambda j: F.concat(before(j), F.substring(text, j, n)))
        places = F.filter(F.sequence(F.lit(0), n), lambda j: (j > 0) & ~F.substring(text, j, F.lit(1)).isin(WILD, MARK))
        return F.concat(between, F.transform(places, lambda j: F.concat(before(j), F.substring(text, j + 1, n))))

    found = F.array(rest)
    for _ in range(count):
        found = F.array_distinct(F.flatten(F.transform(found, one_more)))
    return found


def line_table(docs: DataFrame, id_col: str, text_col: str, edits: int, similarity: float) -> DataFrame:
    """doc_id, row, pos, 128-bit identity (h1, h2) and keys of every line that is not blank. docs: from numbered()."""
    text = F.coalesce(F.col("doc")[text_col].cast("string"), F.lit(""))
    lines = docs.select(F.col("doc")[id_col].alias("doc_id"), "row", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = once(lines, norm=normal_line(F.col("line"))).where("norm <> ''").drop("line")
    lines = once(lines, plain=_plain(F.col("norm")))
    keys = F.when(allowed(F.length("norm"), edits, similarity) > 0, keys_of(F.col("plain"), edits))
    return materialise(lines.select("doc_id", "row", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("line"), "norm").alias("h2"), keys.alias("keys")), "lines")


def crowds(posts: DataFrame) -> DataFrame:
    """(_key, lines) of the keys with two posts or more; combined before the shuffle."""
    counts = posts.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    return small_or_shuffled(materialise(counts, "line-keys"), KEYS)


def texts_at(docs: DataFrame, firsts: DataFrame, text_col: str) -> DataFrame:
    """firsts (h1, h2, first) with `norm`, the line that stands there."""
    wanted = materialise(firsts.groupBy(F.col("first.row").alias("_row")).agg(F.collect_list(F.struct("h1", "h2", "first")).alias("_wanted")), "line-places")
    parts = docs.join(small_or_shuffled(wanted), F.col("row") == F.col("_row")).select(F.split(F.col("doc")[text_col].cast("string"), "\n").alias("parts"), F.explode("_wanted").alias("w"))
    return parts.select("w.*", normal_line(F.col("parts")[F.col("w.first.pos")]).alias("norm"))


def _from_pairs(flagged: DataFrame, texts: DataFrame, edits: int, similarity: float) -> DataFrame:
    """Lines (h1, h2) with an earlier near copy, from keys with few lines: each pair is verified once."""
    a, b = flagged.alias("a"), flagged.alias("b")
    later = F.struct("a.first", "a.h1", "a.h2") > F.struct("b.first", "b.h1", "b.h2")
    near = F.abs(F.col("a.n") - F.col("b.n")) <= edits
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.own") | F.col("b.own")) & later & near)
    pairs = pairs.select(F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"), F.col("b.h1").alias("_h1"), F.col("b.h2").alias("_h2")).distinct()
    left, right = (texts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("norm").alias(f"{x}_norm")) for x in ("l", "r"))
    pairs = pairs.join(left, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2"))).join(right, (F.col("_h1") == F.col("r1")) & (F.col("_h2") == F.col("r2")))
    most = allowed(F.least(F.length("l_norm"), F.length("r_norm")), edits, similarity)
    return pairs.where(F.levenshtein(F.col("l_norm"), F.col("r_norm"), edits).between(F.lit(0), most)).select("h1", "h2")


def _from_forms(flagged: DataFrame, edits: int, similarity: float) -> DataFrame:
    """The same from crowded keys with short open parts. A line takes part with as many wild cards as a partner of like length may have."""
    most, least = allowed(F.col("n"), edits, similarity), allowed(F.col("n") - edits, edits, similarity)
    every = []
    for count in range(1, edits + 1):
        able = flagged.where((most >= count) & (F.greatest(least, F.lit(1)) <= count))
        every.append(able.select("key", F.lit(count).alias("count"), F.struct("first", "h1", "h2").alias("line"), F.explode(forms(F.col("rest"), count)).alias("form")))
    posts = functools.reduce(DataFrame.unionByName, every)
    best = posts.groupBy(F.col("key").alias("_key"), F.col("count").alias("_count"), F.col("form").alias("_form")).agg(F.min("line").alias("best"), F.count(F.lit(1)).alias("posts")).where("posts > 1")
    same = (F.col("key") == F.col("_key")) & (F.col("count") == F.col("_count")) & (F.col("form") == F.col("_form"))
    return posts.join(best, same).where(F.col("line") > F.col("best")).select("line.h1", "line.h2")


def near_lines(firsts: DataFrame, docs: DataFrame, text_col: str = "text", edits: int = EDITS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier near copy. firsts: a written table of h1, h2, first, keys."""
    posts = firsts.where("keys is not null").select("h1", "h2", F.explode("keys").alias("key")).where("key is not null")
    crowded = crowds(posts)
    shared = posts.join(crowded, F.col("key") == F.col("_key")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    found = firsts.select("h1", "h2", "first").join(shared, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left_semi")
    texts = materialise(texts_at(docs, found, text_col), "line-texts")
    flagged = once(texts.select("h1", "h2", "first", "norm"), n=F.length("norm"), plain=_plain(F.col("norm")))
    flagged = flagged.select("h1", "h2", "first", "n", F.inline(posts_of(F.col("plain"), F.lit(0), edits))).where("key is not null")
    near = []
    while True:
        flagged = materialise(flagged.join(crowded, F.col("key") == F.col("_key")).drop("_key"), "line-flagged")
        near.append(materialise(_from_pairs(flagged.where(F.col("lines") <= crowd), texts, edits, similarity), "line-near"))
        many = flagged.where(F.col("lines") > crowd)
        if many.isEmpty():
            break
        near.append(materialise(_from_forms(many.where(F.col("open") <= OPEN), edits, similarity), "line-near"))
        wide = many.where(F.col("open") > OPEN)
        if wide.isEmpty():
            break
        flagged = wide.select("h1", "h2", "first", "n", F.inline(posts_of(F.col("rest"), F.col("key"), edits))).where("key is not null")
        flagged = materialise(flagged, "line-open")
        crowded = crowds(flagged)
    return functools.reduce(DataFrame.unionByName, near).distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """row and the positions of its dropped lines, for rows that lose any. docs: from numbered()."""
    lines = line_table(docs, id_col, text_col, edits, similarity)
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("times"), F.first("keys").alias("keys"))
    firsts = materialise(firsts, "line-firsts")
    near = near_lines(firsts, docs, text_col, edits, similarity, crowd).withColumn("near", F.lit(True))
    marked = firsts.join(near, ["h1", "h2"], "left").where("times > 1 or near")
    marked = materialise(marked.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", F.coalesce("near", F.lit(False)).alias("near")), "line-marks")
    here = lines.select("doc_id", "row", "pos", "h1", "h2").join(small_or_shuffled(marked), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    lost = here.where(F.col("near") | ~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("first")))
    return lost.groupBy("row").agg(F.collect_set("pos").alias("dropped"))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """doc (the input row), text (freed of repeated lines), n_lines, n_dropped: one row per input row.

    Null texts stay null and empty texts empty; a text may become empty, its row stays. Rows that repeat an id are documents of
    their own, in the order of the input; null ids sort first. Very long texts and lines are treated like any other. An empty table
    gives an empty result. Columns of the input may have any names: they travel inside `doc`.
    """
    docs = numbered(docs, "line-rows")
    lost = dropped_lines(docs, id_col, text_col, edits, similarity, crowd).select(F.col("row").alias("_row"), "dropped")
    whole = F.col("doc")[text_col].cast("string")
    parts = F.split(whole, "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("dropped", i)), "\n")
    return docs.join(lost, F.col("row") == F.col("_row"), "left").select(
        "doc",
        F.when(F.col("dropped").isNull(), whole).otherwise(kept).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """The table with its texts freed of repeated lines; see dedup_rows()."""
    rows = dedup_rows(docs, id_col, text_col, edits, similarity, crowd)
    return rows.select(*[(F.col("text") if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
