"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_or_shuffled

#: Runs of white space that are not one space already.
SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Narrow rows (a row number, the id, the digest, the SHA-256) are written once and grouped, combined before the shuffle. Only texts
    whose digest occurs at least twice are then read again and grouped by their bytes, again combined before the shuffle, so a
    text that fills a third of the table reaches it once per task. Texts that share a digest differ in their SHA-256, which is part
    of the group's key; should two texts ever share both, the bytes show it and the query stops rather than merge them.
    A large group's side of the join back is split by AQE.

    Null text counts as empty, an empty table gives an empty result; a null id is kept only if its whole group has no
    id. Exactly one row of a group is kept: of rows that repeat the smallest id, the first one written. Other columns,
    whatever their names, are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest("norm").alias("digest"), F.sha2("norm", 256).alias("text_sha256"))
    keyed = materialise(keyed, "exact-keys")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = keyed.groupBy(F.col("digest").alias("_digest"), F.col("text_sha256").alias("_sha")).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "exact-groups")
    repeated = small_or_shuffled(groups.where("group_size > 1").select("_digest").distinct())
    suspects = texts.select("norm", digest("norm").alias("digest")).join(repeated, F.col("digest") == F.col("_digest"), "left_semi")
    same = suspects.groupBy("digest", "norm").count().groupBy("digest", F.sha2("norm", 256).alias("sha")).count()
    if not same.where("count > 1").isEmpty():
        raise ValueError("different texts share their digest and their SHA-256")
    return keyed.join(groups, (F.col("digest") == F.col("_digest")) & (F.col("text_sha256") == F.col("_sha"))).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )
