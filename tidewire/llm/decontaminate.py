"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is WINDOW consecutive words of an item (a shorter item is one window), seen as the set of its SHINGLE-word shingles (a window of
fewer words is one shingle). Shingles are ordered by rarity in the documents. A document holds a window only if it holds all of its
shingles, so at containment 1 the prefix that has to meet is the one rarest shingle; windows with a shingle that no document has are
out. Where it meets, its place in the window fixes where the window would lie: it has to lie within the document (length and
position), and its words are compared with the document's.

One pass over the texts emits what a filter of fixed size lets through: place, hash and the words around each shingle of the benchmark, an amount
that follows the overlap, not the corpus. Documents without any are answered from that pass alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, mix, spans, text_chunks, word_hashes

WINDOW, SHINGLE = 10, 5
#: Bits of the filter over the benchmark's shingles: 16 MB whatever the benchmark. A full filter lets more through, and loses nothing.
FILTER_BITS = 1 << 27
#: Bytes that are no part of a word, after lower-casing: all ASCII but digits and letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[48:58] = BETWEEN[97:123] = False


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for every `width` consecutive word hashes, the width included."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(out)


def told(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    return " ".join(data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, win (its words, joined by a space), n, shingles (hashes in order): a row for each window of each item."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for first, data, offsets in text_chunks(batch.column(1), lower=True):
                starts, ends, text = spans(data, offsets, BETWEEN)
                hashes = word_hashes(data, starts, ends)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    n = min(window, hi - lo)
                    if not n:
                        continue
                    of = shingle_hashes(hashes[lo:hi], min(shingle, n)).view(np.int64)
                    per = n - min(shingle, n) + 1
                    item = batch.column(0)[first + i].as_py()
                    out += [(item, told(data, starts[a : a + n], ends[a : a + n]), n, of[a - lo : a - lo + per].tolist()) for a in range(lo, hi - n + 1)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["item", "win", "n", "shingles"])

    return items.mapInArrow(run, "item string, win string, n int, shingles array<long>")


def bit_filter(shingles: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each hash of the column `hash`, as bytes; at most bits / 8 of them reach the driver."""
    at = F.pmod("hash", F.lit(bits)) + 1  # buckets and places of Spark's bitmaps count from 1
    found = shingles.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    width = 4096
    out = np.zeros(bits // 8, np.uint8)
    for r in found:
        out[(r["b"] - 1) * width : r["b"] * width] = np.frombuffer(r["m"], np.uint8)
    return out


def occurrences(docs: DataFrame, bits: np.ndarray, widths: list[int], window: int, shingle: int, size: int) -> DataFrame:
    """row, doc_id, n_words and, for each shingle in the filter: its place, hash, the words around it and the place of the first of these."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            words, counts, occ = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for first, data, offsets in text_chunks(batch.column(2), lower=True):
                starts, ends, text = spans(data, offsets, BETWEEN)
                hashes = word_hashes(data, starts, ends)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                words[first : first + len(offsets) - 1] = np.diff(bounds)
                met = []
                for width in widths:
                    got = shingle_hashes(hashes, width)
                    at = got % np.uint64(size)
                    inside = text[: len(got)] == text[width - 1 :] if len(got) else np.zeros(0, bool)
                    hit = np.flatnonzero((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & inside)
                    met.append((hit, got[hit]))
                place = np.concatenate([m[0] for m in met]) if met else np.zeros(0, np.int64)
                what = np.concatenate([m[1] for m in met]) if met else np.zeros(0, np.uint64)
                order = np.lexsort((what, place))
                for i, h in zip(place[order].tolist(), what[order].view(np.int64).tolist(), strict=True):
                    lo, hi = int(bounds[text[i]]), int(bounds[text[i] + 1])
                    a, b = max(lo, i - (window - 1)), min(hi, i + window)
                    occ.append((i - lo, h, told(data, starts[a:b], ends[a:b]), a - lo))
                counts[first : first + len(offsets) - 1] = np.bincount(text[place], minlength=len(offsets) - 1) if len(place) else 0
            values = pa.StructArray.from_arrays([pa.array([o[k] for o in occ], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.int32()))], ["pos", "hash", "around", "first"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), lists], ["row", "doc_id", "n_words", "occ"])

    return docs.mapInArrow(run, f"row long, doc_id {kind}, n_words long, occ array<struct<pos: int, hash: long, around: string, first: int>>")


def postings(windows: DataFrame, occ: DataFrame) -> DataFrame:
    """hash, at (its place in the window), win, n: every window that may occur, under its rarest shingle."""
    seen = occ.groupBy("hash").agg(F.count(F.lit(1)).alias("rarity"))
    each = windows.select("win", "n", F.posexplode("shingles").alias("at", "hash"))
    ranked = each.join(seen, "hash", "left").groupBy("win", "n").agg(F.min(F.struct("rarity", "hash", "at")).alias("p"), F.count_if(F.col("rarity").isNull()).alias("absent"))
    return ranked.where("absent = 0").select("p.hash", "p.at", "win", "n")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of `docs`; and with hits() where they lie.

    A null text has no words, in documents and items. Rows that repeat a doc_id (or have none) are documents of their own. Rows that
    repeat an item_id are one item; a null item_id is an item with an empty name. Equal windows of several items count for each. Texts may have any length, and
    either table may be empty. Other columns, whatever their names, are not read.
    """
    found = hits(docs, items, window, shingle, filter_bits)
    scanned, placed, members = found["scanned"], found["hits"], found["members"]
    until = F.max("until").over(Window.partitionBy("row").orderBy("start", "until").rowsBetween(Window.unboundedPreceding, -1))
    covered = placed.select("row", "start", "until").withColumn("before", until)
    # one document's hits: a running maximum of ends over its own words
    covered = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("until") - F.greatest("start", F.coalesce("before", F.lit(0))))).alias("n_hit"))
    # windows with the same items are one class, documents with the same classes one signature: items are listed once for each
    sets = members.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("item", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    classes = materialise(sets.withColumn("class", F.min("win").over(Window.partitionBy("n", "a", "b"))).select("win", "class"), "leak-classes")
    signed = placed.select("row", "win").join(classes, "win").groupBy("row").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    signed = materialise(signed.withColumn("sign", F.sha2(F.to_json("classes"), 256)), "leak-signs")
    listed = signed.dropDuplicates(["sign"]).select("sign", F.explode("classes").alias("win")).join(members, "win").groupBy("sign").agg(F.collect_set("item").alias("items"))
    listed = listed.select("sign", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"))
    of = signed.select("row", "sign").join(listed, "sign").join(covered, "row").select(F.col("row").alias("_row"), "n_hit", "n_items", "items_sha256")
    met = scanned.where(F.size("occ") > 0).select("row", "doc_id", "n_words")
    met = met.join(of, F.col("row") == F.col("_row"), "left").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    clean = scanned.where(F.size("occ") == 0).select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = met.unionByName(clean)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> dict[str, DataFrame]:
    """scanned: a row a document; hits: row, start and until (words), win; members: win and the items that have it."""
    if not 1 <= shingle <= window:
        raise ValueError("a shingle has 1 to `window` words")
    if filter_bits < 32768 or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits is a power of two from 32,768 on")
    text = lambda t, key: t.select(F.col(f"`{key}`"), F.col("`text`").cast("string"))
    named = text(items, "item_id").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    each = materialise(item_windows(named, window, shingle), "leak-windows")
    members = materialise(each.select("win", "item").distinct(), "leak-members")
    windows = materialise(each.dropDuplicates(["win"]).select("win", "n", "shingles"), "leak-distinct")
    widths = [r["w"] for r in windows.select(F.least("n", F.lit(shingle)).alias("w")).distinct().collect()]  # at most `shingle` rows
    bits = bit_filter(windows.select(F.explode("shingles").alias("hash")), filter_bits)
    rows = text(docs, "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scanned = materialise(occurrences(rows, bits, sorted(widths), window, shingle, filter_bits), "leak-scan")
    occ = scanned.where(F.size("occ") > 0).select("row", "n_words", F.explode("occ").alias("o")).select("row", "n_words", "o.*")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("n")), " ") == F.col("win")
    met = occ.join(postings(windows, occ), "hash").where(fits).where(same)
    return {"scanned": scanned, "members": members, "hits": materialise(met.select("row", start.alias("start"), (start + F.col("n")).alias("until"), "win"), "leak-hits")}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql(window: int = WINDOW) -> str:
    """The same in DuckDB SQL: every window of every length against every window of the items."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    ahead = ", ".join(["w", *[f"lead(w, {i}) OVER (PARTITION BY r ORDER BY pos)" for i in range(1, window)]])
    return f"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
    i AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT *, least({window}, len(w)) AS n, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
    p AS MATERIALIZED (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d), l AS MATERIALIZED (SELECT r, pos, [{ahead}] AS a FROM p),
    o AS MATERIALIZED (SELECT r, pos, n, item FROM (SELECT r, pos, n, array_to_string(a[1:n], ' ') AS win FROM l, (SELECT DISTINCT n FROM i) WHERE a[n] IS NOT NULL) JOIN i USING (n, win)),
    h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS k FROM o) GROUP BY 1), t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY 1)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
