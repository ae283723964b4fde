"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within distance 4 have a common point within distance 2 of both. Emitting all 2,081 points of every
ball costs 33 kB a fingerprint, many times the documents. So the balls come in two tiers, both exact:

1. Of the two 32-bit halves, one has at most 2 differing bits. Every fingerprint emits, for each half, the 33 words
   within half that radius; rows meet on (half, word). A word with two fingerprints is a pair: it is verified.
2. Where three or more fingerprints meet on a word, their number has no bound, and all pairs would grow with its
   square. These fingerprints alone emit their whole balls of radius 2. Two that meet there are within distance 4 by
   the triangle inequality, so linking neighbours in sorted order joins all of them: as many links as rows.

Any linked pair meets on a half word; that word holds two fingerprints (tier 1) or more (both take part in tier 2).

Where it turns: of N distinct random fingerprints, a half word holds 33 N / 2^32 on average, so from about 1e8 on most words hold two or
more and nearly every fingerprint sends its whole ball, 33 kB, as plain ball hashing does from the first. Below, the second tier is
small. A half word's window streams its rows in order; a word holds the fingerprints within one bit of it, at most 33 x 2^32 of the other half.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, numbered, spread

SHINGLE = 4
RADIUS = 4
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all word shingles of a lower-cased UTF-8 text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - width + 1)
    cuts = map(slice, starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    while True:
        block = np.fromiter((digest(line[c], 42) for c in itertools.islice(cuts, 50_000)), "<u8")
        if not len(block):
            break
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[2 * counts > last].sum())


def fingerprints(rows: DataFrame) -> DataFrame:
    """row, doc_id and fp, the fingerprint as a signed long, of a table of row, doc_id, text; null text is empty, and an empty text has fingerprint 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((fingerprint((t.as_py() or "").encode()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["row", "doc_id", "fp"])

    return rows.mapInArrow(run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def balls(fps: DataFrame, width: int, radius: int, halves: bool) -> DataFrame:
    """(fp, part, word): for every fingerprint all words within the radius, of each half or of the whole."""
    masks = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)], np.uint64)
    step = max(1, 400_000 // len(masks))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), step):
                own = fp[at : at + step]
                for part, word in enumerate([own & np.uint64(0xFFFFFFFF), own >> np.uint64(32)] if halves else [own]):
                    words = (word[:, None] ^ masks).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(masks)).view(np.int64)), pa.array(np.full(len(words), part, np.int32)), pa.array(words.view(np.int64))], ["fp", "part", "word"])

    return spread(fps.select("fp"), "fp").mapInArrow(run, "fp long, part int, word long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints: together they connect all that are within distance 4."""
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    by = Window.partitionBy("part", "word").orderBy("fp")
    near = {f"{f.__name__}{k}": f("fp", k).over(by) for f in (F.lag, F.lead) for k in (1, 2)}
    met = materialise(balls(fps, 32, 1, True).select("fp", "part", "word", *[v.alias(k) for k, v in near.items()]).where("lag1 is not null or lead1 is not null"), "simhash-halves")
    crowded = met.where("lag2 is not null or lead2 is not null or (lag1 is not null and lead1 is not null)")
    pairs = met.where("lead1 is not null and lead2 is null and lag1 is null").select(F.col("fp").alias("a"), F.col("lead1").alias("b")).where(distance <= RADIUS)
    dense = balls(crowded.select("fp").distinct(), 64, RADIUS // 2, False)
    chain = dense.select("fp", F.lag("fp").over(by).alias("b")).where("b is not null").select(F.col("fp").alias("a"), "b").where(distance <= RADIUS)
    return materialise(pairs.unionByName(chain).distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that can be reached. Hooking to the smallest neighbouring label and
    pointer jumping, a table a round, until nothing changes; labels only fall, so it ends."""
    both = materialise(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "component-edges")
    labels = materialise(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).select(F.col("x").alias("node"), "label"), "component-labels")
    while True:
        seen = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        hooked = labels.join(seen, F.col("node") == F.col("x")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # A root that saw a smaller label passes it to all that point to it.
        jump = labels.join(seen, F.col("node") == F.col("x")).groupBy("label").agg(F.min("near").alias("jump")).select(F.col("label").alias("_root"), "jump")
        after = hooked.join(jump, F.col("label") == F.col("_root"), "left").select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label"))
        labels = materialise(after, "component-labels")
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def grouped(own: DataFrame) -> DataFrame:
    """(_fp, component_id, first): the component of every fingerprint and its first row. own: a written table of row, doc_id, fp."""
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    firsts = materialise(own.groupBy("fp").agg(order.alias("first")), "simhash-firsts")
    labels = components(links(firsts))
    groups = firsts.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")
    smallest = groups.groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("best"))
    return groups.join(smallest, F.col("label") == F.col("_label")).select(F.col("fp").alias("_fp"), F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first"))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc (the input row), fingerprint (16 hex digits), component_id, and first, true for one row of each component.

    Equal texts share a fingerprint and so a component. Null texts are empty, and texts without words have fingerprint zero, linked like
    any other; very long texts are read whole. A null id takes part; component_id is the smallest id that is not null. First is a row of
    the smallest id; rows that repeat it are not first again. Empty table: empty result. Columns of the input may have any names.
    """
    docs = numbered(docs, "simhash-rows")
    own = materialise(fingerprints(docs.select("row", F.col("doc")[id_col].alias("doc_id"), F.col("doc")[text_col].cast("string").alias("text"))), "simhash-fingerprints")
    mapped = own.join(grouped(own), F.col("fp") == F.col("_fp")).select(F.col("row").alias("_row"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row") == F.col("first")).alias("first"))
    return docs.join(mapped, F.col("row") == F.col("_row")).select("doc", "fingerprint", "component_id", "first")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every input row, without the rows themselves; see near_rows()."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = materialise(fingerprints(rows), "simhash-fingerprints")
    return own.join(grouped(own), F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
