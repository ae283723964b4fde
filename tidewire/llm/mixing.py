"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted into cells (source, language, topic). The topic is a cluster of the documents' whole texts: every text is a
vector of its words (damped counts, each word at four signed places by its hash), less the mean of its language, so that topics cut across
languages and the marginals do not contradict each other; k-means over all documents gives the clusters. Only its first centres come
from a bounded sample, its rounds add up all rows.

Rounds of raking scale the cells' token weights to each marginal's targets in turn, as group sums joined back, until no sum is off its
target or nothing improves. A document is kept with the ratio of raked to present tokens, at most 1: cells that would exceed that are held at 1,
their tokens are taken off the targets, and the rest is raked again, until no cell exceeds it. The draw is a hash of the id.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import materialise, mix, small_or_shuffled, spans, text_chunks, word_hashes

DIMENSIONS = ("source", "lang", "topic")
#: Exponent on present token shares that gives the default target shares: below 1 lifts small groups.
ALPHA = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Rounds between two looks at the error, which ends the raking at TOLERANCE or when it falls by less than a tenth.
ROUNDS, TOLERANCE = 4, 1e-3
#: Clusters, length of the vectors, rounds of k-means, rows from which its first centres are drawn.
TOPICS, WIDTH, MEANS, SAMPLE = 8, 32, 5, 2048
#: Cells up to which one task rakes them.
CELLS = 100_000


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the input row), doc_id, source, lang, tokens and vec, the vector of the whole text; null texts have no tokens."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, vectors = [np.zeros(0, np.int64)], [np.zeros((0, WIDTH), np.float32)]
            for _, data, offsets in text_chunks(batch.column("text"), True):
                starts, ends, doc = spans(data, offsets)
                n = len(offsets) - 1
                counts.append(np.bincount(doc, minlength=n))
                if not len(starts):
                    vectors.append(np.zeros((n, WIDTH), np.float32))
                    continue
                _, word = np.unique(word_hashes(data, starts, ends), return_inverse=True)
                first = np.zeros(word.max() + 1, np.int64)
                first[word] = np.arange(len(word))
                names = word_hashes(data, starts[first], ends[first])
                pairs, times = np.unique(doc * len(names) + word, return_counts=True)
                of, name, weight = pairs // len(names), names[pairs % len(names)], np.log1p(times)
                vector = np.zeros(n * WIDTH)
                for k in range(4):  # four signed places a word
                    h = mix(name + np.uint64(k + 1))
                    sign = np.where(h >> np.uint64(63), weight, -weight)
                    vector += np.bincount(of * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64), sign, n * WIDTH)
                vector = vector.reshape(n, WIDTH)
                vectors.append((vector / np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)).astype(np.float32))
            vectors = np.concatenate(vectors)
            at = pa.array(np.arange(0, vectors.size + 1, WIDTH, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(np.concatenate(counts)), pa.ListArray.from_arrays(at, pa.array(vectors.ravel()))], ["doc", "doc_id", "source", "lang", "tokens", "vec"])

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    sent = docs.select(whole, F.col(id_col).alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string").alias("text"))
    schema = sent.select("doc").schema.add("doc_id", sent.schema["doc_id"].dataType).add("source", "string").add("lang", "string").add("tokens", "long").add("vec", ArrayType(FloatType()))
    return sent.mapInArrow(run, schema)


def less_language(rows: DataFrame) -> DataFrame:
    """rows with the mean vector of their language taken off vec. rows: a written table."""
    means = rows.where("tokens > 0").groupBy(F.col("lang").alias("_lang")).agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(WIDTH)]).alias("_mean"))
    means = small_or_shuffled(materialise(means, "mix-means"))
    off = F.zip_with("vec", "_mean", lambda a, b: (a - F.coalesce(b, F.lit(0.0))).cast("float"))
    return rows.join(means, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("vec", F.when(F.col("_mean").isNull(), F.col("vec")).otherwise(off)).drop("_lang", "_mean")


def centres(vectors: DataFrame, topics: int = TOPICS, rounds: int = MEANS) -> np.ndarray:
    """k-means over the column vec of all rows: topics x WIDTH numbers. The first centres: rows far apart in a bounded sample by hash of the id."""
    found = vectors.where("tokens > 0").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE).select("vec").collect()
    x = np.unique(np.array([r["vec"] for r in found], float).reshape(-1, WIDTH), axis=0)
    if len(x) <= topics:
        return x if len(x) else np.zeros((1, WIDTH))
    own, rng = x[:1], np.random.default_rng(7)
    while len(own) < topics:
        far = ((x[:, None] - own[None]) ** 2).sum(2).min(1)
        own = np.vstack([own, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(own)

        def add_up(batches, shared=shared):
            import pyarrow as pa

            c = shared.value
            total = np.zeros((len(c), WIDTH + 1))
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(0).flatten().to_numpy().reshape(-1, WIDTH)
                    at = nearest_centre(v, c)
                    for k in range(len(c)):
                        total[k, :WIDTH] += v[at == k].sum(0, dtype=float)
                        total[k, WIDTH] += (at == k).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

        sums = {r["i"]: r["v"] for r in vectors.where("tokens > 0").select("vec").mapInArrow(add_up, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        total = np.array([sums[i] for i in range(len(own) * (WIDTH + 1))]).reshape(len(own), WIDTH + 1)
        own = np.where(total[:, WIDTH:] > 0, total[:, :WIDTH] / np.maximum(total[:, WIDTH:], 1), own)
    return own


def nearest_centre(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None] - 2 * v @ c.T, axis=1)


def topic_column(vec: Column, own: np.ndarray, spark) -> Column:
    shared = spark.sparkContext.broadcast(own)

    @F.arrow_udf("int")
    def topic(vec):
        import pyarrow as pa

        return pa.array(nearest_centre(vec.flatten().to_numpy().reshape(-1, WIDTH), shared.value).astype(np.int32))

    return topic(vec)


def goals_of(cells: DataFrame, d: str, alpha: float, target: DataFrame | None) -> DataFrame:
    """(_v, goal): the share of all tokens that each value of a dimension is to have. Values without a named share get none."""
    share = cells.groupBy(F.col(d).alias("_v")).agg(F.sum("tokens").cast("double").alias("have"))
    if target is None:
        share = share.withColumn("goal", F.when(F.col("have") > 0, F.pow("have", F.lit(alpha))).otherwise(0.0))
    else:
        named = target.select(F.col(target.columns[0]).alias("_name"), F.col(target.columns[1]).cast("double").alias("_share"))
        share = share.join(named, F.col("_v").eqNullSafe(F.col("_name")), "left").withColumn("goal", F.when(F.col("have") > 0, F.coalesce("_share", F.lit(0.0))).otherwise(0.0))
    whole = share.agg(F.sum("goal")).first()[0] or 1.0  # one number
    return share.select("_v", (F.col("goal") / F.lit(float(whole))).alias("goal"))


def with_sums(rows: DataFrame, d: str, volume: float, few: bool) -> DataFrame:
    """rows with `want`: what the cells of a value that are not held may weigh together, and `sum`, what they weigh.

    few: the rows are one partition of at most CELLS rows, and a window sums them up without a shuffle; else the sums are combined before
    the shuffle and joined back, so no task sees all cells of a value. rows is read twice then, and must be a written table.
    """
    free, fixed = F.sum(F.when(~F.col("held"), F.col("weight")).otherwise(0.0)), F.sum(F.when(F.col("held"), F.col("weight")).otherwise(0.0))
    if few:
        by = Window.partitionBy(d)
        rows = rows.withColumns({"sum": free.over(by), "fixed": fixed.over(by)})
    else:
        sums = rows.groupBy(F.col(d).alias("_v")).agg(free.alias("sum"), fixed.alias("fixed"))
        rows = rows.join(sums, F.col(d).eqNullSafe(F.col("_v"))).drop("_v")
    return rows.withColumn("want", F.greatest(F.col(f"goal_{d}") * volume - F.col("fixed"), F.lit(0.0))).drop("fixed")


def rake(cells: DataFrame, alpha: dict[str, float], keep: float, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (dimensions, tokens) with `weight`, at most `tokens`, whose marginals are the targets of keep x all tokens as far as that allows.

    targets: for a dimension, a table (value, share); the others get present shares to the power alpha. Shares are normalised
    over the values that occur.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    volume = keep * total
    rows = cells.withColumns({"weight": F.col("tokens") * F.lit(float(keep)), "held": F.lit(False)})
    for d in alpha:
        aims = goals_of(cells, d, alpha[d], (targets or {}).get(d))
        rows = rows.join(aims.withColumnRenamed("goal", f"goal_{d}"), F.col(d).eqNullSafe(F.col("_v"))).drop("_v")
    few = cells.count() <= CELLS
    rows = materialise(rows.coalesce(1) if few else rows, "mix-goals")
    rows = rows.coalesce(1) if few else rows
    over = ~F.col("held") & (F.col("weight") > F.col("tokens") * (1 + 1e-9))
    while True:
        before = float("inf")
        while True:
            for _ in range(ROUNDS):
                for d in alpha:
                    scaled = F.coalesce(F.try_divide(F.col("weight") * F.col("want"), F.col("sum")), F.lit(0.0))
                    rows = rows if few else materialise(rows, "mix-raked")
                    rows = with_sums(rows, d, volume, few).withColumn("weight", F.when(F.col("held"), F.col("weight")).otherwise(scaled)).drop("sum", "want")
            rows = materialise(rows.coalesce(1) if few else rows, "mix-raked")
            error = F.max(F.when(F.col("want") > 0, F.abs(F.col("sum") / F.col("want") - 1)))
            rows = rows.coalesce(1) if few else rows
            # One small aggregate for each dimension but the last one scaled, which is met; and whether cells exceed their tokens.
            off = [with_sums(rows, d, volume, few).select(error.alias("off"), F.max(over).alias("over")) for d in list(alpha)[:-1] or list(alpha)]
            seen = functools.reduce(DataFrame.unionByName, off).agg(F.max("off"), F.max("over")).first()
            off = seen[0] or 0.0
            if off < tolerance or off > 0.9 * before:
                break
            before = off
        if not seen[1]:
            return rows.withColumn("weight", F.least("weight", F.col("tokens").cast("double"))).drop("held")
        rows = rows.withColumns({"weight": F.when(over, F.col("tokens").cast("double")).otherwise(F.col("weight")), "held": F.col("held") | over})


def marginals(raked: DataFrame, alpha: dict[str, float]) -> DataFrame:
    """dimension, value, wanted, reached: the target share of the kept tokens and the expected one, of every value."""
    total = F.lit(float(raked.agg(F.sum("weight")).first()[0] or 1.0))
    one = [raked.groupBy(F.col(d).cast("string").alias("value")).agg(F.first(f"goal_{d}").alias("wanted"), (F.sum("weight") / total).alias("reached")).select(F.lit(d).alias("dimension"), "value", "wanted", "reached") for d in alpha]
    return functools.reduce(DataFrame.unionByName, one)


def draw(key: Column, seed: int = 7) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / float(1 << 53)


def mix_rows(docs: DataFrame, keep: float = 0.6, id_col: str = "doc_id", text_col: str = "text", alpha: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, topics: int = TOPICS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc (the input row), doc_id, source, lang, topic, tokens, p, kept, and the target share of its source, language and topic.

    Null sources, languages and texts are values of their own (a null or empty text has no tokens). Documents without tokens carry no weight and are
    kept with chance `keep`. Rows that repeat an id are drawn alike if they fall into the same cell; very long texts count whole.
    An empty table gives an empty result. Columns of the input may have any names: they travel inside `doc`.
    """
    alpha = alpha or ALPHA
    rows = less_language(materialise(described(docs, id_col, text_col), "mix-documents"))
    own = centres(rows, topics)
    topic = F.when(F.col("tokens") > 0, topic_column(F.col("vec"), own, docs.sparkSession))
    counted = materialise(rows.select("source", "lang", "tokens", topic.alias("topic")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    raked = rake(counted, alpha, keep, targets, tolerance)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.coalesce(F.try_divide("weight", "tokens"), F.lit(0.0)))).otherwise(F.lit(float(keep)))
    chances = raked.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], p.alias("p"), *[f"goal_{d}" for d in alpha])
    same = functools.reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS])
    joined = rows.withColumn("topic", topic).drop("vec").join(chances, same)
    return joined.select("doc", "doc_id", *DIMENSIONS, "tokens", "p", (draw(F.col("doc_id")) < F.col("p")).alias("kept"), *[f"goal_{d}" for d in alpha])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of mix_rows() without the input row."""
    return mix_rows(docs, **options).drop("doc")
