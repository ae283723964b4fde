"""Quality classifier: random-indexing word vectors pooled per document, then a small two-layer network.

Every word (case and punctuation kept) that makes up at least the share 1 / VOCABULARY of all words of the corpus has a vector of its own; there are at
most VOCABULARY of these whatever the corpus, and the table's size is bounded. The rarer words share RARE classes by their hash. Each has a sparse random
index vector; its word vector is the sum of the index vectors of the words beside it, over all documents: one pass counts the words, one
adds up the vectors. A document is the mean and the spread of its words' vectors and its log length. The network is fitted on at most
`max_labelled` labelled documents, taken by a hash of their id; a part of these is set aside to fit the temperature of the probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, mix, spans, text_chunks, word_hashes

#: Words with vectors of their own have at least this share of all words, so there are at most so many; classes of the others.
VOCABULARY, RARE = 65_536, 8192
WIDTH, NONZERO, WINDOW = 32, 4, 2
#: Bound on the labelled rows that the network is fitted on.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 3
THRESHOLD = 0.3
#: Rows of the vector table in a part, the unit that travels and is added up; distinct words a task holds before it sends their counts.
_PART, _HELD = 4096, 1_000_000


def index_vectors(names: np.ndarray) -> np.ndarray:
    """The sparse index vectors of words (by their hash) or classes: NONZERO signed places each."""
    out = np.zeros((len(names), WIDTH), np.int8)
    rows = np.arange(len(names))
    for k in range(NONZERO):
        h = mix(names + np.uint64(SEED + k))
        np.add.at(out, (rows, (h % np.uint64(WIDTH)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.int8))
    return out


def frequent_words(docs: DataFrame, text_col: str, vocabulary: int) -> np.ndarray:
    """Sorted hashes of the words that make up at least 1 / vocabulary of all words."""

    def count(batches):
        import pyarrow as pa

        def out(parts):
            words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        parts, held = [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), False):
                starts, ends, _ = spans(data, offsets)
                parts.append(np.unique(word_hashes(data, starts, ends), return_counts=True))
                held += len(parts[-1][0])
                if held > _HELD:
                    parts = [out(parts)]
                    held = len(parts[0][0])
                    if held > _HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["word", "n"])
                        parts, held = [], 0
        if parts:
            words, n = out(parts)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "quality-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * F.lit(vocabulary) >= F.lit(total)).select("word").collect()  # at most `vocabulary` rows
    return np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))


class Vectors:
    """Word vectors: a row for each frequent word in the order of the hashes, then one for each class of rare words."""

    def __init__(self, frequent: np.ndarray, rare: int):
        self.frequent, self.rare, self.rows = frequent, rare, np.zeros((len(frequent) + rare, WIDTH), np.float32)

    def classes(self, words: np.ndarray) -> np.ndarray:
        rare = len(self.frequent) + (words % np.uint64(self.rare)).astype(np.int64)
        if not len(self.frequent):
            return rare
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[at] == words, at, rare)


def word_vectors(docs: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY, rare: int = RARE) -> Vectors:
    """Word vectors from all texts; rows of length 1, or zero for classes without neighbours."""
    vectors = Vectors(frequent_words(docs, text_col, vocabulary), rare)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def add_up(batches):
        import pyarrow as pa

        own = shared.value
        index = index_vectors(np.concatenate([own.frequent, np.arange(own.rare, dtype=np.uint64)]))
        total = np.zeros(own.rows.shape, np.float32)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), False):
                starts, ends, doc = spans(data, offsets)
                if len(doc) < 2:
                    continue
                cls = own.classes(word_hashes(data, starts, ends))
                signs, beside = index[cls], np.zeros((len(cls), WIDTH), np.int16)
                for k in range(1, WINDOW + 1):
                    same = (doc[k:] == doc[:-k])[:, None]
                    beside[:-k] += signs[k:] * same
                    beside[k:] += signs[:-k] * same
                order = np.argsort(cls, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], cls[order][1:] != cls[order][:-1]]))
                total[cls[order][at]] += np.add.reduceat(beside[order], at, axis=0, dtype=np.float32)
        used = [i for i in range(0, len(total), _PART) if total[i : i + _PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // _PART for i in used], pa.int32()), pa.array([total[i : i + _PART].tobytes() for i in used], pa.binary())], ["part", "sums"])

    def join(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0), batch.column(1), strict=True):
                more = np.frombuffer(sums.as_py(), np.float32)
                total[part.as_py()] = total.get(part.as_py(), 0) + more.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in total.values()], pa.binary())], ["part", "sums"])

    kind = "part int, sums binary"
    parts = -(-len(vectors.rows) // _PART)
    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(add_up, kind).repartition(parts, "part").mapInArrow(join, kind)
    for r in summed.collect():  # the table itself, of bounded size
        vectors.rows[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["sums"], "<f4").reshape(-1, WIDTH)
    vectors.rows /= np.maximum(np.linalg.norm(vectors.rows, axis=1, keepdims=True), 1e-9)
    return vectors


def pooled(vectors: Vectors, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, its log length in words and in bytes, and the share of distinct words."""
    starts, ends, doc = spans(data, offsets)
    n, classes = np.bincount(doc, minlength=len(offsets) - 1), len(vectors.rows)
    cls = vectors.classes(word_hashes(data, starts, ends))
    size = np.log1p(np.stack([n, np.diff(offsets)], 1)) / 10
    # Classes of a text counted once: sums over its distinct classes, weighted.
    keys, times = np.unique(doc * classes + cls, return_counts=True)
    rows, weights = vectors.rows[keys % classes], times[:, None].astype(np.float32)
    full = np.flatnonzero(n)
    at = np.searchsorted(keys // classes, full)
    out = np.zeros((len(n), 2 * WIDTH + 3), np.float32)
    if len(full):
        mean = np.add.reduceat(rows * weights, at) / n[full, None]
        square = np.add.reduceat(rows * rows * weights, at) / n[full, None]
        out[full, :WIDTH] = mean
        out[full, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean**2, 0))
        out[full, -1] = np.diff(np.append(at, len(keys))) / n[full]
    out[:, 2 * WIDTH : 2 * WIDTH + 2] = size
    return out


class Network:
    """Two dense layers, fitted with Adam on balanced log loss; a temperature from rows set aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        aside = rng.random(len(x)) < 0.2
        z, fit = (x - self.mean) / self.scale, ~aside
        self.w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        moment = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w]
        zf, yf, step = z[fit], y[fit], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(zf))
            for k in range(0, len(order), 256):
                part = order[k : k + 256]
                h = np.maximum(zf[part] @ self.w[0] + self.w[1], 0)
                error = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - yf[part]) / len(part)
                back = np.outer(error, self.w[2]) * (h > 0)
                step += 1
                for w, m, g in zip(self.w, moment, (zf[part].T @ back, back.sum(0), h.T @ error, error.sum(keepdims=True)), strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    w -= 2e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) + 1e-6 * w
        if aside.any():
            logit, target = self.logits(x[aside]), y[aside]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, logit / t) - target * logit / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class QualityModel:
    """Word vectors and network, at most 10 MB whatever the corpus. Without both labels, one constant probability."""

    def __init__(self, vectors: Vectors, network: Network | None, constant: float):
        self.vectors, self.network, self.constant = vectors, network, constant

    def scores(self, texts) -> np.ndarray:
        """Probabilities for an Arrow array of texts."""
        if self.network is None:
            return np.full(len(texts), self.constant)
        return np.concatenate([np.zeros(0), *(self.network.probability(pooled(self.vectors, data, offsets)) for _, data, offsets in text_chunks(texts, False))])

    def score_column(self, text: Column, spark) -> Column:
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(shared.value.scores(texts))

        return score(text)

    def score(self, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """doc_id, held_out, score, predicted for every row. Null texts count as empty; very long ones are read whole; rows that
        repeat an id are scored each; an empty table gives an empty result. Other columns, whatever their names, are not read."""
        scored = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), self.score_column(F.col("text").cast("string"), docs.sparkSession).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, vocabulary: int = VOCABULARY) -> QualityModel:
    """Learns from labels whose crc32(doc_id as text) mod 5 is not 0; conflicting labels of an id are averaged and halved
    at 0.5; null labels and labels without a document are passed over. Of rows that repeat a labelled id, the one with the
    smallest features counts. Without documents, or without both labels, the model is one constant."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    vectors = word_vectors(texts, vocabulary=vocabulary)
    chosen = labels.select("doc_id", "quality").where((crc_mod("doc_id", 5) != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("labelled"), "y")
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for _, data, offsets in text_chunks(batch.column(2), False):
                x = pooled(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), batch.column(1).slice(at, len(x)), pa.array([r.tobytes() for r in x])], ["id", "y", "x"])
                at += len(x)

    kind = f"id {texts.schema['id'].dataType.simpleString()}, y int, x binary"
    met = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("id", "y", "text")
    # At most max_labelled rows: their broadcast and what comes back are bounded by the parameter.
    found = met.mapInArrow(features, kind).groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect()
    y = np.array([r["y"] for r in found], float)
    if len(set(y)) < 2:
        return QualityModel(vectors, None, float(y[0]) if len(y) else 0.5)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found]).astype(float)
    order = np.lexsort(np.column_stack([x, y]).T)  # rows come in any order
    return QualityModel(vectors, Network(x[order], y[order]), 0.5)
