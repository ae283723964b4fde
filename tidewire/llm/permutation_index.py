"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order (a prefix of them) and posted once, in the inverted file of its nearest
pivot. A query visits the files of the pivots nearest to itself, ranks each file by the footrule distance of the
orders, and measures what lies within a radius of it, and at least the first k with all ties, exactly.

Pivots are fitted on a bounded sample and grow with the square root of the number of vectors, so files do too. How many files are visited and which
footrule is the radius follows from the data: for at most CALIBRATION queries the exact neighbours are found in one pass, and both numbers are
set so that RECALL of these neighbours lie within. Clustered vectors visit few files;
for vectors without structure (uniform on a sphere in 64 dimensions) no order of pivots tells near from far well, more
than half of the files must be visited and the work grows with the product of queries and vectors.

A file is split into shares of about SHARE vectors and the queries of a pivot into blocks, so a pivot that holds a third of the
vectors is dealt over many tasks. Each (file share, query block) returns at most k rows a query.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, spread

#: Rows from which the pivots are drawn, by a hash of the row's number.
SAMPLE = 4096
#: Pivots: PER_ROOT x the root of the number of vectors, within these bounds; length of the orders.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS, PREFIX = 1.0, 64, 2048, 64
SHARE, BLOCK = 20_000, 2_000
#: Queries whose exact neighbours set the effort, and the share of these that each of the two steps has to keep.
CALIBRATION, RECALL = 64, 0.99


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector v, without vectors that are null, zero, or hold null or non-finite components."""
    v = F.col("v")
    kind = "array<float>" if "float" in vectors.schema[vector_col].dataType.simpleString() else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(~bad, F.lit(False))).where(F.exists("v", lambda x: x != 0))


def by_row(rows: DataFrame) -> DataFrame:
    """Written rows with a number `id` of their own that rises with vec_id (null last), so that the smaller of two numbers is the smaller
    vec_id. Ranges are of vec_id and the vector's hash: an id that a third of the rows repeat is many tasks."""
    order = [F.asc_nulls_last("vec_id"), F.xxhash64("v")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(sorted_rows.select(F.monotonically_increasing_id().alias("id"), "vec_id", "v"), "ann-vectors")


def pivots_of(rows: DataFrame, pivots: int, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far apart from each other, chosen among at most `sample` rows: each in proportion to its squared distance from those chosen."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = np.unique(np.array([r["v"] for r in found], float), axis=0) if found else np.zeros((0, 1))
    if len(x) <= pivots:
        return x
    rng = np.random.default_rng(5)
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < pivots and near.max() > 0:
        chosen.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def matrix(column, kind) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def listed(values: np.ndarray):
    import pyarrow as pa

    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(values.ravel()))


def permutations(rows: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """id, v, `order` (numbers of the nearest pivots, nearest first) and `pivot`, the first of these."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    m = min(prefix, len(pivots))

    def run(batches):
        import pyarrow as pa

        p = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), float)
                d = (p * p).sum(1)[None] - 2 * x @ p.T  # the vector's own length changes no order
                order = np.argsort(d, axis=1, kind="stable")[:, :m].astype(np.int16)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed(order), pa.array(order[:, 0].astype(np.int32))], ["id", "v", "order", "pivot"])

    return rows.mapInArrow(run, f"id long, v {rows.schema['v'].dataType.simpleString()}, order array<smallint>, pivot int")


def footrule_table(query: np.ndarray, n_pivots: int) -> np.ndarray:
    """What pivot p at place i of a row adds to Spearman's footrule of the row and this query, at [p, i], less a constant.

    A pivot that one prefix lacks stands just after it. The constant is m (m + 1) / 2, the sum over the query's pivots if the row
    had none of them: a shared pivot at place a of the query takes its m - a off and adds |a - i|.
    """
    m = len(query)
    place = np.full(n_pivots, m)
    place[query] = np.arange(m)
    return (np.abs(place[:, None] - np.arange(m)[None]) - (m - place)[:, None]).astype(np.int16)


def footrule(order: np.ndarray, query: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule of many rows and one query."""
    m = len(query)
    return footrule_table(query, n_pivots).ravel()[order.astype(np.int64) * m + np.arange(m)].sum(1, dtype=np.int32) + m * (m + 1) // 2


def effort(index: DataFrame, queries: DataFrame, n_pivots: int, k: int, asked: int = CALIBRATION, recall: float = RECALL) -> tuple[int, int]:
    """Files to visit and the largest footrule to measure, for `recall` at each of the two steps over at most `asked` queries.

    One pass over the index against this bounded set of queries; what comes back are asked x k rows.
    """
    spark = index.sparkSession
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(asked).collect()
    everything = n_pivots, 2 * n_pivots * n_pivots
    if not sample:
        return everything
    ids, x = np.array([r["id"] for r in sample]), np.array([r["v"] for r in sample], float)
    whole = np.array([r["order"] for r in sample], np.int64)
    orders = whole[:, :PREFIX]
    shared = spark.sparkContext.broadcast((ids, x, orders))

    def exact(batches):
        import pyarrow as pa

        ids, x, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, v, order = batch.column("id").to_numpy(), matrix(batch.column("v"), float), matrix(batch.column("order"), np.int16)
            d = (v * v).sum(1)[None] - 2 * x @ v.T
            d[ids[:, None] == own[None]] = np.inf
            best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            q, at = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
            far = d[q, at] + (x * x).sum(1)[q]
            ok = np.isfinite(far)
            yield pa.RecordBatch.from_arrays([pa.array(q[ok].astype(np.int32)), pa.array(own[at[ok]]), pa.array(far[ok]), listed(order[at[ok]]) if ok.any() else pa.array([], pa.list_(pa.int16()))], ["q", "id", "far", "order"])

    nearest_rank = F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))
    near = index.mapInArrow(exact, "q int, id long, far double, order array<smallint>").withColumn("r", nearest_rank).where(F.col("r") <= k).collect()
    if not near:
        return everything
    of = np.array([r["q"] for r in near])
    theirs = np.array([r["order"] for r in near], np.int64)
    limits = np.array([footrule(o[None], orders[q], n_pivots)[0] for q, o in zip(of, theirs, strict=True)])
    # The place of the neighbour's file among the query's pivots.
    rank = [int(np.argmax(whole[q] == o[0])) + 1 for q, o in zip(of, theirs, strict=True)]
    return int(np.quantile(rank, recall, method="higher")), int(np.quantile(limits, recall, method="higher"))


def nearest(index: DataFrame, queries: DataFrame, n_pivots: int, visited: int, radius: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the best k in each visited file share. index: from permutations(); queries: the same with whole orders.

    radius: vectors up to this footrule are measured, and at least the first k of a file.
    """
    m = min(PREFIX, n_pivots)
    visits = queries.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.slice("order", 1, m).alias("q_order"), F.explode(F.slice("order", 1, visited).cast("array<int>")).alias("q_pivot"))
    sizes = index.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows")).join(visits.groupBy(F.col("q_pivot").alias("pivot")).agg(F.count(F.lit(1)).alias("asks")), "pivot")
    sizes = F.broadcast(sizes.select(F.col("pivot").alias("_p"), F.ceil(F.col("rows") / SHARE).cast("int").alias("shares"), F.ceil(F.col("asks") / BLOCK).cast("int").alias("blocks")))  # a row a pivot
    key = lambda name, n: F.pmod(F.xxhash64(name, F.lit("share")), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    files = index.join(sizes, F.col("pivot") == F.col("_p")).withColumn("share", key("id", F.col("shares"))).select("id", "v", "order", "pivot", "share", numbers(F.col("blocks")).alias("block"))
    visits = visits.join(sizes, F.col("q_pivot") == F.col("_p")).withColumn("q_block", key("q_id", F.col("blocks"))).select("q_id", "q_v", "q_order", "q_pivot", "q_block", numbers(F.col("shares")).alias("q_share"))

    def run(files, visits):
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        if not files.num_rows or not visits.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        ids, x = files.column("id").to_numpy(), matrix(files.column("v"), float)
        at = (matrix(files.column("order"), np.int32) * m + np.arange(m, dtype=np.int32)).astype(np.int32)
        take = min(len(ids), k + 1)
        widest = radius - m * (m + 1) // 2  # the table lacks this constant
        out = []
        for q, v, o in zip(visits.column("q_id").to_numpy(), matrix(visits.column("q_v"), float), matrix(visits.column("q_order"), np.int64), strict=True):
            far = np.take(footrule_table(o, n_pivots).ravel(), at).sum(1, dtype=np.int32)
            best = np.flatnonzero((far <= max(widest, np.partition(far, take - 1)[take - 1])) & (ids != q))  # with all ties of the last place
            score = np.sqrt(((x[best] - v) ** 2).sum(1))
            top = np.lexsort((ids[best], score))[:k]
            out.append((np.full(len(top), q), ids[best[top]], score[top]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names)

    return files.groupBy("pivot", "share", "block").cogroup(visits.groupBy("q_pivot", "q_share", "q_block")).applyInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Null or zero vectors and those with null or non-finite components take no part. Vectors of different lengths have no distance: each length is
    indexed and searched for itself. Rows that repeat an id, or have none, are rows of their own: each is a candidate of all others, and a
    query for itself if its id is divisible. With few vectors all candidates are returned; equal distances go to the smaller id, null last.
    An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    rows = by_row(usable(vectors, id_col, vector_col))
    found = []
    for width in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        same, total = rows.where(F.size("v") == width["n"]), width["count"]
        pivots = pivots_of(same.select("id", "v"), min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PER_ROOT * math.sqrt(total)))))
        index = materialise(permutations(same.select("id", "v"), pivots), "ann-index")
        queries = materialise(permutations(same.where(F.pmod("vec_id", F.lit(every)) == 0).select("id", "v"), pivots, len(pivots)), "ann-queries")
        found.append(nearest(index, queries, len(pivots), *effort(index, queries, len(pivots), k), k))
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), F.col("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "c"))
    best = functools.reduce(DataFrame.unionByName, found).withColumnsRenamed({"query_id": "q", "vec_id": "c"}).withColumn("rank", rank).where(F.col("rank") <= k)
    ids = rows.select(F.col("id").alias("_i"), "vec_id")
    named = best.join(ids.withColumnRenamed("vec_id", "query_id"), F.col("q") == F.col("_i")).drop("_i").join(ids, F.col("c") == F.col("_i"))
    return named.select("query_id", "rank", "vec_id", "score")
