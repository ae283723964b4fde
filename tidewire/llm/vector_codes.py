"""Vector code compression: product codes over integer grids, assigned with memoised grid cells.

Components become whole numbers, a vector is cut into PARTS equal consecutive parts, and each part position has a codebook of at most
ENTRIES entries that Lloyd rounds move. To assign a part, its coarse cell (components shifted right) is looked up in a table that the
task keeps: an entry stands there unless its least distance to the cell's box is over the smallest of the entries' greatest
distances to it, for then no part inside can be nearest to it. Only the entries that stand are measured, exactly, in whole numbers; so
results do not depend on the width of cells, on the order of rows or on what the table has forgotten.

A round is one pass over the written rows: tasks send sums for every (part, entry), which meet in one aggregate of parts x entries x
width rows; only codebooks reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small_or_shuffled
from .permutation_index import listed, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to this size: then the distance of a vector of up to 64 components fits into 64 bits, as do a task's sums.
LARGEST = 1 << 27
#: Width of a coarse cell in bits, and the cells that a task remembers at most (about 100 bytes each); a full table is emptied.
CELL_BITS, CELLS = 8, 200_000
#: (part, entry) pairs measured at a time.
PAIRS = 1 << 20


def whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and whole components of the rows that have them."""
    x = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), x.cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # floor() of a double is a whole number of 64 bits; beyond LARGEST an error says so
    kept = rows.where(F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    fits = F.forall("x", lambda c: F.abs(c) * SCALE <= LARGEST)
    told = F.when(fits, F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))).otherwise(F.raise_error(F.lit(f"components over {LARGEST // SCALE} are not supported")).cast("array<int>"))
    return kept.select("id", "label", told.alias("v"))


class Cells:
    """The entries that can be nearest to some point of a cell, remembered by cell, for one part position."""

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS, most: int = CELLS):
        self.book, self.bits, self.most = book.astype(np.int64), bits, most
        self.rule = np.random.default_rng(3).integers(1, 1 << 62, max(1, book.shape[1]), dtype=np.int64) | 1
        self.known: dict[int, tuple[bytes, np.ndarray]] = {}
        self.measured = 0

    def standing(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries are not dominated across its box."""
        low = (cells << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        under, over = low - self.book[None], self.book[None] - high
        least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(2)
        return least <= most.min(1, keepdims=True)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        cells = x >> self.bits
        with np.errstate(over="ignore"):
            keys = (cells * self.rule[: x.shape[1]]).sum(1)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        mine = np.ascontiguousarray(cells[first])
        found = np.ones((len(first), len(self.book)), bool)
        new = []
        for i, (key, at) in enumerate(zip(keys[first].tolist(), mine, strict=True)):
            kept = self.known.get(key)
            if kept is not None and kept[0] == at.tobytes():
                found[i] = kept[1]
            else:
                new.append(i)
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
            for lo in range(0, len(new), 4096):
                some = new[lo : lo + 4096]
                found[some] = self.standing(mine[some])
            for i in new[: self.most]:
                self.known[int(keys[first[i]])] = (mine[i].tobytes(), found[i])
        out = found[which]
        out[(cells != mine[which]).any(1)] = True  # two cells of one hash: every entry is measured
        return out

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of equals) and its squared distance, for each row."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, PAIRS // max(1, len(self.book)))
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            row, entry = np.nonzero(self.candidates(some))  # by row, then entry
            self.measured += len(row)
            far = ((some[row] - self.book[entry]) ** 2).sum(1)
            starts = np.searchsorted(row, np.arange(len(some)))
            best = np.minimum.reduceat(far, starts)
            hit = np.flatnonzero(far == best[row])
            nearest = hit[np.searchsorted(row[hit], np.arange(len(some)))]
            code[lo : lo + step], error[lo : lo + step] = entry[nearest], best
        return code, error


def sums(rows: DataFrame, books: list, bits: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts nearest to each entry that has any."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import pyarrow as pa

        tables, total, count = [Cells(b, bits) for b in shared.value], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0), np.int64)
            parts = np.split(x, len(tables), axis=1)
            if total is None:
                total, count = [np.zeros(t.book.shape, np.int64) for t in tables], [np.zeros(len(t.book), np.int64) for t in tables]
            for p, (t, part) in enumerate(zip(tables, parts, strict=True)):
                code, _ = t.assign(part)
                np.add.at(total[p], code, part)
                count[p] += np.bincount(code, minlength=len(t.book))
        if total is not None:
            out = [(p, e, int(count[p][e]), i, int(s)) for p in range(len(total)) for e in range(len(count[p])) if count[p][e] for i, s in enumerate(total[p][e])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["part", "entry", "n", "place", "s"])

    found = rows.select("v").mapInArrow(run, "part int, entry int, n long, place int, s long")
    found = found.groupBy("part", "entry", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: (r["part"], r["entry"], r["place"])):
        out.setdefault((r["part"], r["entry"]), (int(r["n"]), []))[1].append(int(r["s"]))
    return out


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids (null last, equal ids by their components)."""
    found = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    return np.split(np.array([r["v"] for r in found], np.int64), parts, axis=1)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS) -> list[np.ndarray]:
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        for (p, e), (n, s) in sums(rows, books, bits).items():
            books[p][e] = [v // n for v in s]  # Python's floor: down, also below zero
    return books


def encode(rows: DataFrame, books: list[np.ndarray], bits: int = CELL_BITS) -> DataFrame:
    """id, label, code, error."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import pyarrow as pa

        tables = [Cells(b, bits) for b in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.split(matrix(batch.column(2), np.int64), len(tables), axis=1)
            got = [t.assign(p) for t, p in zip(tables, parts, strict=True)]
            codes = np.stack([c for c, _ in got], axis=1).astype(np.uint8)
            error = np.sum([e for _, e in got], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["id", "label", "code", "error"])

    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("id", "label")}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """The codes (vec_id, code, error, label_error, codebooks_sha256) and the codebooks.

    A row whose vector is null or holds a null or non-finite component takes no part. Rows that repeat an id are rows of their own; a
    null id is kept and sorts last for the first codebooks, equal ids go by their components. Fewer rows than entries give smaller
    codebooks, an empty table no rows. Vectors have one length that the parts divide, and components of at most 32,768;
    else ValueError or a Spark error says so. Other columns, whatever their names, are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = materialise(whole(vectors, id_col, vector_col, label_col), "codes-rows")
    widths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").limit(2).collect()]
    if len(widths) > 1 or widths and (widths[0] == 0 or widths[0] % parts):
        raise ValueError(f"vectors need one length that {parts} parts divide; found {widths}")
    books = fit(rows, parts, entries, rounds, bits) if widths else []
    if not widths:
        coded = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = materialise(encode(rows, books, bits), "codes")
    # null and NaN labels are groups as well; the key is never null
    label = F.struct(F.col("label"))
    totals = coded.groupBy(label.alias("of")).agg(F.sum("error").alias("label_error"))
    totals = small_or_shuffled(materialise(totals, "codes-labels"))
    out = coded.withColumn("of", label).join(totals, "of")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id and the vector that its code stands for."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                at = np.array([list(bytes.fromhex(c)) for c in batch.column(1).to_pylist()])
                x = np.concatenate([b[at[:, p]] for p, b in enumerate(shared.value)], axis=1) / SCALE
                yield pa.RecordBatch.from_arrays([batch.column(0), listed(x)], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {codes.schema['vec_id'].dataType.simpleString()}, vector array<double>")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The codes in DuckDB SQL: one step for each round, over a row a component."""
    down = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT r, (i - 1) // w AS p, (i - 1) % w AS k, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
        c0 AS MATERIALIZED (SELECT p, r - 1 AS e, k, CAST(v AS HUGEINT) AS v FROM x WHERE r <= {entries})"""
    ]
    nearest = "SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, x.p, e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{0} c ON x.p = c.p AND x.k = c.k GROUP BY ALL) GROUP BY ALL"
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({nearest.format(i)}), m{i} AS (SELECT p, e, k, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r, p) GROUP BY ALL),
          c{i + 1} AS MATERIALIZED (SELECT p, e, k, coalesce({down}, v) AS v FROM c{i} LEFT JOIN m{i} USING (p, e, k))""")
    steps.append(f"""z AS MATERIALIZED ({nearest.format(rounds)}), t AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, k)) FROM c{rounds}) AS codebooks_sha256 FROM t JOIN kept USING (r)""")
    return ", ".join(steps)
