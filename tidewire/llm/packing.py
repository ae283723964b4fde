"""Best-fit packing of token sequences by bulk-synchronous sweeps over range-sorted documents and gaps.

A round sorts the documents left and the open gaps by size, over ranges of (size, kind, key) that grow in number with the rows: they are cut
from the counts of the sizes, and a size that alone exceeds a range is dealt over several by its keys.
Every gap takes the largest document not above it: going up the order, a document waits on a stack and a gap takes
the last one that waits, so documents that compete for a gap are settled by their rank and no gap takes two. Each range is swept on its own; what
is left of it are gaps, then documents, numbered from the cut. The numbers left in every range (two a range, the only thing
that reaches the driver) say which ranks of one range meet which ranks of another, and one join on (range, rank) brings these pairs together. Then gaps
are updated and the next round begins.

Documents come in bands of falling size, as in best fit decreasing, so the small ones are left to fill what the large ones leave; a band ends
when all of it is placed. Within a band small documents travel in bundles: a round has a limit, and documents up to half of it are glued
into runs of at most the limit. Once few gaps take a bundle, the limit is halved; at limit 1 every document stands for itself. So the rounds
grow with the logarithm of the capacity, also where thousands of tiny documents fill one sequence. Documents above half
the capacity open a sequence each, further ones are opened by volume: at the start up to the tokens of the corpus, later, when no document of a
band fits any gap, for the tokens the band has left.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 2048
#: A limit is halved when less than one in so many of the rarer side, bundles or gaps, found a partner.
TAIL = 20
#: Documents and gaps that one range holds, about; a task sorts a range at once.
RANGE = 50_000
#: Words in a worker's cache of encoded words, and as many older ones.
CACHE = 150_000
#: White space after a space, and the spaces before which a text is cut. Python's \s holds all of Unicode's White_Space.
RUN, CUT = re.compile(r" \s"), re.compile(r" (?=\S)")


class Words:
    """Ids of texts by a byte-level BPE, as little-endian unsigned 32-bit numbers; the ids of words are kept.

    A text is cut before spaces that no white space follows, in the Unicode sense: there the pattern always begins a token, while a
    run of white space, such as space and no-break space, may be one. The words of a text that are not kept are encoded in one call, each
    behind its space, and told apart by the tokens that begin with one. Texts with special tokens in them are encoded whole.
    """

    def __init__(self, tokenizer: str):
        import base64

        import numpy as np
        import tiktoken
        from public_tokenizers import PATTERN

        with open(tokenizer.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[n for token, n in ranks.items() if token[:1] == b" "]] = True
        self.tokenizer, self.whole = tokenizer, None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, text: str):
        import numpy as np

        return np.array(self.bpe.encode_ordinary(text), "<u4")

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that are not in `kept`."""
        import numpy as np

        found = {w: self.older.get(w) for w in words}
        plain = []
        for w, ids in found.items():
            if ids is None:
                if w and " " not in w:
                    plain.append(w)
                else:
                    found[w] = self.packed(" " + w).tobytes()
        if plain:
            ids = self.packed(" " + " ".join(plain))
            raw, at = ids.tobytes(), (4 * np.flatnonzero(self.begins[ids])).tolist()
            found.update(zip(plain, map(raw.__getitem__, map(slice, at, [*at[1:], len(raw)])), strict=True))
        if len(self.kept) > CACHE:
            self.kept, self.older = {}, self.kept
        self.kept.update((w, ids) for w, ids in found.items() if len(w) < 64)
        return found

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            import numpy as np
            from tokenizers import Tokenizer

            self.whole = self.whole or Tokenizer.from_file(self.tokenizer)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = CUT.split(text) if RUN.search(text) else text.split(" ")
        ids = list(map(self.kept.get, rest))
        if None in ids:
            found = self.fresh([w for w, known in zip(rest, ids, strict=True) if known is None])
            ids = [found[w] if known is None else known for w, known in zip(rest, ids, strict=True)]
        return self.packed(first).tobytes() + b"".join(ids)


@functools.lru_cache(maxsize=1)
def words_of(tokenizer: str) -> Words:
    """One for all tasks of a Python worker."""
    return Words(tokenizer)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, row, piece, start, length, ids_crc32. The first may be shorter.

    `tokenizer` is a byte-level BPE file (.json) with its ranks beside it (.tiktoken); see Words.
    """

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode, last = words_of(tokenizer).encode, np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                at, to, piece = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    rows.append((key, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to, piece = to, to + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


ITEMS = "array<struct<p:long,l:long,o:long>>"
SIDE = f"kind int, size long, key long, items {ITEMS}"
DOCUMENT, GAP, PLACED = 0, 1, 2


def glue(limit: int):
    """Arrow batches of (p, l) to bundles: documents up to limit / 2 in runs of at most `limit` tokens, larger ones alone."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        half = limit // 2
        for batch in batches:
            if not batch.num_rows:
                continue
            p, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((p, -size))
            p, size = p[order], size[order]
            small = size <= half
            before = np.cumsum(np.where(small, size, 0)) - size
            group = np.where(small, before // max(half, 1), -1)
            starts = np.flatnonzero(np.concatenate([[True], ~small[1:] | (group[1:] != group[:-1])]))
            at = np.cumsum(size) - size
            offset = at - np.repeat(at[starts], np.diff(np.append(starts, len(p))))
            items = pa.ListArray.from_arrays(pa.array(np.append(starts, len(p)), pa.int32()), pa.StructArray.from_arrays([pa.array(p), pa.array(size), pa.array(offset)], ["p", "l", "o"]))
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, DOCUMENT, np.int32)), pa.array(np.add.reduceat(size, starts)), pa.array(p[starts]), items], ["kind", "size", "key", "items"])

    return run


def match_range(kinds: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """One range in ascending order: documents and gaps that meet, free gaps from the smallest, documents left from the largest."""
    waiting: list[int] = []
    taken: list[int] = []
    filled: list[int] = []
    free: list[int] = []
    for row, kind in enumerate(kinds):
        if kind == DOCUMENT:
            waiting.append(row)
        elif waiting:
            taken.append(waiting.pop())
            filled.append(row)
        else:
            free.append(row)
    return taken, filled, free, waiting[::-1]


def ranges(weights: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(first range, how many) of every (size, kind), ascending: small ones share a range of up to `most`, larger ones have several."""
    found, last, held = {}, -1, most
    for key in sorted(weights):
        n = weights[key]
        parts = -(-n // most)
        if parts > 1 or held + n > most:
            found[key] = (last + 1, parts)
            last, held = last + parts, most if parts > 1 else n
        else:
            found[key] = (last, 1)
            held += n
    return found


def cut_points(found: dict[tuple[int, int], tuple[int, int]]) -> list[float]:
    """Where ranges begin, on a scale with a unit for every (size, kind) that its keys share evenly: a range lies between two of them."""
    cuts, last = [], -1
    for (size, kind), (first, parts) in sorted(found.items()):
        code = 2 * size + kind
        cuts += [code + k / parts for k in range(parts) if first + k > last]
        last = first + parts - 1
    return [-math.inf, *cuts[1:], math.inf]


def in_ranges(rows: DataFrame, most: int) -> DataFrame:
    """rows with `part`, their range. The counts by size and kind, at most two a size, are what the driver sees.

    The cuts are Bucketizer's: as literals they would stand in every description of a plan, which the driver keeps."""
    weight = F.greatest(F.size("items"), F.lit(1))  # a bundle weighs as its documents
    weights = {(r["size"], r["kind"]): r["n"] for r in rows.groupBy("size", "kind").agg(F.sum(weight).alias("n")).collect()}
    cuts = cut_points(ranges(weights, most))
    if len(cuts) < 3:  # all in one range
        return rows.withColumn("part", F.lit(0))
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    placed = Bucketizer(splits=cuts, inputCol="_at", outputCol="_part").transform(rows.withColumn("_at", 2 * F.col("size") + F.col("kind") + spread))
    return placed.select(*rows.columns, F.col("_part").cast("int").alias("part"))


def _sweep(rows):
    """A range to its pairs (kind PLACED, key and size of the gap, items of the bundle) and its numbered rest."""
    import numpy as np
    import pyarrow as pa

    size, kind, key = (rows[c].to_numpy() for c in ("size", "kind", "key"))
    rows = rows.take(pa.array(np.lexsort((key, kind, size))))
    taken, filled, free, left = match_range(rows["kind"].to_pylist())
    out = []
    for kind, sides, bundles in ((PLACED, filled, taken), (GAP, free, free), (DOCUMENT, left, left)):
        side, n = rows.take(pa.array(sides, pa.int64())), len(sides)
        items = rows["items"].take(pa.array(bundles, pa.int64()))
        out.append(pa.Table.from_arrays([pa.array(np.full(n, kind, np.int32)), side["size"], side["key"], items, side["part"], pa.array(np.arange(n))], ["kind", "size", "key", "items", "part", "rank"]))
    return pa.concat_tables(out)


def tally(low: int):
    """Counts of (part, kind, size) rows by part and kind, and of those with sizes from `low`: one row for each in a task, without a shuffle."""

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        rows, wide = Counter(), Counter()
        for batch in batches:
            part, kind, size = (c.to_numpy() for c in batch.columns)
            code = part.astype(np.int64) * 3 + kind
            for found, chosen in ((rows, code), (wide, code[size >= low])):
                found.update(dict(zip(*(x.tolist() for x in np.unique(chosen, return_counts=True)), strict=True)))
        codes = sorted(rows)
        yield pa.RecordBatch.from_arrays([pa.array([c // 3 for c in codes], pa.int32()), pa.array([c % 3 for c in codes], pa.int32()), pa.array([rows[c] for c in codes], pa.int64()), pa.array([wide[c] for c in codes], pa.int64())], ["part", "kind", "n", "wide"])

    return run


def meetings(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranges with their (documents, gaps) left, in order: (range of the gaps, first gap, range of the documents, first document, how many)."""
    out = []
    waiting: list[list[int]] = []
    for part in sorted(left):
        documents, gaps = left[part]
        at = 0
        while at < gaps and waiting:
            other, first, n = waiting[-1]
            m = min(n, gaps - at)
            out.append((part, at, other, first, m))
            at += m
            waiting[-1][1:] = [first + m, n - m]
            if m == n:
                waiting.pop()
        if documents:
            waiting.append([part, 0, documents])
    return out


def _meet(rest: DataFrame, found: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The rest of a sweep after ranges have met: pairs as PLACED rows, the others as they were."""
    import numpy as np

    taken: dict[int, int] = {}
    segments: dict[int, list[tuple[int, int, int, int]]] = {}
    for part, at, other, first, n in found:
        taken[part] = at + n
        segments.setdefault(other, []).append((first, n, part, at))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind, part, rank = (batch.column(k).to_numpy() for k in (0, 4, 5))
            to, nth = np.full(len(kind), -1, np.int32), np.zeros(len(kind), np.int64)
            for p in np.unique(part):
                here = (part == p) & (kind == GAP) & (rank < taken.get(int(p), 0))
                to[here], nth[here] = p, rank[here]
                if int(p) in segments:
                    first, n, target, at = np.array(segments[int(p)]).T
                    mine = np.flatnonzero((part == p) & (kind == DOCUMENT) & (rank < first[-1] + n[-1]))
                    k = np.searchsorted(first, rank[mine], side="right") - 1
                    to[mine], nth[mine] = target[k], at[k] + rank[mine] - first[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(to), pa.array(nth)], ["kind", "size", "key", "items", "meet", "nth"])

    ends = rest.mapInArrow(run, f"{SIDE}, meet int, nth long")
    bundles = ends.where((F.col("meet") >= 0) & (F.col("kind") == DOCUMENT)).select("meet", "nth", "items")
    gaps = ends.where((F.col("meet") >= 0) & (F.col("kind") == GAP)).select("meet", "nth", "size", "key")
    pairs = gaps.join(bundles, ["meet", "nth"]).select(F.lit(PLACED).alias("kind"), "size", "key", "items")
    return pairs.unionByName(ends.where("meet < 0").select("kind", "size", "key", "items"))


def _fresh(spark, first: int, n: int, capacity: int) -> DataFrame:
    """n empty sequences, numbered down from -1 - first."""
    return spark.range(first, first + n).select((-1 - F.col("id")).alias("key"), F.lit(capacity).cast("long").alias("size"))


def bands(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Descending (above, up to) bounds that hold every length: narrow ones first, wide ones for the smallest lengths."""
    out = []
    left = sorted(set(lengths), reverse=True)
    while left:
        high = left[0]
        cut = high * 4 // 5 if high > capacity // 16 else high // 4
        out.append((cut, high))
        left = [s for s in left if s <= cut]
    return out


def place(sizes: DataFrame, capacity: int, most: int = RANGE) -> DataFrame:
    """p, sequence_id and offset for written rows of (p, length), p unique and lengths from 1 to `capacity`; ranges of about `most` rows."""
    spark = sizes.sparkSession
    counts = {r["length"]: r["count"] for r in sizes.groupBy("length").count().collect()}  # at most `capacity` numbers
    total, opened = sum(s * n for s, n in counts.items()), sum(n for s, n in counts.items() if 2 * s > capacity)
    large = 2 * F.col("length") > capacity
    gaps = sizes.where(large).select(F.col("p").alias("key"), (capacity - F.col("length")).alias("size"))
    done = [sizes.where(large).select("p", F.col("p").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    fresh = max(0, -(-total // capacity) - opened)
    if fresh:
        gaps = gaps.unionByName(_fresh(spark, 0, fresh, capacity))
    small = {s: n for s, n in counts.items() if 2 * s <= capacity}
    top = max(1, capacity // 2)
    widest = capacity  # no gap is larger
    for cut, high in bands(list(small), capacity):
        documents = sizes.where((F.col("length") > cut) & (F.col("length") <= high)).select("p", F.col("length").alias("l"))
        band = {s: n for s, n in small.items() if cut < s <= high}
        tokens, low = sum(s * n for s, n in band.items()), min(band)
        limit, stuck, left = top, False, True
        while left:
            if stuck or widest < low:
                n = -(-tokens // capacity)
                gaps, fresh, widest, limit, stuck = gaps.unionByName(_fresh(spark, fresh, n, capacity)), fresh + n, capacity, top, False
            limit = min(limit, widest)
            if limit < 2 * low:
                limit = 1
            bundles = documents.mapInArrow(glue(limit), SIDE)
            open_gaps = gaps.where(F.col("size") >= min(small)).select(F.lit(GAP).alias("kind"), "size", "key", F.array().cast(ITEMS).alias("items"))
            ranged = in_ranges(bundles.unionByName(open_gaps), most)
            swept = materialise(ranged.groupBy("part").applyInArrow(_sweep, f"{SIDE}, part int, rank long"), "swept")
            rest: dict[int, list[int]] = {}
            seen, wide = [0, 0, 0], 0
            for r in swept.select("part", "kind", "size").mapInArrow(tally(low), "part int, kind int, n long, wide long").collect():  # three rows a range and file
                seen[r["kind"]] += r["n"]
                if r["kind"] != PLACED:
                    rest.setdefault(r["part"], [0, 0])[r["kind"]] += r["n"]
                if r["kind"] != DOCUMENT:
                    wide += r["wide"]
            found = meetings({k: (v[0], v[1]) for k, v in rest.items()})
            met = sum(m[-1] for m in found)
            matched = seen[PLACED] + met
            few = matched * TAIL < min(seen[DOCUMENT] + seen[PLACED], wide)
            after = swept.where(F.col("kind") != PLACED)
            after = materialise(_meet(after, found), "met") if found else after.select("kind", "size", "key", "items")
            placed = swept.where(F.col("kind") == PLACED).select("kind", "size", "key", "items").unionByName(after.where(F.col("kind") == PLACED))
            done.append(placed.select("key", "size", F.explode("items").alias("i")).select(F.col("i.p").alias("p"), F.col("key").alias("sequence_id"), (capacity - F.col("size") + F.col("i.o")).alias("offset")))
            last = F.element_at("items", -1)
            gaps = after.where(F.col("kind") == GAP).select("key", "size").unionByName(placed.select("key", (F.col("size") - last["o"] - last["l"]).alias("size")))
            left = seen[DOCUMENT] > met
            if not left:
                continue
            documents = after.where(F.col("kind") == DOCUMENT).select(F.explode("items").alias("i")).select("i.p", "i.l")
            if limit > 1:
                limit = max(1, limit // 2) if few else limit
            elif not matched:
                stuck = True
            elif few:
                limit = top
            sizes_left = documents.select("l", F.lit(0).cast("long").alias("gap")).unionByName(gaps.select(F.lit(None).cast("long").alias("l"), F.col("size").alias("gap")))
            tokens, low, widest = sizes_left.agg(F.sum("l"), F.min("l"), F.max("gap")).first()
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` must be a written table with a number of its own in each row's `p`; it is read several times."""
    return pieces.join(place(pieces.select("p", "length"), capacity), "p").drop("p")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the end token; rows that repeat an id or have none are packed each on its own; very
    long texts are cut into pieces of `capacity`; other columns are not read, whatever their names; an empty table gives an empty
    result. Sequences have any numbers; their pieces leave no gap.
    """
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity).withColumn("p", F.monotonically_increasing_id())
    return pack_pieces(materialise(pieces, "token-pieces"), capacity)
