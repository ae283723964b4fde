"""LM scoring with a hierarchical Pitman-Yor model whose contexts are whole words.

Restaurants: one for every word that comes before another (and one for the start of a text), above them one for all words, and a
uniform base over the known words and one unknown word. A word's customers in a restaurant sit at tables; each table is a
customer in the parent. The seating is sampled: in a sweep every pair of context and word takes its customers out and seats them
again one by one, at an old table in proportion to (customers - discount x tables) or at a new one in proportion to
(strength + discount x all tables) x the parent's probability, given the totals of the last sweep; after the burn-in each sweep
leaves a sample, and predictions are averaged over the samples.

No word is left to a class. Words are told apart by 63 bits of their hash. The most frequent ones have numbers, so that they travel
in few bytes, and their totals, a bounded table, go to every task. A pair lies in the bucket of its rare word, where that word's
totals are summed up; pairs of two frequent words are dealt by both. A pair of two rare words lies with its context and with its
word: both tell their totals after each sweep, a join of the two seats the pair, and both get its tables. Documents that have such a
pair ask for its context's totals first and go on to its word. Documents send runs of (pair, document) to the buckets, never whole
texts, and get back partial sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, mix, small_or_shuffled, spans, text_chunks, word_hashes

CODE_BITS = 18
#: Words that have a number; the start and the end of a text always do.
FREQUENT = (1 << CODE_BITS) - 2
BURN_IN, SAMPLES = 1, 3
STRENGTH = 1.0
#: The top bit is set in hashes, not in numbers.
TOP = np.uint64(1 << 63)
START, END = TOP | np.uint64(0x57A7), TOP | np.uint64(0x5EED)
_CODE, _PAIR = np.uint64(CODE_BITS), np.uint64(2 * CODE_BITS)
_LOW = np.uint64((1 << CODE_BITS) - 1)
#: Tokens that a task holds before it sends them. Buckets: 64 at least, 512 from so many tokens each on, more from as many as the last each on.
HELD, FEW_TOKENS, MANY_TOKENS = 3_000_000, 250_000, 2_000_000
#: What a row of a bucket has: the model's pairs of frequent words, its other pairs and its words, the tables of the sweeps, runs of
#: documents by pairs of frequent words, by other pairs, and with the totals of a rare context, and what documents know themselves.
PAIRS, OTHERS, WORDS, SEATS, EVENTS, ODD, FAR, DOCS = range(8)
ROWS = "bucket int, kind int, data binary"


def pack(*columns: np.ndarray, base: int = 0) -> bytes:
    """Columns of equal length, byte by byte, compressed; base: a number to go with them."""
    import pyarrow as pa

    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() if n else b"" for c in columns)
    return n.to_bytes(8, "little") + int(base).to_bytes(8, "little", signed=True) + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    """The columns of pack(), of these numpy types."""
    import pyarrow as pa

    n, types = int.from_bytes(data[:8], "little"), [np.dtype(k) for k in kinds.split()]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[16:], n * sum(t.itemsize for t in types)) if n else b"", np.uint8)
    out, at = [], 0
    for t in types:
        out.append(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T.copy().view(t).reshape(n))
        at += n * t.itemsize
    return out


def base_of(data: bytes) -> np.uint64:
    return np.frombuffer(data[8:16], np.uint64)[0]


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted values, the first from zero; np.cumsum undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def rows_of(rows: list[tuple[int, int, bytes]]):
    """An Arrow batch of ROWS."""
    import pyarrow as pa

    bucket, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def buckets_of(batches):
    """(bucket, [(kind, data)]) of sorted rows, one bucket after the other."""
    now, held = None, []
    for batch in batches:
        for bucket, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((kind, data))
    if held:
        yield now, held


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.select("bucket", "kind", "data").repartition("bucket").sortWithinPartitions("bucket", "kind")


class Numbers:
    """Numbers of the frequent words: places in the sorted table of their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.first = None

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """The number of each frequent word, the hash of any other."""
        if self.first is None:  # where each value of the 20 highest bits begins
            self.first = np.searchsorted(self.hashes ^ TOP, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(43))
        part = ((words ^ TOP) >> np.uint64(43)).astype(np.int64)
        at, end, out = self.first[part], self.first[part + 1], words.copy()
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.hashes[at[todo]] == words[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def __getstate__(self):
        return {"hashes": self.hashes, "first": None}


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and text of all tokens of some texts; the context is the whole word before, or the start; an end per text."""
    starts, ends, doc = spans(data, offsets)
    words = word_hashes(data, starts, ends) | TOP
    texts = len(offsets) - 1
    before = np.full(len(words), START)
    if len(words):
        follows = doc[1:] == doc[:-1]
        before[1:][follows] = words[:-1][follows]
    closing = np.full(texts, START)
    closing[doc] = words  # the last word of a text wins
    return np.concatenate([before, closing]), np.concatenate([words, np.full(texts, END)]), np.concatenate([doc, np.arange(texts)])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of every word and how often it occurs, ends included."""

    def run(batches):
        import pyarrow as pa

        def out(kept):
            words = np.sort(np.concatenate(kept))
            at = runs(words)
            return pa.RecordBatch.from_arrays([pa.array(words[at].view(np.int64)), pa.array(lengths(at, len(words)))], ["word", "n"])

        kept, held = [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), True):
                kept.append(events(data, offsets)[1])
                held += len(kept[-1])
                if held > HELD:
                    yield out(kept)
                    kept, held = [], 0
        if kept:
            yield out(kept)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most so many words, by a count that as many reach, and of the start and the end; sorted by hash."""
    least, n = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect():
        n += r["words"]
        if n > most:
            break
        least = r["n"]
    found = {int(np.uint64(START)): 0, int(np.uint64(END)): 0}
    ends = counts.where(F.col("word") == int(END.view(np.int64)))
    chosen = ends if least is None else counts.where(F.col("n") >= least).unionByName(ends)
    table = chosen.toArrow()
    words, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    found |= dict(zip(words.tolist(), n.tolist(), strict=True))
    hashes = np.array(sorted(found), np.uint64)
    return hashes, np.array([found[h] for h in hashes.tolist()], np.int64)


def dealt(u: np.ndarray, w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, whether the home is the word, home, other) of pairs that are not of two frequent words. The home is a rare word, of two the context."""
    side = u < TOP
    home, other = np.where(side, w, u), np.where(side, u, w)
    return (mix(home) >> np.uint64(64 - bits)).astype(np.int64), side.astype(np.uint8), home, other


def parts(bucket: np.ndarray):
    """(bucket, slice) of sorted buckets."""
    at = runs(bucket)
    for b, start, end in zip(bucket[at].tolist(), at.tolist(), (at + lengths(at, len(bucket))).tolist(), strict=True):
        yield b, slice(start, end)


def pair_counts(docs: DataFrame, numbers: Numbers, bits: int) -> DataFrame:
    """ROWS of kinds PAIRS and OTHERS with the counts of pairs, combined per task. Pairs of two rare words are sent to both."""

    def run(batches):
        def out(kept):
            u, w = (np.concatenate(x) for x in zip(*kept, strict=True))
            near = (u | w) < TOP
            key = u[near] << _CODE | w[near]
            key = np.sort(mix(key) >> np.uint64(64 - bits) << _PAIR | key)
            at = runs(key)
            key, n = key[at], lengths(at, len(key)).astype(np.uint32)
            found = [(b, PAIRS, pack(steps(key[s] & np.uint64((1 << 2 * CODE_BITS) - 1)), n[s])) for b, s in parts(key >> _PAIR)]
            u, w = u[~near], w[~near]
            far = (u & w) >= TOP
            columns = [np.concatenate(x) for x in zip(dealt(u, w, bits), mirrored(u[far], w[far], bits), strict=True)]
            order = np.lexsort(columns[::-1])
            bucket, side, home, other = (c[order] for c in columns)
            at = runs_of(bucket, side, home, other)
            n, (bucket, side, home, other) = lengths(at, len(bucket)).astype(np.uint32), (c[at] for c in (bucket, side, home, other))
            found += [(b, OTHERS, pack(side[s], home[s], other[s], n[s])) for b, s in parts(bucket)]
            return rows_of(found)

        kept, held = [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), True):
                u, w, _ = events(data, offsets)
                kept.append((numbers(u), numbers(w)))
                held += len(u)
                if held > HELD:
                    yield out(kept)
                    kept, held = [], 0
        if held:
            yield out(kept)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, ROWS)


def mirrored(u: np.ndarray, w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """dealt() for pairs of two rare words, with the word as home."""
    return (mix(w) >> np.uint64(64 - bits)).astype(np.int64), np.ones(len(w), np.uint8), w, u


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], new])) if len(columns[0]) else np.zeros(0, np.int64)


#: Columns of what the sweeps need: of pairs seen more than once (multiple: context, word, which of them is a place in the bucket's words,
#: 2 if none, customers; far ones, of two rare words: side, place, home, other, customers), of the bucket's words (distinct followers,
#: contexts), and of what it tells of its far pairs (context, word, customers, tables, tables of the context, customers and tables of the word).
MULTIPLE, FARS, HOMES, TOLD = "u4 u4 u1 u8", "u1 u4 u8 u8 u4", "u4 u4", "u8 u8 u4 u4 u4 u4 u4"


def model_of(counted: DataFrame) -> DataFrame:
    """One row a bucket: its pairs, others and words (the kinds of these names), what the sweeps need of them, and sums: codes with their
    distinct followers and contexts, and numbers for the discounts and totals."""

    def run(batches):
        import pyarrow as pa

        for bucket, rows in buckets_of(batches):
            near = [unpack(d, "u8 u4") for k, d in rows if k == PAIRS]
            key = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(x[0], dtype=np.uint64) for x in near)])
            n = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in near)])
            order = np.argsort(key)
            at = runs(key[order])
            key, n = key[order][at], np.add.reduceat(n[order], at) if len(at) else n
            odd = [unpack(d, "u1 u8 u8 u4") for k, d in rows if k == OTHERS]
            side, home, other, m = (np.concatenate([np.zeros(0, t), *(x[i] for x in odd)]) for i, t in enumerate("u1 u8 u8 i8".split()))
            order = np.lexsort((other, home, side))
            at = runs_of(side[order], home[order], other[order])
            m = np.add.reduceat(m[order], at) if len(at) else m
            side, home, other = side[order][at], home[order][at], other[order][at]
            words, home = np.unique(home, return_inverse=True)
            far = other >= TOP
            twice, also = n > 1, (m > 1) & ~far
            code = np.where(far, 0, other).astype(np.uint32)
            multiple = pack(
                np.concatenate([(key[twice] >> _CODE).astype(np.uint32), np.where(side == 0, home, code)[also].astype(np.uint32)]),
                np.concatenate([(key[twice] & _LOW).astype(np.uint32), np.where(side == 0, code, home)[also].astype(np.uint32)]),
                np.concatenate([np.full(twice.sum(), 2, np.uint8), side[also]]),
                np.concatenate([n[twice], m[also]]),
            )
            fars = far & (m > 1)
            fars = [side[fars], home[fars].astype(np.uint32), words[home[fars]], other[fars], m[fars].astype(np.uint32)]
            homes = [np.bincount(home[side == k], minlength=len(words)).astype(np.uint32) for k in (0, 1)]
            told = told_of(fars, np.ones(len(fars[0])), homes[0], homes[1], np.minimum(homes[1], 1))
            before, after = np.concatenate([key >> _CODE, other[(side == 1) & ~far]]), np.concatenate([key & _LOW, other[(side == 0) & ~far]])
            codes, sums = sparse(before, np.ones(len(before)), after, np.ones(len(after)))
            once = (side == 0) | ~far  # a pair of two rare words lies in two buckets
            numbers = [*[(n == k).sum() + (m[once] == k).sum() for k in (1, 2)], homes[1].sum(), (homes[1] > 0).sum(), *[(homes[1] == k).sum() for k in (1, 2)]]
            blobs = [pack(steps(key), n), pack(side, home.astype(np.uint32), other, m), pack(steps(words)), multiple, pack(*fars), pack(*homes), told]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs), *listed(codes, sums, numbers)], [x.split()[0] for x in MODEL.split(", ")])

    return by_bucket(counted).mapInArrow(run, MODEL)


LISTS = "codes array<int>, followers array<int>, contexts array<int>, numbers array<double>"
MODEL = f"bucket int, pairs binary, others binary, words binary, multiple binary, fars binary, homes binary, told binary, {LISTS}"


def told_of(fars, tables, follow, n, s) -> bytes:
    """What a bucket tells of its far pairs: zeros for what their other word's bucket knows."""
    side, place, home, other, c = fars
    first = side == 0
    known = [np.where(first, follow[place], 0), np.where(first, 0, n[place]), np.where(first, 0, s[place])]
    return pack(np.where(first, home, other), np.where(first, other, home), c, *(x.astype(np.uint32) for x in (tables, *known)))


def far_seats(seats: DataFrame, new: int, totals: Totals, seed: int, bits: int) -> DataFrame:
    """(bucket, drawn): the pairs of two rare words seated again, given the last totals that both buckets tell; those with one table, nearly all, are left out."""
    names = ["u", "w", "c", "tables", "follow", "n", "s"]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.itemsize == 8 else x.astype(np.int64)) for x in unpack(data, TOLD)], names)

    def draw(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, new, 1, TaskContext.get().partitionId()])
        kept = []
        for batch in batches:
            u, w, c, t, follow, n, s = (x.to_numpy() for x in batch.columns)
            u, w = u.view(np.uint64), w.view(np.uint64)
            t = totals.seated(rng, c, t, follow, totals.above(n, s)).astype(np.uint32)
            u, w, t = u[t > 1], w[t > 1], t[t > 1]
            kept += [(*dealt(u, w, bits), t), (*mirrored(u, w, bits), t)]
        if sum(len(x[0]) for x in kept):
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            bucket, *columns = (x[order] for x in columns)
            yield rows_of([(b, SEATS, pack(*(x[part] for x in columns))) for b, part in parts(bucket)])

    told = seats.select("told").mapInArrow(rows, ", ".join(f"{x} long" for x in names))
    pairs = told.groupBy("u", "w").agg(*[F.max(x).alias(x) for x in names[2:]]).sortWithinPartitions("u", "w")
    return pairs.mapInArrow(draw, ROWS).groupBy("bucket").agg(F.collect_list("data").alias("drawn"))


def sparse(u, a, w, b) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes with sums of a by u and of b by w that are not both zero."""
    a, b = (np.bincount(np.asarray(i, np.int64), x, 1 << CODE_BITS) for i, x in ((u, a), (w, b)))
    codes = np.flatnonzero((a != 0) | (b != 0))
    return codes, [a[codes], b[codes]]


def listed(codes, sums, numbers) -> list:
    """The columns LISTS of one row."""
    import pyarrow as pa

    return [*(pa.array([np.asarray(x, np.int32)], pa.list_(pa.int32())) for x in (codes, *sums)), pa.array([np.asarray(numbers, float)], pa.list_(pa.float64()))]


def gathered(table: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of LISTS over all buckets: followers and contexts by code, and the numbers."""
    each = table.select(F.explode(F.arrays_zip("codes", "followers", "contexts")).alias("x")).select("x.*").groupBy("codes").agg(F.sum("followers"), F.sum("contexts")).toArrow()
    codes, *sums = (c.to_numpy().astype(np.int64) for c in each.columns)
    out = np.zeros((2, words), np.int64)
    out[:, codes] = sums
    numbers = np.zeros(6)
    for r in table.select(F.posexplode("numbers").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        numbers[r["i"]] = r["v"]
    return out[0], out[1], numbers


def seat(rng: np.random.Generator, customers: np.ndarray, discount: float, fresh: np.ndarray) -> np.ndarray:
    """Tables after seating so many customers of each word again. fresh: (strength + discount x other tables) x parent's probability.

    One customer at a time up to 32, then in blocks of a sixteenth within which the chance of a new table is held.
    """
    tables = np.minimum(customers, 1)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order], kind="stable")]
    left, c, t, f = len(order), customers[order], tables[order], fresh[order]
    seated = 1
    while left:
        block = 1 if seated < 32 else seated // 16
        left = int(np.searchsorted(-c, -seated))  # those with more customers than are seated
        if not left:
            break
        n = np.minimum(block, c[:left] - seated)
        chance = f[:left] / (f[:left] + seated - discount * t[:left])
        t[:left] += (rng.random(left) < chance) if block == 1 else rng.binomial(n, np.minimum(chance, 1.0))
        seated += block
    tables[order] = t
    return tables


def discount_of(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


class Totals:
    """Totals after a seating. c, t: customers and tables of the frequent contexts; root: the probability of the frequent words above
    all contexts, where all words have N customers at S tables; base: the uniform probability; d: discounts of contexts and above them."""

    def __init__(self, c, t, n, s, N, S, base, d):
        self.c, self.t, self.N, self.S, self.base, self.d = c, t, float(N), float(S), base, d
        self.root = self.above(n, s)

    def above(self, n, s):
        """The probability of words with so many customers and tables above all contexts."""
        return (n - self.d[1] * s + (STRENGTH + self.d[1] * self.S) * self.base) / (STRENGTH + self.N)

    def seated(self, rng, c, t, tables, parent):
        """Tables of pairs with c customers after these are seated again; so far they have t tables of all of their context's."""
        # What the customers of this restaurant themselves put into the parent does not count.
        others = np.maximum(parent - (1 - self.d[1]) * t / (STRENGTH + self.N), 1e-3 * parent)
        return seat(rng, c, self.d[0], (STRENGTH + self.d[0] * np.maximum(tables - t, 0)) * others)

    def back(self, c, t):
        """The mass that a context with so many customers and tables gives to the restaurant above."""
        return (STRENGTH + self.d[0] * t) / (STRENGTH + c)


def sweep(seats: DataFrame, past: int, new: int, totals: Totals, seed: int, kept: int) -> DataFrame:
    """Seat all customers again, given the last seating (the last of the past columns of `seats`; none: one table for each pair and
    word), its totals, and the tables drawn for pairs of two rare words. The first `kept` of the past columns are samples and stay."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                u, w, side, c = (x.astype(np.int64) for x in unpack(row["multiple"], MULTIPLE))
                fars, homes = unpack(row["fars"], FARS), [x.astype(np.int64) for x in unpack(row["homes"], HOMES)]
                columns = unpack(row["seats"], "u4 " * past) if past else []
                last = columns[-1].astype(np.int64) if past else np.concatenate([np.ones(len(c) + len(fars[0]), np.int64), np.minimum(homes[1], 1)])
                t, far, s = np.split(last, [len(c), len(c) + len(fars[0])])
                in_u, in_w = side == 0, side == 1  # the context, the word is one of the bucket's

                def at_home(t, far):
                    """Tables of the bucket's words as contexts, and their customers above."""
                    return [h + np.bincount(x[of], t[of] - 1, len(h)).astype(np.int64) + np.bincount(fars[1][fars[0] == k], far[fars[0] == k] - 1, len(h)).astype(np.int64) for k, h, x, of in zip((0, 1), homes, (u, w), (in_u, in_w), strict=True)]

                rng = np.random.default_rng([seed, new, row["bucket"]])
                follow, n = at_home(t, far)
                tables, parent = totals.t[np.where(in_u, 0, u)].astype(float), totals.root[np.where(in_w, 0, w)]
                tables[in_u], parent[in_w] = follow[u[in_u]], totals.above(n, s)[w[in_w]]
                t = totals.seated(rng, c, t, tables, parent)
                far = drawn_tables(row["drawn"], fars)
                follow, n = at_home(t, far)
                s = seat(rng, n, totals.d[1], (STRENGTH + totals.d[1] * np.maximum(totals.S - s, 0)) * totals.base)
                codes, sums = sparse(u[~in_u], t[~in_u] - 1, w[~in_w], t[~in_w] - 1)
                blobs = [row["multiple"], row["fars"], row["homes"], told_of(fars, far, follow, n, s), pack(*columns[:kept], np.concatenate([t, far, s]).astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), *listed(codes, sums, [n.sum(), s.sum()])], [x.split()[0] for x in SWEPT.split(", ")])

    return seats.select("bucket", "multiple", "fars", "homes", *(["seats"] if past else []), "drawn").mapInArrow(run, SWEPT)


def drawn_tables(drawn: list[bytes] | None, fars) -> np.ndarray:
    """The tables of the bucket's far pairs: one each but for the drawn ones."""
    tables = np.ones(len(fars[0]), np.int64)
    names = named(fars[0], fars[2], fars[3])
    order = np.argsort(names)
    for blob in drawn or []:
        side, home, other, t = unpack(blob, "u1 u8 u8 u4")
        tables[order[np.searchsorted(names[order], named(side, home, other))]] = t
    return tables


def named(side: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A hash of a pair within its bucket."""
    return mix(mix(home) + other) ^ (side.astype(np.uint64) << np.uint64(63))


SWEPT = f"bucket int, multiple binary, fars binary, homes binary, told binary, seats binary, {LISTS}"


def sampled(model: DataFrame, c: np.ndarray, base: float, burn_in: int, samples: int, seed: int, bits: int) -> tuple[DataFrame, list[Totals]]:
    """(seats, the totals of each sample): a row a bucket, whose `seats` has a column of tables for each sample."""
    followers, contexts, numbers = gathered(model, len(c))
    ones, twos = (numbers[4 + k] + np.sum(contexts == k + 1) for k in (0, 1))
    d = discount_of(*numbers[:2]), discount_of(ones, twos)
    s = np.minimum(contexts, 1)
    totals = Totals(c, followers, contexts, s, contexts.sum() + numbers[2], s.sum() + numbers[3], base, d)
    seats, past, kept = model, 0, []
    for new in range(1, burn_in + samples + 1):
        drawn = materialise(far_seats(seats, new, totals, seed, bits), "lm-far")
        seats = materialise(sweep(seats.join(drawn, "bucket", "left"), past, new, totals, seed, len(kept)), "lm-seats")
        past = len(kept) + 1
        t, n, numbers = gathered(seats, len(c))
        t, n = followers + t, contexts + n
        s = seat(np.random.default_rng([seed, new]), n, d[1], (STRENGTH + d[1] * np.maximum(totals.S - s, 0)) * base)
        totals = Totals(c, t, n, s, n.sum() + numbers[0], s.sum() + numbers[1], base, d)
        if new > burn_in:
            kept.append(totals)
    return seats, kept


class Bucket:
    """What a bucket's rows tell. key, gain and names, more: pairs, and their customers less discounted tables summed over the samples; of
    its words c, n: customers as contexts, occurrences, and for each sample t, above: tables, probability above; an unknown word comes last."""

    def __init__(self, rows: list[tuple[int, bytes]], totals: list[Totals]):
        blobs = dict(rows)
        nothing = pack(np.zeros(0, np.uint8))
        key, n = unpack(blobs.get(PAIRS, nothing), "u8 u8")
        self.side, self.home, self.other, m = unpack(blobs.get(OTHERS, nothing), "u1 u4 u8 u8")
        self.words = np.cumsum(unpack(blobs.get(WORDS, nothing), "u8")[0], dtype=np.uint64)
        n, m, d = n.astype(float), m.astype(float), totals[0].d[0]
        far = self.other >= TOP
        odd = np.concatenate([np.flatnonzero((m > 1) & ~far), np.flatnonzero((m > 1) & far)])  # as the sweeps have them
        self.c, self.n = self.summed(0, m), self.summed(1, m)
        self.t, self.above, gain, more = [], [], len(totals) * n, len(totals) * m
        columns = unpack(blobs[SEATS], "u4 " * len(totals)) if SEATS in blobs else [np.zeros(0, np.uint32)] * len(totals)
        for sample, column in zip(totals, columns, strict=True):
            column = column.astype(float)
            column, s = np.split(column, [len(column) - len(self.words)])
            t = np.ones(len(m))
            t[odd] = column[len(column) - len(odd) :]
            self.t.append(self.summed(0, t))
            self.above.append(sample.above(self.summed(1, t), np.append(s, 0)))
            more = more - d * t
            if len(n):
                t = np.ones(len(n))
                t[n > 1] = column[: len(column) - len(odd)]
                gain = gain - d * t
        self.key, self.gain = np.cumsum(key, dtype=np.uint64), gain
        names = named(self.side, self.words[self.home], self.other)
        order = np.argsort(names)
        self.names, self.more = names[order], more[order]

    def summed(self, side: int, values: np.ndarray) -> np.ndarray:
        """Sums over the pairs whose home is the context (0) or the word (1), by home."""
        mine = self.side == side
        return np.bincount(self.home[mine], values[mine], len(self.words) + 1)

    def place(self, words: np.ndarray) -> np.ndarray:
        return matched(self.words, words, len(self.words))


def gained(gains: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Customers less discounted tables of pairs, zero for those that are not known."""
    return np.append(gains, 0.0)[matched(keys, wanted, len(keys))]


def matched(have: np.ndarray, wanted: np.ndarray, none: int) -> np.ndarray:
    """Places in a sorted table."""
    if not len(have):
        return np.full(len(wanted), none)
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    return np.where(have[at] == wanted, at, none)


def occurrences(docs: DataFrame, numbers: Numbers, bits: int, logs: np.ndarray, known: np.ndarray, far: bool) -> DataFrame:
    """ROWS of which documents have which pairs and how often. docs: from keyed(). logs, known: of frequent words, base score and whether it
    is known. far: only the pairs of two rare words, else the others and what a document knows itself (kind DOCS)."""
    local_bits = np.uint64(64 - 2 * CODE_BITS - bits)

    def run(batches):
        def out(kept, ids):
            ids = np.concatenate(ids)
            u, w, doc = (np.concatenate(x) for x in zip(*kept, strict=True))
            base = ids.min()
            away = (ids.view(np.uint64) - np.uint64(base.view(np.uint64))).astype(np.uint64)
            found = []
            if not far:
                of = w < TOP
                sums = [np.bincount(doc, minlength=len(ids)), np.bincount(doc[of], known[w[of]], len(ids)), np.bincount(doc[of], logs[w[of]], len(ids))]
                found.append((int(mix(ids[:1].view(np.uint64))[0] >> np.uint64(64 - bits)), DOCS, pack(away, sums[0].astype(np.uint32), sums[1].astype(np.uint32), sums[2], base=base)))
                near = (u | w) < TOP
                key = u[near] << _CODE | w[near]
                key = np.sort((mix(key) >> np.uint64(64 - bits) << _PAIR | key) << local_bits | doc[near].astype(np.uint64))
                at = runs(key)
                n, key = lengths(at, len(key)).astype(np.uint32), key[at]
                ids_at = away[(key & ((np.uint64(1) << local_bits) - np.uint64(1))).astype(np.int64)]
                key = key >> local_bits
                found += [(b, EVENTS, pack(steps(key[x] & np.uint64((1 << 2 * CODE_BITS) - 1)), ids_at[x], n[x], base=base)) for b, x in parts(key >> _PAIR)]
            odd = (u & w) >= TOP if far else ((u | w) >= TOP) & ((u & w) < TOP)
            columns = [*dealt(u[odd], w[odd], bits), doc[odd]]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            at = runs_of(*columns)
            n, (bucket, side, home, other, doc) = lengths(at, len(order)).astype(np.uint32), (c[at] for c in columns)
            found += [(b, ODD, pack(side[x], home[x], other[x], away[doc[x]], n[x], base=base)) for b, x in parts(bucket)]
            return rows_of(found) if found else None

        kept, ids, held, texts = [], [], 0, 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for row, data, offsets in text_chunks(batch.column(1), True):
                size = len(offsets) - 1
                if held and (held > HELD or texts + size > 1 << int(local_bits)):
                    if (rows := out(kept, ids)) is not None:
                        yield rows
                    kept, ids, held, texts = [], [], 0, 0
                for first in range(0, size, 1 << int(local_bits)):  # a chunk of more texts than a run can number
                    last = min(size, first + (1 << int(local_bits)))
                    if first and (rows := out(kept, ids)) is not None:
                        yield rows
                    if first:
                        kept, ids, held, texts = [], [], 0, 0
                    u, w, doc = events(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                    u, w = numbers(u), numbers(w)
                    if far:
                        odd = (u & w) >= TOP
                        u, w, doc = u[odd], w[odd], doc[odd]
                    kept.append((u, w, doc + texts))
                    ids.append(keys[row + first : row + last])
                    held += len(doc) + (last - first)
                    texts += last - first
        if kept and (rows := out(kept, ids)) is not None:
            yield rows

    return docs.select("key", "text").mapInArrow(run, ROWS)


def far_rows(model: DataFrame, seats: DataFrame, asked: DataFrame, totals: list[Totals], bits: int) -> DataFrame:
    """Runs of pairs of two rare words, which came to their contexts, sent on to the words with the contexts' totals (kind FAR)."""

    def run(batches):
        def out(kept):
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            bucket = (mix(columns[0]) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            return rows_of([(b, FAR, pack(*(c[order][x] for c in columns))) for b, x in parts(bucket[order])])

        kept, held = [], 0
        for _, rows in buckets_of(batches):
            events = [data for kind, data in rows if kind == ODD]
            if not events:
                continue
            found = Bucket([r for r in rows if r[0] != ODD], totals)
            for data in events:
                _, home, other, doc, n = unpack(data, "u1 u8 u8 u8 u4")
                at = found.place(home)
                kept.append((other, home, doc + base_of(data), n, found.c[at].astype(np.uint64), *(t[at].astype(np.uint32) for t in found.t)))
                held += len(home)
            if held > HELD // 4:
                yield out(kept)
                kept, held = [], 0
        if held:
            yield out(kept)

    return by_bucket(asked.unionByName(model_rows(model, seats, {OTHERS: "others", WORDS: "words"}))).mapInArrow(run, ROWS)


def model_rows(model: DataFrame, seats: DataFrame, columns: dict[int, str]) -> DataFrame:
    """Columns of the model and the tables of the samples as ROWS."""
    rows = seats.select("bucket", F.lit(SEATS).alias("kind"), F.col("seats").alias("data"))
    for kind, name in columns.items():
        rows = rows.unionByName(model.select("bucket", F.lit(kind).alias("kind"), F.col(name).alias("data")))
    return rows


#: Parcels of documents in which the partial sums travel: a row a parcel, not a row a document.
PARCELS = 1024
SUMS = "u8 u4 u4 f8 f8"


def score_events(rows: DataFrame, totals: list[Totals], tokens: int, words: int) -> DataFrame:
    """Partial sums by document of n_tokens, n_known, base_score and score, packed into parcels of documents. rows: the model's and the documents'."""
    many, c, d = len(totals), totals[0].c, totals[0].d[0]

    def run(batches):
        import pyarrow as pa

        backs = [t.back(t.c, t.t) for t in totals]

        def summed(parts):
            ids, values = np.concatenate([p[0] for p in parts]), [np.concatenate(v) for v in zip(*(p[1:] for p in parts), strict=True)]
            ids, at = np.unique(ids, return_inverse=True)
            return ids, *(np.bincount(at, v, len(ids)) for v in values)

        def out(part):
            parcel = (mix(part[0].view(np.uint64)) % np.uint64(PARCELS)).astype(np.int64)
            order = np.argsort(parcel, kind="stable")
            ids, *values = (column[order] for column in part)
            found = [(b, pack(steps(ids[x].view(np.uint64)), *(v[x].astype(k) for v, k in zip(values, SUMS.split()[1:], strict=True)))) for b, x in parts(parcel[order])]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["parcel", "sums"])

        def scored(found, kind, data):
            if kind == DOCS:
                away, *values = unpack(data, "u8 u4 u4 f8")
                return away + base_of(data), *values, np.zeros(len(away))
            if kind == EVENTS:
                key, away, n = unpack(data, "u8 u8 u4")
                key = np.cumsum(key, dtype=np.uint64)
                u, w = (key >> _CODE).astype(np.int64), (key & _LOW).astype(np.int64)
                p = gained(found.gain, found.key, key) / (STRENGTH + c[u])
                for t, back in zip(totals, backs, strict=True):
                    p += back[u] * t.root[w]
                return away + base_of(data), *np.zeros((3, len(n))), n * np.log10(p / many)
            if kind == ODD:
                side, home, other, away, n = unpack(data, "u1 u8 u8 u8 u4")
                at, code, of = found.place(home), other.astype(np.int64), side == 1
                customers = np.where(of, c[code], found.c[at])
                context = [np.where(of, back[code], t.back(found.c[at], tables[at])) for t, back, tables in zip(totals, backs, found.t, strict=True)]
                word = [np.where(of, above[at], t.root[code]) for t, above in zip(totals, found.above, strict=True)]
            else:
                home, other, away, n, customers, *tables = unpack(data, "u8 u8 u8 u4 u8" + " u4" * many)
                at, side, of = found.place(home), np.ones(len(home), np.uint8), np.ones(len(home), bool)
                context = [t.back(customers.astype(float), x) for t, x in zip(totals, tables, strict=True)]
                word = [above[at] for above in found.above]
            p = gained(found.more, found.names, named(side, home, other)) / (STRENGTH + customers) + sum(a * b for a, b in zip(context, word, strict=True))
            seen = found.n[at]
            base = np.where(of, n * np.log10((seen + 1) / (tokens + words + 1)), 0.0)
            return away + base_of(data), np.zeros(len(n)), n * (of & (seen > 0)), base, n * np.log10(p / many)

        kept, held = [], 0
        for _, rows in buckets_of(batches):
            found = Bucket([r for r in rows if r[0] <= SEATS], totals)
            for kind, data in rows:
                if kind > SEATS:
                    ids, *values = scored(found, kind, data)
                    kept.append((ids.view(np.int64), *values))
                    held += len(ids)
                if held > 1_500_000:
                    kept = [summed(kept)]
                    held = len(kept[0][0])
                    if held > 750_000:
                        yield out(kept[0])
                        kept, held = [], 0
        if kept:
            yield out(summed(kept))

    return by_bucket(rows).mapInArrow(run, "parcel int, sums binary")


def summed_documents(parcels: DataFrame) -> DataFrame:
    """One row per document from parcels of partial sums."""

    def run(batches):
        import pyarrow as pa

        def add(parts):
            ids, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, at = np.unique(ids, return_inverse=True)
            return ids, *(np.bincount(at, v, len(ids)) for v in values)

        kept, held = [(np.zeros(0, np.int64), *[np.zeros(0)] * 4)], 0
        for batch in batches:
            for data in batch.column(1).to_pylist():
                ids, *values = unpack(data, SUMS)
                kept.append((np.cumsum(ids, dtype=np.uint64).view(np.int64), *(v.astype(float) for v in values)))
                held += len(ids)
                if held > 1_000_000:
                    kept, held = [add(kept)], 0
        ids, *values = add(kept)
        for k in range(0, len(ids), 100_000):
            tokens, known, base, score = (v[k : k + 100_000] for v in values)
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return parcels.repartition(F.col("parcel")).mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, text and key, a long by which partial sums meet: the id where only one row has it, else a hash of id and text.

    The second table has the keys that several rows share and how many (rows alike in id and text), or is None if there are none.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    repeated = materialise(repeated, "lm-repeated")
    if repeated.isEmpty():
        return rows.withColumn("key", F.col("doc_id").cast("long")), None
    flagged = rows.join(small_or_shuffled(repeated.withColumn("again", F.lit(True))), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    mixed = F.xxhash64(F.lit("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = flagged.select("doc_id", "text", F.when(F.col("again"), mixed).otherwise(F.col("doc_id").cast("long")).alias("key"))
    copies = rows.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows, materialise(copies, "lm-copies")


def score_documents(docs: DataFrame, train: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 11, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`, learning from `train`.

    Both have doc_id (a number) and text. Scores are log10 probabilities of the whole text with its end; `base_score` is that of the
    add-one unigram. Null and empty texts have one token, the end. Rows that share an id, or have none, are scored each by its own
    text; very long texts are read whole. Without training rows every token has probability 1 and both scores are 0. An empty table
    gives an empty result. Words are told apart by 63 bits of their hash, pairs by 64. Other columns, whatever their names, are not
    read. frequent: how many words have numbers; it changes what is sent, not which words are contexts.
    """
    if not 0 <= frequent <= FREQUENT:
        raise ValueError(f"at most {FREQUENT} words have numbers")
    counts = materialise(word_counts(train), "lm-words")
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hashes, n = frequent_words(counts, frequent)
    c = n.copy()
    c[np.searchsorted(hashes, START)] = n[np.searchsorted(hashes, END)]  # texts begin as often as they end
    bits = (max(64, min(512, tokens // FEW_TOKENS), tokens // MANY_TOKENS) - 1).bit_length()
    model = materialise(model_of(pair_counts(train, Numbers(hashes), bits)), "lm-pairs")
    seats, totals = sampled(model, c, 1 / (words + 1), burn_in, samples, seed, bits)
    rows, copies = keyed(docs)
    logs, known = np.log10((n + 1) / (tokens + words + 1)), (n > 0).astype(float)
    asked, others = (occurrences(rows, Numbers(hashes), bits, logs, known, far) for far in (True, False))
    parcels = score_events(model_rows(model, seats, {PAIRS: "pairs", OTHERS: "others", WORDS: "words"}).unionByName(others).unionByName(far_rows(model, seats, asked, totals, bits)), totals, tokens, words)
    sums = summed_documents(parcels)
    known = F.lit(int(tokens)).cast("long").alias("train_tokens")
    if copies is None:  # a row an id: the keys are the ids
        return sums.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", "n_known", known, "base_score", "score")
    out = rows.select("doc_id", "key").join(sums, F.col("key") == F.col("id")).join(small_or_shuffled(copies), F.col("key") == F.col("_key"), "left")
    share = F.coalesce("copies", F.lit(1))  # rows alike in id and text have summed up together
    return out.select("doc_id", *[(F.col(c) / share).cast("long").alias(c) for c in ("n_tokens", "n_known")], known, *[(F.col(c) / share).alias(c) for c in ("base_score", "score")])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_mod(id_col, 7) == 2, F.lit(False))
