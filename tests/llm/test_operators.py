"""The training-data operators against brute force on small fixtures with nulls, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, norm string, keep_id long, first long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), 0, "x", 0, 0) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = ["alpha", "beta", "gamma", "Delta", "the", "of", "über", "x"]
    out = [(i, " ".join(random.choices(words, k=random.randint(0, 40)))) for i in range(60)]
    out += [(100 + i, out[5][1]) for i in range(10)] + [(200, None), (201, ""), (202, " \t\n"), (203, "a  b\tc"), (204, "a b c"), (205, "word " * 3000)]
    return out


def test_exact_dedup(spark, texts):
    from pyspark.sql import functions as F

    from tidewire.llm.exact_dedup import exact_dedup

    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    groups = defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    for digest in (F.md5, lambda c: F.substring(F.md5(c), 1, 1)):  # the second collides all the time
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(documents(spark, texts), digest=digest).collect()}
        assert got == {i: (min(groups[n]), len(groups[n]), i == min(groups[n])) for i, n in norm.items()}
    assert exact_dedup(documents(spark, []).limit(0)).count() == 0
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (None, "a b"), (None, "z"), (None, "z"), (2, None), (3, "")]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == Counter([(1, 1, 3)] * 2 + [(1, 1, 1), (None, 1, 3)] + [(None, None, 2)] * 2 + [(2, 2, 2), (3, 2, 2)])
    assert Counter((r.keep_id, r.group_size) for r in out if r.kept) == Counter([(1, 3), (1, 1), (None, 2), (2, 2)])


def test_sharding(spark, texts):
    from tidewire.llm.sharding import assign_shards

    rows = assign_shards(documents(spark, texts), [1.0] * 8).collect()

    def best(key, n):
        u = [(shard_hash(key, s) >> 11) + 0.5 for s in range(n)]
        return min(range(n), key=lambda s: -math.log(u[s] / 2**53))

    def shard_hash(key, s):
        return xxhash.xxh64_intdigest(np.int32(s).tobytes(), xxhash.xxh64_intdigest(np.int64(key).tobytes(), 42))

    text = dict(texts)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), best(r.doc_id, 8), best(r.doc_id, 9))
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    weighted = Counter(r.shard for r in assign_shards(spark.range(4000).selectExpr("id as doc_id", "'' as text"), [3.0, 1.0]).collect())
    assert 2800 < weighted[0] < 3200


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    from tidewire.llm.simhash import near_groups

    random.seed(8)
    base = [f"w{random.randrange(900)}" for _ in range(220)]
    near = [(300 + k, " ".join(base[: 100 + k % 2] + [f"new{k}"] + base[101:])) for k in range(30)]
    rows = texts + near
    fp = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_groups(documents(spark, rows)).collect()}
    assert got == {i: (f"{fp[i]:016x}", root(i)) for i in fp}
    assert near_groups(documents(spark, []).limit(0)).count() == 0


def test_line_dedup(spark):
    from tidewire.llm.line_dedup import dedup_lines

    random.seed(1)
    base = "the quick brown fox jumps over the lazy dog and runs away"

    def edit(s, k=1):
        for _ in range(k):
            i, o, c = random.randrange(len(s)), random.choice("sid"), random.choice("abcxyz")
            s = s[:i] + c + s[i + 1 :] if o == "s" else s[:i] + c + s[i:] if o == "i" else s[:i] + s[i + 1 :]
        return s

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rows = [(d, "\n".join(random.choice([base, edit(base), edit(base), edit(base, 2), edit(base[:40]), "short line", "Of.", "", f"unique {d} {random.random()} text of its own"]) for _ in range(5))) for d in range(40)] + [(100, None), (101, "")]
    rows += [(200 + d, edit("abcde" * 2, d % 4) + "\n" + edit("item 12345", d % 3)) for d in range(30)]
    for k, crowds in ((1, (1, 16)), (2, (10_000,))):
        seen, want = [], {}
        for d, t in rows:
            kept = []
            for line in (t or "").split("\n"):
                n = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
                if not n or not any(n == m or (abs(len(n) - len(m)) <= k and distance(n, m) <= min(k, min(len(n), len(m)) // 5)) for m in seen):
                    kept.append(line)
                if n:
                    seen.append(n)
            want[d] = None if t is None else "\n".join(kept)
        for crowd in crowds:
            assert {r.doc_id: r.text for r in dedup_lines(documents(spark, rows), edits=k, crowd=crowd).collect()} == want, (k, crowd)
    assert dedup_lines(documents(spark, []).limit(0)).count() == 0


def test_line_forms_are_exact(spark):
    from pyspark.sql import functions as F

    from tidewire.llm.line_dedup import forms

    random.seed(4)
    texts = sorted({"".join(random.choices("ab", k=random.randint(1, 6))) for _ in range(60)})
    for k in (1, 2):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", forms(F.col("t"), k).alias("f"), *[F.levenshtein("t", F.lit(o), k).alias(f"d{i}") for i, o in enumerate(texts)]).collect()
        form = {r.t: set(r.f) for r in rows}
        for r in rows:
            assert [bool(form[r.t] & form[o]) for o in texts] == [r[f"d{i}"] >= 0 for i in range(len(texts))]


def test_line_dedup_with_null_and_repeated_ids(spark):
    from tidewire.llm.line_dedup import dedup_rows

    rows = [(1, "shared line\nmine alone"), (2, "own one\nshared line\nown two"), (2, "first of all\nsecond of all\nown one"), (2, "own one\nlast"), (None, "a null\nalso null"), (None, "also null\nnull again"), (3, None), (3, "")]
    got = Counter((r.doc.doc_id, r.text, r.n_dropped) for r in dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    want = [(1, "shared line\nmine alone", 0), (2, "own one\nown two", 1), (2, "first of all\nsecond of all", 1), (2, "last", 1), (None, "a null\nalso null", 0), (None, "null again", 1), (3, None, 0), (3, "", 0)]
    assert got == Counter(want)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    from tidewire.llm.packing import pack_documents
    from tidewire.llm.queries import tokenizer_path

    rows = texts + [(400, "a <|endoftext|> b"), (401, "two  spaces\n\n  and   three "), (402, "tab\there  nbsp \n x"), (403, "it's 12 o'clock’s ’ll…")]
    tok = Tokenizer.from_file(tokenizer_path())
    got = defaultdict(list)
    for r in pack_documents(documents(spark, rows), tokenizer_path(), capacity=64).collect():
        got[r.doc_id].append(r)
    bins = defaultdict(list)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, p in enumerate(sorted(got[i], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            assert k == 0 or p.length == 64
            bins[p.sequence_id].append((p.offset, p.length))
            at += p.length
        assert at == len(ids)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= best_fit([n for parts in bins.values() for _, n in parts], 64) * 1.01 + 1
    assert pack_documents(documents(spark, rows).limit(0), tokenizer_path()).count() == 0


def best_fit(sizes, capacity):
    """Sequences of best fit decreasing, one document at a time."""
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


def test_packing_sweeps_match_across_ranges():
    """However the order is cut into ranges, every gap takes what one sweep over the whole order gives it."""
    from tidewire.llm.packing import match_range, meetings

    random.seed(8)
    for _ in range(200):
        kinds = random.choices([0, 1], k=random.randint(0, 60))
        taken, filled, _, _ = match_range(kinds)
        want = dict(zip(filled, taken, strict=True))
        # by definition: a gap takes the largest document below it that no earlier gap took
        free, naive = [], {}
        for row, kind in enumerate(kinds):
            if kind == 0:
                free.append(row)
            elif free:
                naive[row] = free.pop()
        assert want == naive
        cuts = sorted(random.choices(range(len(kinds) + 1), k=random.randint(0, 6)))
        edges = [0, *cuts, len(kinds)]
        got, gaps, left = {}, {}, {}
        for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
            t, f, g, d = match_range(kinds[lo:hi])
            got |= {lo + y: lo + x for x, y in zip(t, f, strict=True)}
            gaps[part], left[part] = [lo + x for x in g], [lo + x for x in d]
        for part, first, other, start, n in meetings({p: (len(left[p]), len(gaps[p])) for p in gaps}):
            got |= {gaps[part][first + k]: left[other][start + k] for k in range(n)}
        assert got == want


@pytest.mark.parametrize("case", ["mixed", "hot", "tiny", "thirds", "one"])
def test_packing_places_against_best_fit(spark, case):
    """Whole and gapless sequences, close to best fit decreasing, with several ranges a round; a hot size and sequences of many documents."""
    from tidewire.llm.packing import place

    random.seed(5)
    capacity = 1 if case == "one" else 256
    sizes = {
        "mixed": [random.choice([*range(1, 257), 1, 2, 3, 256]) for _ in range(1500)],
        "hot": [20] * 500 + [min(256, int(random.expovariate(1 / 60)) + 1) for _ in range(1000)],
        "tiny": [1] * 3000,
        "thirds": [80] * 300 + [90] * 100,
        "one": [1] * 7,
    }[case]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame(list(enumerate(sizes)), "p long, length long")
        got = place(rows, capacity).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.p for r in got) == list(range(len(sizes)))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, sizes[r.p]))
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(bins) <= best_fit(sizes, capacity) * 1.01 + 1


def test_packing_bundles_and_bands():
    import pyarrow as pa

    from tidewire.llm.packing import bands, glue

    random.seed(2)
    sizes = [random.choice([1, 1, 5, 30, 64, 200]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(sizes, pa.int64())], ["p", "l"])
    for limit in (1, 2, 64, 128):
        rows = [r for b in glue(limit)([batch]) for r in b.to_pylist()]
        assert sorted(i["p"] for r in rows for i in r["items"]) == list(range(300))
        for r in rows:
            assert r["size"] == sum(i["l"] for i in r["items"]) and (len(r["items"]) == 1 or r["size"] <= limit)
            assert all(i["l"] == sizes[i["p"]] and i["o"] == sum(j["l"] for j in r["items"][:k]) for k, i in enumerate(r["items"]))
    assert not list(glue(64)([batch.slice(0, 0)]))
    cut = bands([1, 2, 3, 50, 100, 999, 1024], 2048)
    assert all(sum(lo < s <= hi for lo, hi in cut) == 1 for s in (1, 2, 3, 50, 100, 999, 1024)) and cut == sorted(cut, reverse=True) and bands([], 8) == []


def test_packing_ranges_follow_the_rows(spark, monkeypatch):
    """Few rows are swept in few ranges whatever the number of shuffle partitions; many rows, also of one size, in many."""
    from tidewire.llm import packing

    assert packing.ranges({(1, 0): 3, (1, 1): 4, (5, 0): 25, (6, 1): 2, (9, 0): 9}, 10) == {(1, 0): (0, 1), (1, 1): (0, 1), (5, 0): (1, 3), (6, 1): (4, 1), (9, 0): (5, 1)}
    random.seed(7)
    sizes = [20] * 200 + [random.randint(1, 64) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "p long, length long")
    tables, write = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        for most in (packing.RANGE, 40):
            tables.clear()
            bins = defaultdict(list)
            for r in packing.place(rows, 64, most).collect():
                bins[r.sequence_id].append((r.offset, sizes[r.p]))
            assert sum(map(len, bins.values())) == len(sizes) and len(bins) <= best_fit(sizes, 64) * 1.01 + 1
            assert all(sum(n for _, n in b) == max(o + n for o, n in b) <= 64 for b in bins.values())
            parts = [len(df.select("part").distinct().collect()) for name, df in tables if name == "swept"]
            assert max(parts) == 1 if most > 40 else max(parts) > 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packing_plans_stay_small(spark, monkeypatch):
    """The driver keeps the descriptions of plans: cuts of ranges do not stand in them, however many sizes there are."""
    from tidewire.llm import packing

    assert packing.cut_points({(1, 0): (0, 1), (1, 1): (0, 1), (5, 0): (1, 2), (6, 1): (3, 1)}) == [-math.inf, 10, 10.5, 13, math.inf]
    described, write = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name: described.append((name, len(df._jdf.queryExecution().toString()))) or write(df, name))
    random.seed(5)
    rows = spark.createDataFrame([(i, random.randint(1, 2048)) for i in range(300)], "p long, length long")
    rows = write(rows, "test-sizes")
    assert packing.place(rows, 2048).count() == 300
    assert max(n for name, n in described if name == "swept") < 30_000


def test_packing_ids_over_unicode_spaces(spark):
    from tokenizers import Tokenizer

    from tidewire.llm.packing import pack_documents
    from tidewire.llm.queries import tokenizer_path

    random.seed(9)
    parts = [" ", " ", "\u00a0", "\u00a0", "\u2003", "\u3000", "\u202f", "\u0085", "\u2028", "\t", "\n", "one", "two", "é", "7", "'s", "…", "\u200b", "\u1c1d", "\u001d"]
    rows = [(0, "one \u00a0 \u00a0 two"), (1, "one \u00a0two \u00a0 "), (2, "  one  two \n x ")] + [(10 + i, "".join(random.choices(parts, k=40))) for i in range(400)]
    tok = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack_documents(documents(spark, rows), tokenizer_path()).collect()}
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def test_lm_score(spark, texts):
    from tidewire.llm.lm_score import score_documents

    docs = documents(spark, texts).select("doc_id", "text")
    train = docs.where("doc_id < 50")
    words = {i: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i, t in texts}
    c = Counter(w for i, ws in words.items() if i < 50 for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in score_documents(docs, train).collect()}
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), abs=1e-6)
        assert r.score < 0
    # every known word, an unknown one and the empty text have finite scores
    probes = [(k, w) for k, w in enumerate([w for w in c if w is not None] + ["neverseen"])]
    p = {r.doc_id: r for r in score_documents(spark.createDataFrame([*probes, (99, "")], "doc_id long, text string"), train).collect()}
    q = {k: r.score for k, r in p.items()}
    ends = score_documents(spark.createDataFrame([(0, "alpha"), (1, "alpha alpha")], "doc_id long, text string"), train).count()
    assert ends == 2 and all(math.isfinite(x) for x in q.values()) and 10 ** q[99] < 1
    empty = score_documents(docs, docs.limit(0)).where("score <> 0").count()
    assert empty == 0


def test_lm_scores_every_row(spark):
    from tidewire.llm.lm_score import score_documents

    rows = [(1, "a b c", "k"), (1, "a", "k"), (2, "b b", "k"), (2, "b b", "k"), (None, "c", "k"), (None, None, "k"), (None, None, "k"), (3, "a " * 40_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = Counter((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score_documents(docs, docs).collect())
    assert sorted((str(k[0]), k[1], n) for k, n in got.items()) == sorted([("1", 4, 1), ("1", 2, 1), ("2", 3, 2), ("None", 2, 1), ("None", 1, 2), ("3", 40_001, 1)])
    assert score_documents(docs.limit(0), docs).count() == 0 and score_documents(docs.limit(0), docs.limit(0)).count() == 0


def test_lm_contexts_are_whole_words(spark):
    from tidewire.llm.lm_score import score_documents

    rows = [(i, "redcat north") for i in range(20)] + [(20 + i, "bluecat south") for i in range(20)]  # one last byte, one before it
    asked = [(0, "redcat north"), (1, "redcat south"), (2, "bluecat south"), (3, "bluecat north")]
    schema = "doc_id long, text string"
    for frequent in (0, 3, 1000):
        p = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), frequent=frequent).collect()}
        assert p[0] > p[1] + 0.5 and p[2] > p[3] + 0.5


def test_lm_against_brute_force(spark):
    from tidewire.llm.lm_score import score_documents

    # every pair occurs once and every word after one context: one table each, whatever is drawn
    words = "the cat of a tall house saw nine old men there".split()
    train = [(0, " ".join(words))]
    texts = ["the cat", "cat the", "", "tall house saw nine", "nine tall men there", "unheard of a", "there unheard unheard", "old", *words, *(f"{u} {w}" for u in words for w in words)]
    schema, d, v = "doc_id long, text string", 0.95, len(words) + 1
    pairs = list(zip([None, *words], [*words, "."], strict=True))

    def p(u, w):
        known, context = (u, w) in pairs, u is None or u in words
        root = ((1 - d) * (w == "." or w in words) + (1 + d * v) / (v + 1)) / (1 + v)
        return ((1 - d) * known + (1 + d) * root) / 2 if context else root

    want = {i: sum(math.log10(p(u, w)) for u, w in zip([None, *t.split()], [*t.split(), "."], strict=True)) for i, t in enumerate(texts)}
    for frequent in (0, 4, 1000):
        got = {r.doc_id: r for r in score_documents(spark.createDataFrame(list(enumerate(texts)), schema), spark.createDataFrame(train, schema), frequent=frequent).collect()}
        assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-5)
        assert all(r.n_known == 1 + sum(w in words for w in texts[i].split()) for i, r in got.items())


def test_lm_numbers_of_words_change_no_result(spark):
    from tidewire.llm.lm_score import score_documents

    random.seed(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(59, int(random.expovariate(0.12)))] for _ in range(40))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [{r.doc_id: r for r in score_documents(docs, docs.where("doc_id % 4 > 0"), samples=6, frequent=k).collect()} for k in (5, 1000)]
    for some in found[:1]:
        assert all((r.n_tokens, r.n_known) == (found[1][i].n_tokens, found[1][i].n_known) and r.base_score == pytest.approx(found[1][i].base_score) for i, r in some.items())
        assert all(r.score == pytest.approx(found[1][i].score, rel=0.02) for i, r in some.items())  # seats are drawn
        assert sum(r.score for r in some.values()) == pytest.approx(sum(r.score for r in found[1].values()), rel=0.002)


def test_lm_beats_unigram_held_out(spark):
    from tidewire.llm.lm_score import score_documents

    random.seed(6)
    a, b = [f"k{i}a" for i in range(30)], [f"k{i}z" for i in range(30)]
    rows = [(i, " ".join(random.choices(a if i % 2 else b, k=60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = score_documents(docs, docs.where("doc_id < 90")).where("doc_id >= 90").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b + 100


def test_quality(spark):
    from tidewire.llm.quality import fit_quality

    random.seed(2)
    good = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(random.choices(good, k=40)) if i % 3 else " ".join(random.choices(["BUY!!", "NOW!!", "spam$$$"], k=40))) for i in range(400)] + [(1000, None), (1001, "")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(5, None), (9999, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in fit_quality(docs, labels).score(docs).collect()}
    assert len(out) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and np.mean([out[i].predicted == int(i % 3 > 0) for i in held]) > 0.97
    none = fit_quality(docs, labels.limit(0)).score(docs).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_word_vectors_against_brute_force(spark):
    import pyarrow as pa

    from tidewire.llm.common import text_chunks, word_hashes
    from tidewire.llm.quality import WIDTH, WINDOW, index_vectors, pooled, word_vectors

    random.seed(5)
    texts = [" ".join(random.choices(["a", "B", "c", "dd", "e.", "f"], [50, 40, 30, 20, 10, 1], k=random.randint(0, 60))) for _ in range(40)] + [None, "", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "y long, text string").repartition(3)
    vectors = word_vectors(docs, vocabulary=16, rare=4)

    def name(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return word_hashes(data, np.array([0]), np.array([len(data)]))[0]

    words = [w for t in texts for w in (t or "").split()]
    common = sorted(name(w) for w, n in Counter(words).items() if n * 16 >= len(words))
    assert list(vectors.frequent) == common and 2 < len(common) < 6
    index = index_vectors(np.concatenate([np.array(common, np.uint64), np.arange(4, dtype=np.uint64)])).astype(float)
    cls = lambda w: common.index(name(w)) if name(w) in common else len(common) + int(name(w) % np.uint64(4))
    want = np.zeros((len(common) + 4, WIDTH))
    for t in texts:
        own = (t or "").split()
        for i, w in enumerate(own):
            for j in range(max(0, i - WINDOW), min(len(own), i + WINDOW + 1)):
                want[cls(w)] += index[cls(own[j])] * (j != i)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert vectors.rows == pytest.approx(want, abs=1e-5)
    for _, data, offsets in text_chunks(pa.array(texts), False):
        for row, t in zip(pooled(vectors, data, offsets), texts, strict=True):
            own = np.array([want[cls(w)] for w in (t or "").split()]).reshape(-1, WIDTH)
            assert row[:WIDTH] == pytest.approx(own.mean(0) if len(own) else np.zeros(WIDTH), abs=1e-4)
            assert row[WIDTH : 2 * WIDTH] == pytest.approx(own.std(0) if len(own) else np.zeros(WIDTH), abs=2e-3)


def test_quality_on_odd_tables(spark):
    from tidewire.llm.quality import fit_quality

    rows = [(i % 90, ("good words here " if i % 2 else "BAD!! ") * (i % 7 + 1), 1, 1, "x") for i in range(180)] + [(None, None, 0, 0, "x"), (None, "x " * 60_000, 0, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y long, _id long, labelled string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(90)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert model.score(docs).count() == 182 and model.score(docs.limit(0)).count() == 0
    assert fit_quality(docs.limit(0), labels).score(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h2>Site name</h2></header><nav><ul><li><a href=/a>Menu, one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, of course.</p></div><article><h1>Head &amp; line</h1><p>First  paragraph, with <b>bold</b>
text.<p>Second one&hellip; here.<br>Same block.</article><aside><p>Side, bar.</p></aside><div class=comments><p>A reader's comment, long and full of words.</p></div><form><p>Sign up.</p></form><footer>&copy; us.</footer>"""


def test_html(spark):
    from tidewire.llm.html_extract import extract_pages

    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "plain text &lt; only"), (5, "u", "<div><p>unclosed <i>tags, here")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    assert got == {1: "Head & line\nFirst paragraph, with bold text.\nSecond one… here. Same block.", 2: "", 3: "", 4: "plain text < only", 5: "unclosed tags, here"}


def test_html_keeps_the_whole_article():
    from tidewire.llm.html_extract import main_text

    prose = "<p>" + "Some words, in a row. " * 3 + "and more words without any mark " * 11 + "</p>"
    items = "".join(f"<li>{'list item without marks ' * 2}{i}</li>" for i in range(6))
    table = "<table><tr><th>Name</th><td>12</td></tr><tr><th>Other</th><td>13</td></tr></table>"
    figure = "<figure><img src=x><figcaption>A caption of a picture</figcaption></figure>"
    links = "<ul>" + "".join(f"<li><a href=/{i}>Read more {i}</a></li>" for i in range(5)) + "</ul>"
    body = f"{prose * 3}<ul>{items}</ul>{prose}{table}{figure}{prose}<ol><li><a href=/s>Source of it</a></li></ol>"
    short = ["Headline of it", "list item without marks list item without marks 5", "Name", "12", "Other", "13", "A caption of a picture"]

    def lines(page):
        return main_text(f"<html><body><nav>{links}</nav>{page}<footer>Imprint</footer></body></html>").split("\n")

    got = lines(f"{links}<article><header><h1>Headline of it</h1></header>{body}</article>{links}")
    assert len(got) == 5 + 6 + 4 + 1 + 1 + 1 and {*short, "Source of it"} <= set(got) and got[0] == "Headline of it"
    # without an article element: a wrapper of mostly strong text, its headline outside the inner container; link lists stay out
    for page in (f"<div><h1>Headline of it</h1><div>{body}</div></div><div>{links}</div>", f"<main><div><h1>Headline of it</h1></div>{body}</main>{links}", f"<h1>Headline of it</h1>{body}{links}"):
        got = lines(page)
        assert set(short) <= set(got) and "Read more 0" not in got and "Imprint" not in got and len(got) == len(set(got)) + 4


def test_html_attributes_are_parsed():
    from tidewire.llm.html_extract import main_text

    article = "<h1>Head of it</h1>" + "".join(f"<p>Some words, in a row, that make sentence {i}. And another one; here.</p>" for i in range(4))
    wrappers = ['<div style="overflow:hidden">%s</div>', '<div data-hidden="false">%s</div>', '<div data-id="menu">%s</div>', '<div class="page no-sidebar">%s</div>', '<div class="content share">%s</div>', '<div class="related-work">%s</div>', "<div title=don't>%s</div>", '<div title="a > b">%s</div>']
    for wrapper in wrappers:
        for body in (f"<article>{article}</article>", f"<div>{article}</div>"):
            got = main_text(f"<html><body><nav><a href=x>Menu</a></nav>{wrapper % body}<div>Buy it.</div></body></html>").split("\n")
            assert len(got) == 5 and got[0] == "Head of it", wrapper
    for gone in ("hidden", 'hidden=""', 'aria-hidden="true"', 'style="display: none"', 'role="navigation"'):
        assert "Never" not in main_text(f"<body><article>{article}</article><div {gone}><p>Never shown, at all. {article}</p></div></body>")
    assert main_text("<p>a &lt;b&gt; c <b title='x y'>d <b titl") == "a <b> c d"


def test_html_ratios_by_hand_and_on_pages(spark):
    from html.parser import HTMLParser

    import duckdb

    from tidewire.llm.html_extract import LOWERED, PUNCTUATION, RAISED, blocks, main_blocks, ratios

    class Paths(HTMLParser):
        """Sums by path for well-formed pages of div, article, h1, p and a."""

        def __init__(self):
            super().__init__()
            self.open, self.sums = [], defaultdict(lambda: [0, 1e-9, 0])

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, dict(attrs).get("class")))

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            own = self.sums[tuple(e for e in self.open if e[0] != "a")]
            own[2 if self.open[-1][0] == "a" else 0] += len(data)
            own[1] += len(PUNCTUATION.findall(data)) + (self.open[-1][0] != "a")

    page = '<body><div class="ad"><p>Buy, now!</p></div><article><h1>A head</h1><p>One, two. Three.</p><p>Four five.</p><div><p>Six.</p></div></article><div><a>Link to it</a></div></body>'
    parser = Paths()
    parser.feed(page)
    want = {}
    for path, (plain, marks, linked) in parser.sums.items():
        beside = [v for p, v in parser.sums.items() if p[:-1] == path[:-1]]
        text = (plain + sum(v[0] for v in beside) / len(beside)) / 2
        point = (max(1, round(marks)) + sum(max(1, round(v[1])) for v in beside) / len(beside)) / 2
        weight = (RAISED if ("article", None) in path else 1) * (LOWERED if ("div", "ad") in path else 1)
        want["/".join(t if c is None else f"{t}.{c}" for t, c in path)] = weight * plain / (plain + linked) * math.sqrt(text * point)
    assert ratios(blocks(page)) == pytest.approx(want)
    # On the given pages the ratios alone, without hints, drop the adverts and keep what stands in the article.
    removed = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        found = main_blocks(page, hints=False)
        removed += sum(not kept for _, kept in found)
        article = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|$)", page)[1]
        assert len(article) < 600 or [kept for _, kept in found] == [False] + [True] * (len(found) - 1)
    assert removed > 0


def test_permutation_index(spark):
    from tidewire.llm.permutation_index import search

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (600, 8)), np.tile(rng.normal(0, 1, (1, 8)), (30, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, None] + [0.0] * 6)]
    got = defaultdict(list)
    for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 500, 600}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hit += len({i for i, _ in found} & set(best))
        assert [s for _, s in found] == pytest.approx([d[i] for i, _ in found], abs=1e-12) and len(found) == 10
    assert hit >= 63
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_permutation_index_where_ranking_bites(spark):
    from tidewire.llm import permutation_index as index

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (60, 16))
    x = np.concatenate([centres[rng.integers(0, 60, 15_000)] + rng.normal(0, 0.4, (15_000, 16)), rng.normal(0, 1, (5_000, 16)), np.tile(rng.normal(0, 1, (1, 16)), (1_000, 1))]).astype(np.float32)
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(4)
    seen = []
    original = index.effort
    index.effort = lambda *a, **k: seen.append(original(*a, **k)) or seen[-1]
    try:
        found = index.search(table, every=200).toPandas()
    finally:
        index.effort = original
    assert seen[0][0] < 145 and seen[0][1] < 64 * 65 // 2  # not all files, and not all of a file
    hit = 0
    for q, own in found.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hit += len(set(own.vec_id) & set(best))
        assert list(own.sort_values("rank").score) == pytest.approx([d[i] for i in own.sort_values("rank").vec_id], abs=1e-12)
    queries = len(range(0, len(x), 200))
    assert found.query_id.nunique() == queries and hit >= 0.9 * 10 * queries


def test_permutation_index_searches_each_length(spark):
    from tidewire.llm.permutation_index import search

    rows = [(i, [float(i), 1.0]) for i in range(0, 300, 50)] + [(i + 1000, [1.0, 2.0, float(i)]) for i in range(0, 200, 100)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id: r.vec_id for r in got if r["rank"] == 1} == {0: 50, 100: 50, 200: 150, 1000: 1100, 1100: 1000}


def brute_rake(cells, goals, volume):
    """cells: {(source, lang, topic): tokens}; goals: a {value: share} per dimension. Raking with cells held at their tokens, in plain Python."""
    weight, held = {c: volume * t / sum(cells.values()) for c, t in cells.items()}, set()
    while True:
        for _ in range(400):
            for d, goal in enumerate(goals):
                for v, share in goal.items():
                    own = [c for c in cells if c[d] == v and c not in held]
                    have = sum(weight[c] for c in own)
                    want = max(0.0, share * volume - sum(weight[c] for c in held if c[d] == v))
                    for c in own:
                        weight[c] *= want / have if have else 0
        over = [c for c in cells if c not in held and weight[c] > cells[c] * (1 + 1e-9)]
        if not over:
            return weight
        for c in over:
            weight[c] = cells[c]
        held.update(over)


def test_raking_against_brute_force(spark):
    from tidewire.llm.mixing import marginals, rake

    random.seed(12)
    cells = {(s, g, t): random.randint(1, 5000) * (30 if s == "big" else 1) for s in ("big", "mid", "low", None) for g in ("en", "de", None) for t in (0, 1)}
    alpha = {"source": 0.5, "lang": 0.7, "topic": 1.0}
    goals = []
    for d, a in enumerate(alpha.values()):
        have = Counter()
        for c, n in cells.items():
            have[c[d]] += n
        goals.append({v: n**a / sum(m**a for m in have.values()) for v, n in have.items()})
    table = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic int, tokens long")
    for keep in (0.1, 0.6):  # without and with cells that are held at their tokens
        want = brute_rake(cells, goals, keep * sum(cells.values()))
        raked = rake(table, alpha, keep, tolerance=1e-9)
        got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
        assert got == pytest.approx(want, rel=1e-3)
        assert any(got[c] == cells[c] for c in cells) == (keep == 0.6)
        if keep == 0.1:
            assert all(abs(r.wanted - r.reached) < 1e-6 for r in marginals(raked, alpha).collect())


def test_mixing(spark):
    from tidewire.llm.mixing import mix_documents

    rows = [(i, "word " * (5 + i % 7), "en" if i % 4 else None, "big" if i % 10 else "small") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    share = spark.createDataFrame([("big", 0.5), ("small", 0.5)], "source string, share double")
    out = mix_documents(docs, keep=0.15, targets={"source": share}, alpha={"source": 1.0, "lang": 1.0, "topic": 1.0})
    r = {x.source: x for x in out.groupBy("source").agg({"tokens": "sum", "p": "avg"}).collect()}
    kept = {x.source: x[1] for x in out.where("kept").groupBy("source").sum("tokens").collect()}
    assert out.count() == 3000 and abs(kept["big"] / kept["small"] - 1) < 0.25 and len(r) == 2
    assert mix_documents(docs.limit(0)).count() == 0
    odd = [(1, None, None, None, 0.5), (1, "", "en", "a", 0.5), (2, "x " * 50_000, "en", "a", 0.5), (None, "y z", None, "a", 0.5), (None, "y z", None, "a", 0.5)]
    out = mix_documents(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, p double")).collect()
    assert sorted(r.tokens for r in out) == [0, 0, 2, 2, 50_000] and all(0 <= r.p <= 1 for r in out)


def test_topics_follow_the_words(spark):
    from tidewire.llm.mixing import mix_documents

    random.seed(3)
    about = [[f"t{k}w{i}" for i in range(40)] for k in range(3)]
    docs = spark.createDataFrame([(i, " ".join(random.choices(about[i % 3], k=60)), "en", "a") for i in range(150)], "doc_id long, text string, lang string, source string")
    groups = defaultdict(set)
    for r in mix_documents(docs, topics=3).collect():
        groups[r.doc_id % 3].add(r.topic)
    assert sorted(map(len, groups.values())) == [1, 1, 1] and len(set.union(*groups.values())) == 3
