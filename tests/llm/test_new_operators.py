"""Vector codes, decontamination and the prefix trie against brute force and against their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, prefix_trie, vector_codes

SMALL = "/root/testdata/sf0.001"


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((dict(zip(names, r, strict=True)) for r in cur.fetchall()), key=str)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


# ---- vector codes


def brute_codes(data, parts, entries, rounds):
    kept = [(i, [int(np.floor(vector_codes.SCALE * float(x))) for x in v], label) for i, v, label in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                groups[p, nearest(p, part)[1]].append(part)
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        got = [nearest(p, part) for p, part in enumerate(cut(v))]
        by_label[label] += sum(g[0] for g in got)
        out.append([i, "".join(f"{g[1]:02x}" for g in got), sum(g[0] for g in got), label])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(({"vec_id": i, "code": c, "error": e, "label_error": by_label[label], "codebooks_sha256": digest} for i, c, e, label in out), key=str)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    data = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, width)], int(i % 4) if i % 9 else None) for i in range(n)]
    data += [(n, None, 1), (n + 1, [float("nan")] * width, 1), (n + 2, [float("inf")] + [0.0] * (width - 1), None), (n + 3, [None] * width, 2)]
    return data + [data[0], (3, data[5][1], 7), (None, data[6][1], 1), (n + 4, [0.25] * width, 3), (n + 5, [0.25] * width, 3)]


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_vector_codes_equal_brute_force_for_any_cell(spark, bits):
    data = vectors(120, 16)
    table = frame(spark, data).withColumns({"v": F.lit(1), "id": F.lit("x"), "code": F.lit(None).cast("int"), "of": F.lit(2)})
    got, books = vector_codes.compress(table, bits=bits)
    assert rows(got) == brute_codes(data, 8, 16, 6)
    assert rows(got)[0]["codebooks_sha256"] == vector_codes.digest(books)


def test_vector_codes_few_rows_empty_and_wrong_lengths(spark):
    data = vectors(3, 8)[:3]
    assert rows(vector_codes.compress(frame(spark, data))[0]) == brute_codes(data, 8, 16, 6)
    assert vector_codes.compress(frame(spark, []))[0].collect() == []
    assert vector_codes.compress(frame(spark, [(1, None, None)]))[0].collect() == []
    for bad in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(frame(spark, bad))
    with pytest.raises(Exception, match="not supported"):
        vector_codes.compress(frame(spark, [(1, [1e9] * 8, 1)]))


def test_cells_keep_ties_and_forget_safely():
    rng = np.random.default_rng(2)
    book = rng.integers(-300, 300, (16, 4))
    book[7] = book[2]
    x = np.concatenate([rng.integers(-400, 400, (3000, 4)), np.repeat(book, 3, 0), (book[:8] + book[8:]) // 2])
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    for most in (1, 50, 100_000):
        cells = vector_codes.Cells(book, bits=6, most=most)
        for _ in range(2):
            code, error = cells.assign(x)
            assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
    assert cells.measured < 2 * 16 * len(x) * 0.8  # entries that are dominated are not measured


def test_decode_gives_codebook_vectors(spark):
    got, books = vector_codes.compress(frame(spark, vectors(60, 8)))
    back = {r["vec_id"]: r["vector"] for r in vector_codes.decode(got.where("vec_id > 10"), books).collect()}
    code = {r["vec_id"]: bytes.fromhex(r["code"]) for r in got.collect()}
    assert back and all(v == [books[p][code[i][p]][0] / 4096 for p in range(8)] for i, v in back.items())


# ---- decontamination


def brute_leaks(docs, items, window=10):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (got := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[got]
        out.append({"doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit)})
    return sorted(out, key=str)


def leak_case(seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "été", "x1", "Über", "news", "7", "漢字"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 25]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "..!"), (3, items[4][1]), (None, "alpha beta gamma delta epsilon zeta eta"), (103, "the " * 30), (104, items[0][1]), (105, items[0][1])]
    docs = [(i, text(rng.choice([0, 1, 5, 12, 60]))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, text(8000) + " " + items[5][1] + " " + text(3000)), (53, "the " * 500), (53, items[7][1].upper()), (None, items[8][1] + "!")]
    docs += [(54 + i, "Z " + items[9][1] + " q") for i in range(60)] + [(200, "ALPHA-beta_gamma delta  epsilon\nzeta\teta")]
    return docs, items


@pytest.mark.parametrize("shingle", [1, 3, 5, 10])
def test_decontamination_equals_brute_force(spark, shingle):
    docs, items = leak_case()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "hash": F.lit("h"), "occ": F.lit(3), "n_words": F.lit(-1), "win": F.lit(0)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(9), "win": F.lit(9), "n": F.lit(9)})
    assert rows(decontaminate.decontaminate(d, i, shingle=shingle)) == brute_leaks(docs, items)


def test_decontamination_by_sql_full_filter_and_empty_tables(spark):
    docs, items = leak_case(9)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.decontaminate(d, i, filter_bits=1 << 15))
    assert got == brute_leaks(docs, items)
    assert got == oracle(decontaminate.sql(), documents=d.toPandas().astype({"doc_id": "Int64"}), benchmark=i.toPandas().astype({"item_id": "Int64"}))
    assert rows(decontaminate.decontaminate(d, i.limit(0))) == brute_leaks(docs, [])
    assert decontaminate.decontaminate(d.limit(0), i).collect() == []


def test_leak_places_are_the_windows(spark):
    d = spark.createDataFrame([(1, "a b c " + " ".join(f"w{i}" for i in range(12)) + " d")], "doc_id long, text string")
    i = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    found = decontaminate.hits(d, i)["hits"].collect()
    assert sorted((r["start"], r["until"]) for r in found) == [(3, 13), (4, 14), (5, 15)]


# ---- prefix trie


def brute_trie(data):
    convs = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    convs = {c: [x for _, x in sorted(v, key=lambda r: r[0])] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(nodes[p]) - 1) * own + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(c for c in nodes[p] if whole[c] == p))
        out.append({"conv_id": min(nodes[p]), "depth": len(p), "parent_conv_id": min(nodes[p[:-1]]) if p else None, "n_convs": len(nodes[p]), "n_children": len(kids[p]), "n_leaves": leaves[p], "saved_tokens": saved[p], "ends_sha256": hashlib.sha256(ends.encode()).hexdigest()})
    return sorted(out, key=str)


def talk(seed=3):
    rng = random.Random(seed)
    data = []
    for c in range(70):
        n = rng.choice([1, 2, 3, 5, 8])
        data += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes no", "a b  c"])) for t in range(n)]
    data += [(200, None, None, None), (200, 1, "user", None), (201, 2, "u", "x"), (201, 2, "u", "y y"), (201, 2, "u", "y y"), (None, 1, "user", "lost")]
    data += [(215, 1, "u", "one turn only"), (-5, 1, "u", "below zero"), (-20, 1, "u", "base below zero")]
    data += [(300 + i, t, "u", "copied") for i in range(40) for t in range(6)]  # copies of one conversation
    return data


def test_trie_equals_brute_force_and_sql(spark):
    data = talk()
    t = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = rows(prefix_trie.conversation_trie(t.withColumns({"d": F.lit(1), "n": F.lit(2), "key": F.lit("k"), "conv": F.lit(3), "e": F.lit(0)})))
    assert got == brute_trie(data)
    assert got == oracle(prefix_trie.sql(), conversations=t.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))


def test_trie_with_long_conversations_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rng = random.Random(8)
    long = [f"w{i % 5} x" for i in range(90)]
    data = [(1000, t, "u", x) for t, x in enumerate(long)]
    for c in range(1001, 1040):  # same words up to a depth of their own
        keep = rng.choice([0, 1, 4, 5, 8, 40, 41, 89, 90])
        data += [(c, t, "u", x if t < keep else f"{c % 3} other") for t, x in enumerate(long[: keep + rng.choice([0, 3])])]
    t = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert rows(prefix_trie.conversation_trie(t)) == brute_trie(data)


def test_trie_of_empty_tables(spark):
    t = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(t).collect() == []


def test_fattest_number_of_an_interval(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in got)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables")
def test_queries_equal_their_sql_on_the_smallest_tables(spark):
    from tidewire.llm import queries

    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in ("op11_vector_codes", "op12_decontamination", "op13_prefix_trie"):
        cur = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert rows(queries.queries()[name](spark, SMALL)) == sorted((dict(zip(names, r, strict=True)) for r in cur.fetchall()), key=str)


def test_words_of_a_text_are_encoded_in_one_call_and_kept_between_tasks(monkeypatch):
    from tokenizers import Tokenizer

    from tidewire.llm import packing
    from tidewire.llm.queries import tokenizer_path

    words = packing.words_of(tokenizer_path())
    assert packing.words_of(tokenizer_path()) is words  # the next task of a worker has it already
    calls, encode = [], words.bpe.encode_ordinary

    class Counting:
        def encode_ordinary(self, text):
            calls.append(text)
            return encode(text)

    monkeypatch.setattr(words, "bpe", Counting())
    words.kept, words.older = {}, {}
    words.encode("one " + " ".join(f"word{k}" for k in range(500)))
    assert len(calls) == 2  # the first word and all others
    words.encode("one word7 word499")
    assert calls[2:] == ["one"]
    monkeypatch.undo()
    reference = Tokenizer.from_file(tokenizer_path())
    parts = ["a", "Straße", "it's", "x-1.2", "  ", " ", "\n", "\t ", " \u00a0", "\u00a0b", "\u3000", "\x1c", "né", "e\u0301", "😀", "12345", "<|endoftext|>", "<", "...", "z" * 70]
    draw = random.Random(5)
    monkeypatch.setattr(packing, "CACHE", 40)
    for k in range(1500):
        text = "".join(draw.choice(parts[: len(parts) - 4 * (k % 2)]) + draw.choice(["", " ", " "]) for _ in range(draw.randrange(40)))
        assert words.encode(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
