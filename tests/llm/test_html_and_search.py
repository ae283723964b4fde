"""Threads of comments, side boxes, deep nesting, and pages with odd columns."""

import time

import pytest

ARTICLE = "<h1>Head of it</h1>" + "".join(f"<p>Some words, in a row, that make sentence {i}. And another one; here.</p>" for i in range(6))
PAGES = {
    "post": '<div class=post>%s</div><div id="comments">%s</div>',
    "main": '<main>%s<section id="comments">%s</section></main>',
    "beside an article": '<article>%s</article><div id="comments">%s</div>',
    "beside main": "<main>%s</main><section id=comments>%s</section>",
    "inside an article": '<article>%s<div class="discussion">%s</div></article>',
    "responses": '<div class=post>%s</div><div class="responses">%s</div>',
}


@pytest.mark.parametrize("page", PAGES)
@pytest.mark.parametrize("name", ["comment", "c", "reply"])
def test_comments_go_however_many_there_are(page, name):
    from tidewire.llm.html_extract import main_text

    for n in (1, 3, 5, 20, 300):
        thread = "".join(f'<div class="{name}"><b>Jo {i}</b><p>I think that comment {i} is right, really.</p></div>' for i in range(n))
        got = main_text(f"<html><body><nav><a href=x>Menu</a></nav>{PAGES[page] % (ARTICLE, thread)}</body></html>")
        assert "I think" not in got and got.count("Some words") == 6 and got.startswith("Head of it"), n


def test_repeated_parts_of_an_article_stay():
    from tidewire.llm.html_extract import main_text

    sections = "".join(f"<section><h2>Part {i}</h2><p>Some words, in a row, that make part {i}. And more; here.</p><p>A second paragraph, as long as it gets.</p></section>" for i in range(7))
    wrapped = "".join(f'<div class="para"><p>Some words, in a row, that make paragraph {i}. And more; here.</p></div>' for i in range(30))
    for body, n in ((sections, 21), (wrapped, 30)):
        for around in ("<article>%s</article>", "<main><div>%s</div></main>", '<div class="content">%s</div>'):
            got = main_text(f"<body>{around % body}<div id=comments><div class=comment><p>Nice one.</p></div><div class=comment><p>Not so.</p></div></div></body>").split("\n")
            assert len(got) == n and "Nice one." not in got


def test_side_boxes_go():
    from tidewire.llm.html_extract import main_text

    got = main_text(f"<html><body><div class=post>{ARTICLE}</div><div class=x><p>Buy this now. It is good.</p></div></body></html>")
    assert "Buy" not in got and got.count("Some words") == 6


@pytest.mark.parametrize("source", ["<div>" * 20_000 + "text here.", "<div><p>word, " * 5_000, "<div hidden>" * 20_000 + "<p>x" * 20_000, "<span hidden>" * 20_000 + "<p>x" * 20_000, "<ul><li>a" * 10_000, "<table><tr><td>" * 5_000 + "in."])
def test_deep_pages_take_linear_time(source):
    from tidewire.llm.html_extract import main_text

    def seconds(page):
        begun = time.process_time()
        main_text(page)
        return time.process_time() - begun

    half, whole = seconds(source[: len(source) // 2]), seconds(source)
    assert whole < 3 and whole < 4 * half + 0.3  # twice the length, far from four times the time


def test_pages_with_clashing_columns_nulls_repeats_and_long_texts(spark):
    from pyspark.sql import functions as F

    from tidewire.llm.html_extract import extract_pages

    long = "<article>" + "<p>A sentence of it, over and over again.</p>" * 30_000 + "</article>"
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (2, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "html2": F.lit(None).cast("string")})
    got = sorted((r.page_id or 0, r.n_chars, r.text.count("\n")) for r in extract_pages(pages).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2] and got[0][1] == 0 and got[1] == got[2] and got[3][2] == 29_999
    assert extract_pages(pages.limit(0)).count() == 0


def test_search_by_row_with_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    from tidewire.llm.permutation_index import search

    data = [(100, [0.0, 1.0]), (100, [5.0, 5.0]), (7, [0.0, 1.5]), (None, [0.0, 1.25]), (None, [5.0, 5.0]), (3, [0.0, 1.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "rank": F.lit(2), "score": F.lit(0)})
    got = sorted(search(df).collect(), key=lambda r: (r.query_id, r["rank"], r.score))
    one, two = ([(r.vec_id, round(r.score, 3)) for r in got if (r["rank"], r.score) in keep] for keep in ({(1, 0.25), (2, 0.5), (3, 0.5)}, {(1, 0.0)}))
    assert len(got) == 10 and one == [(None, 0.25), (3, 0.5), (7, 0.5)] and two == [(None, 0.0)]
    assert {r.query_id for r in got} == {100}


def test_search_over_one_hot_vector_and_id(spark):
    from tidewire.llm.permutation_index import search

    data = [(200, [1.0, 2.0])] * 400 + [(i, [float(i), 1.0]) for i in range(1, 40)]
    got = search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 4000 and {(r.vec_id, r.score) for r in got} == {(200, 0.0)}


def test_raking_by_group_sums_equals_windows(spark, monkeypatch):
    from tidewire.llm import mixing

    cells = [(s, g, t, (i * 7919) % 500 + 1) for i, (s, g, t) in enumerate((s, g, t) for s in ("a", "b", None) for g in ("en", "de") for t in (0, 1, 2))]
    table = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    found = []
    for most in (mixing.CELLS, 1):
        monkeypatch.setattr(mixing, "CELLS", most)
        out = mixing.rake(table, {"source": 0.5, "lang": 0.7, "topic": 1.0}, 0.6)
        found.append({(r.source, r.lang, r.topic): round(r.weight, 6) for r in out.collect()})
    assert found[0] == found[1]
