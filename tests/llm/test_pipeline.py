"""The pipeline's stages on a small table: columns, effects and counts."""


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline

    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        body = "BUY!! NOW!! " * 30 if i % 5 == 0 else "\n".join(" ".join(random.choices(words, k=25)) for _ in range(4))
        rows.append((i, body, "en", f"src{i % 3}", len(body)))
    rows += [(200 + i, rows[1][1], "en", "src0", 1) for i in range(3)] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or (docs.columns == names and docs.count() <= before)
    assert docs.select("sequence_id").distinct().count() >= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_keep_rows_apart(spark, tmp_path):
    """Repeated and null ids, null, empty and very long texts, clashing columns: a row goes only for its own text, and an empty table stays empty."""
    import corpus_pipeline

    rows = [(1, "one two three four five six", "en", "a"), (1, "a text of its own, with other words than that", "en", "a"), (None, None, None, None), (None, "", "en", "b"), (2, "w " * 30_000 + "end", "en", "a"), (3, "one two three four five six", "en", "a")]
    docs = spark.createDataFrame([(*r, 0, 7, 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, first long").coalesce(1)
    lines = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert [r.text for r in sorted(lines, key=lambda r: str(r.text)) if r.doc_id == 1] == ["a text of its own, with other words than that", "one two three four five six"]
    assert len(lines) == 6 and [r.text for r in lines if r.doc_id == 3] == [""] and all(r.row == 7 and r.first == 8 for r in lines)
    kept = corpus_pipeline.simhash(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "2", "None"] and {len(r) for r in kept} == {7}
    assert corpus_pipeline.mixing(spark, docs, "").count() <= 6
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.simhash, corpus_pipeline.mixing, corpus_pipeline.packing):
        assert stage(spark, docs.limit(0), "").count() == 0
