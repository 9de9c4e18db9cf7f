import corpus_pipeline


def test_each_stage_keeps_the_columns_and_only_removes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir).cache()
        assert out.columns == columns, name
        assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}, name
        docs = out
    assert 0 < docs.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf_dir).count() == 0


def test_stages_take_odd_rows(spark, sf_dir, docs, rows):
    """Nulls, repeats, ties, odd texts and clashing columns go through every stage; only toxic and copied rows go."""
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept, sf_dir).cache()
        assert out.columns == docs.columns, name
        assert out.count() == kept.count() or name in ("toxicity", "ngram_jaccard_join"), name
        # What few rows teach of toxicity is not looked at here: the next stages take all of them.
        kept = docs if name == "toxicity" else out
    ids = [r[0] for r in kept.select("doc_id").collect()]
    # Without a doc_id or a word a row links with nothing; of the copy and its near copy the smaller doc_id stays.
    assert ids.count(None) == 2 and {1, 4, 5, 6, 7} <= set(ids) and 2 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(ids)
