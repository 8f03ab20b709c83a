import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        kept = out.count()
        assert out.columns == columns and 0 < kept <= n, name
        docs, n = out, kept
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in placed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "personal_data", "packing"]


def test_odd_rows(spark, odd, empty, sf_dir):
    """Each stage on the odd rows alone: what it keeps, by id, and that empty tables stay empty."""
    every = sorted((r["doc_id"] or 0) for r in odd.collect())
    want = {"exact_dedup": [0, 2, 4, 5, 6, 7, 8], "personal_data": every, "packing": sorted({*every})}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        got = sorted((r["doc_id"] or 0) for r in out.select("doc_id").collect())
        assert set(got) <= set(every) and got, name
        if name == "packing":
            got = sorted(set(got))
        assert got == want.get(name, got), name
        assert name == "packing" or out.columns == odd.columns
        assert stage(spark, empty, sf_dir).count() == 0, name
    near = {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, odd, sf_dir).select("doc_id").collect()}
    assert {3, 5, 7, 8} <= near and not near & {4, 6}
