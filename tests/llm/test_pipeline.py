import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect_and_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 %%", "en", "src0", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    first = docs.orderBy("doc_id").limit(1).selectExpr(f"{10**6 + 2}L doc_id", "text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(10**6 + 3, f"and here it is, the whole item : {item}", "en", "src1", 9)], docs.schema)
    now = docs.unionByName(junk).unionByName(first).unionByName(leak)
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small).cache()
        assert now.columns == docs.columns, name
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
    assert not {10**6, 10**6 + 1} & ids[0] and 10**6 + 2 in ids[0]
    assert 10**6 + 2 not in ids[1] and 10**6 + 3 in ids[1] and 10**6 + 3 not in ids[2]
    assert ids[3] <= ids[2]
    last = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == now.count()


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    rows.sort(key=lambda r: r.start)
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_empty_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
