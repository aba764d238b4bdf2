import corpus_pipeline
from factlens.llm import quality
from factlens.llm.queries import ORACLE, QUERIES


def test_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows, before = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            rows = spark.read.parquet(str(tmp_path / name))
            assert 0 < rows.count() <= (before or docs.count())
            before = rows.count()
    ids = {r.doc_id for r in out.collect()}
    assert ids == {r.doc_id for r in rows.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == out.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "exact_dedup", "near_dedup", "packing"]
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(ORACLE) <= set(QUERIES)
    assert quality.QUANTILE < 1
