"""The pipeline: each stage's effect on its own input, and the whole run."""

import corpus_pipeline
from logscope.llm import decontaminate, jaccard_join, pii, quality_classifier

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        if at < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{at}")
        out = spark.read.parquet(f"{tmp_path}/{at}")
        ids, was = ({r[0] for r in x.select("doc_id").collect()} for x in (out, docs))
        assert ids <= was
        if at == 0:
            score = quality_classifier.classify(docs, labels, threshold=corpus_pipeline.LEAST_QUALITY)
            assert ids == {r[0] for r in score.where("predicted = 1").select("doc_id").collect()}
        elif at == 1:
            comp = jaccard_join.jaccard_components(docs, 5, 80).collect()
            assert ids == {r["doc_id"] for r in comp if r["component_id"] == r["doc_id"]}
        elif at == 2:
            bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
            assert ids == was - {r[0] for r in decontaminate.contaminated(docs, bench).select("doc_id").collect()}
        elif at == 3:
            assert ids == was
            for r in out.collect():
                assert not pii.base_spans(r["text"] or "") and r["n_chars"] == len(r["text"])
        else:
            assert ids == was
        docs = out


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR).toPandas()
    assert len(out) and out.ids.map(len).eq(out.n_pieces).all()


def test_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
