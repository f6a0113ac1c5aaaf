"""run() of the pipeline: stages that are written, and picks that do not depend on the order of rows."""

import corpus_pipeline
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, minhash, simhash


def test_run_writes_each_stage(spark, tmp_path, monkeypatch):
    def drawn(spark, docs, sf_dir):
        import uuid

        return docs.withColumn("mark", F.udf(lambda: str(uuid.uuid4())).asNondeterministic()())

    def twice(spark, docs, sf_dir):
        return docs.join(docs.select(F.col("mark").alias("again")).distinct(), F.col("mark") == F.col("again"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("drawn", drawn), ("twice", twice)])
    spark.range(50).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 50 and all("/pipeline-" in f for f in out.inputFiles())


def test_picks_among_repeated_rows_are_by_value(spark):
    rows = [(i, t, lang, "s", 0) for i in range(20) for t, lang in (("b  a c d e", "z"), ("b a  c d e", "z"), ("b a  c d e", "y"), ("b a  c d e", "x"))]
    df = spark.createDataFrame([(i, f"{i} {t}", *r) for i, t, *r in rows], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df).collect()}
    assert len(got) == 20 and all(r["lang"] == "z" and "b  a" in r["text"] for r in got.values())
    same = df.filter("text like '%b a  c%'")
    for near in (simhash.near_dedup, minhash.near_texts):
        kept = near(same).collect()
        assert kept and all(r["lang"] == "x" for r in kept)
