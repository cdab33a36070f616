import corpus_pipeline
from lattica.llm.queries import ORACLE_SQL, QUERIES


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if name != "mixing":
            assert docs.columns == columns
        assert 0 < docs.count() <= rows
        rows = docs.count()
    assert {"taken", "target"} <= set(docs.columns)


def test_queries_are_registered():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
