from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm.common import dealt


def test_stages_follow_one_another(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if i < 3:
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.filter("size(ids) <> n_tokens or n_tokens = 0").count() == 0 and docs.count() > 0


def test_a_table_of_one_row_group_is_not_one_task(spark, tmp_path):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.substring("text", 1, 600).alias("text"), "lang", "source", "n_chars").coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert docs.select(F.spark_partition_id()).distinct().count() == 1
    out = corpus_pipeline.quality_rules_stage(spark, docs, d)
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) >= 2 * spark.sparkContext.defaultParallelism and max(per) <= sum(per) / 4
    moved = dealt(docs)
    assert moved.columns == docs.columns and moved.exceptAll(docs).count() == docs.exceptAll(moved).count() == 0


def test_a_table_in_even_parts_or_with_few_rows_is_not_moved(spark, tmp_path):
    spark.range(40_000).repartition(8).write.parquet(str(tmp_path / "even"))
    for df in (spark.read.parquet(str(tmp_path / "even")), spark.range(0, 4096, 1, 1), spark.range(0).coalesce(1)):
        assert dealt(df) is df
    assert dealt(spark.range(0, 4097, 1, 1)).select(F.spark_partition_id()).distinct().count() > 1
