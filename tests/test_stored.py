from __future__ import annotations

from belltower.plans import retrieval
from belltower.sources.stored import made_once, signature


def test_an_index_is_built_once_for_the_same_files(spark, tmp_path):
    rows = [(i, f"word{i % 5} other{i} thing") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    first = retrieval.index(spark, str(tmp_path))
    assert retrieval.index(spark, str(tmp_path)) is first and first.chunks == 30
    df.limit(5).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    again = retrieval.index(spark, str(tmp_path))
    assert again is not first and again.chunks == 35


def test_signatures_tell_files(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    spark.range(5).write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert signature(a) == signature(spark.read.parquet(str(tmp_path / "a"))) != signature(b)
    assert made_once(spark, "k", lambda: 1) == made_once(spark, "k", lambda: 2) == 1
