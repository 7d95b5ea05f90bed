import numpy as np
import pytest
from pyspark.sql import functions as F

from belltower.functions import text as T
from belltower.operators import lexical as L
from belltower.operators import vectors


@pytest.fixture
def index(spark):
    """Twenty chunks of some of forty words; AQE leaves the partitions of its making as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(i, " ".join(f"w{j:02}" for j in rng.integers(0, 40, 30))) for i in range(20)], "chunk_id long, text string")
    yield L.Index(chunks, F.split("text", " "), ["w01"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_words_split_first_are_those_of_the_canonical_text(spark):
    texts = ["Ab-c  d1\u00a0É.f", "क़ि\u200dता\u200c हिन्दी, चाँद ४२ ऩ्क", " ़ x़y ", "ΑΣ'Α ǅ ①½\U0001d400", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    want = d.select("i", F.explode(F.split(T.canonical(F.col("text"), F.lower), " ")).alias("w"))
    got = d.select("i", F.explode(F.split(F.lower("text"), T.BETWEEN_WORDS)).alias("w")).select("i", T.canonical_word(F.col("w")).alias("w"))
    assert sorted(map(tuple, got.where("w <> ''").collect())) == sorted(map(tuple, want.where("w <> ''").collect())) != []


def test_postings_are_written_where_their_chunk_is(index):
    files = index.postings.select("chunk_id", F.input_file_name().alias("file")).distinct().groupBy("chunk_id").agg(F.count("*").alias("n"))
    assert files.count() == 20 and files.where("n > 1").count() == 0


def test_what_few_queries_find_is_not_shuffled_by_query_and_chunk(spark, index):
    q = spark.createDataFrame([(1, "w02"), (1, "w03"), (1, "w3x"), (2, "w04"), (2, "w05")], "query_id long, term string")
    found = L.search(index, q, 3, 0.1, None, spark.createDataFrame([(1, "w07"), (2, "w07"), (3, "w08")], "query_id long, term string"))
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not any("chunk_id" in line for line in plan.splitlines() if "hashpartitioning(query_id" in line)
    assert {r["query_id"] for r in rows} == {1, 2} and all(r["rank"] <= 3 for r in rows)
    few, L.FEW = L.FEW, 0
    try:  # the form for many queries
        assert sorted(map(tuple, L.search(index, q, 3, 0.1, None, spark.createDataFrame([(1, "w07"), (2, "w07"), (3, "w08")], "query_id long, term string")).collect())) == sorted(map(tuple, rows))
    finally:
        L.FEW = few


def test_only_the_best_of_each_task_are_shuffled_by_query(spark, index):
    schema = "query_id long, term string"
    terms, wanted = [(1, "w02"), (1, "w03"), (2, "w04"), (2, "w3x")], spark.createDataFrame([(1, "w07"), (2, "w08"), (3, "w08")], schema)
    plain = sorted(map(tuple, L.search(index, spark.createDataFrame(terms, schema), 3, 0.1, None, wanted).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # as if there were too many queries for Spark to broadcast what is told of each; repeated rows and null queries change nothing
        found = L.search(index, spark.createDataFrame([*terms, *terms, (None, "w02")], schema), 3, 0.1, None, wanted.union(wanted))
        limits = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "WindowGroupLimit" in line]
        assert sorted(map(tuple, found.collect())) == plain != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any(line.endswith("Partial") for line in limits) and any(line.endswith("Final") for line in limits)


def test_like_spellings_of_few_words_are_met_without_a_shuffle(spark):
    df = L.like_spellings(spark.createDataFrame([("nation",)], "term string"), spark.createDataFrame([("nations", 1.0), ("motion", 2.0), ("xyz", 3.0)], "variant string, idf double"))
    assert [(r["variant"], r["idf"]) for r in df.collect()] == [("nations", 1.0)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("block", "shard"), [(4000, 25_000), (2, 3)])
def test_most_similar_of_given_pairs(spark, block, shard):
    rng = np.random.default_rng(5)
    v = {i: [float(x) for x in rng.integers(-3, 4, 4)] for i in range(12)} | {12: None, 13: [0.0] * 4, 14: [1.0, 2.0]}
    pairs = [(q, c) for q in (0, 3, 5, 12, 77) for c in range(16) if (q + c) % 3]
    found = vectors.top_k_among(spark.createDataFrame(pairs, "query_id long, vec_id long"), spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>"), 40, block, shard)
    cosine = lambda a, b: None if None in (a, b) or len(a) != len(b) or not any(a) or not any(b) else round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    want = {(q, c, cosine(v[q], v[c])) for q, c in pairs if q in v and c in v}
    assert {(r["query_id"], r["vec_id"], r["similarity"]) for r in found.collect()} == want
    best = vectors.top_k_among(spark.createDataFrame(pairs, "query_id long, vec_id long"), spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>"), 2, block, shard)
    ranked = [r for r in L.matching_nearest(best.withColumnRenamed("vec_id", "chunk_id")).collect() if r["rank"] <= 2]
    order = lambda r: (r[0], r[2] is None, -(r[2] or 0), r[1])
    for q in {r[0] for r in want}:
        assert [r["chunk_id"] for r in sorted(ranked, key=lambda r: r["rank"]) if r["query_id"] == q] == [r[1] for r in sorted((r for r in want if r[0] == q), key=order)[:2]]
