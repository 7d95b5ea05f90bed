from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from belltower.operators import reindex
from belltower.operators.memo import Memo
from belltower.operators.settings import as_of, spans, streamed_as_of

SIZE = 2


def embed(texts):
    if any("boom" in t for t in texts):
        raise RuntimeError("service down")
    return [[float(len(t)), 1.0] for t in texts if "lost" not in t] if not any("long" in t for t in texts) else [[1.0, 2.0, 3.0] for _ in texts]


@pytest.fixture
def stored(spark, tmp_path):
    def make(rows, states=None):
        chunks = spark.createDataFrame([(d, i, 1, t, e) for d, i, t, e in rows], reindex.CHUNKS)
        ids = sorted({r[0] for r in rows} | set(states or {}))
        notes = [(d, (states or {}).get(d, ("ready", '{"embedding_space":"old","kept":"x"}'))) for d in ids]
        docs = spark.createDataFrame([(d, s, m) for d, (s, m) in notes], "document_id long, status string, metadata_json string")
        return reindex.StoredIndex(spark, str(tmp_path / "index"), 8).created(docs, chunks)

    return make


def held(index):
    return {(r["document_id"], r["chunk_index"]): r["embedding"] for r in index.chunks().collect()}


def test_stale_documents_are_embedded_anew_and_others_stay(stored):
    fresh = ("ready", '{"embedding_space":"new"}')
    index = stored([(1, 0, "ab", [9.0, 9.0]), (1, 1, "abc", [9.0, 9.0]), (2, 0, "x", [8.0, 8.0]), (3, 0, "yy", None)], {2: fresh, 3: fresh})
    report = {r["document_id"]: r for r in index.reindexed(embed, "new", SIZE).collect()}
    assert set(report) == {1, 3} and report[1]["chunks"] == 2 and report[1]["error"] is None
    assert held(index) == {(1, 0): [2.0, 1.0], (1, 1): [3.0, 1.0], (2, 0): [8.0, 8.0], (3, 0): [2.0, 1.0]}
    notes = {r["document_id"]: json.loads(r["metadata_json"]) for r in index.documents().collect()}
    assert notes[1] == {"kept": "x", "embedding_space": "new", "embedding_dimensions": "2", "chunk_count": "2"} and notes[2] == {"embedding_space": "new"}
    assert index.status("new").where("stale").count() == 0
    assert index.reindexed(embed, "new", SIZE).count() == 0


@pytest.mark.parametrize(("text", "why"), [("boom", "RuntimeError: service down"), ("lost", "vectors for"), ("long", "isn't 2 finite ones")])
def test_a_failing_document_keeps_its_old_rows(stored, text, why):
    index = stored([(1, 0, "ok", [9.0, 9.0]), (2, 0, "fine", [7.0, 7.0]), (2, 1, text, [7.0, 7.5]), (3, 0, "also ok", [6.0, 6.0])])
    report = {r["document_id"]: r["error"] for r in index.reindexed(embed, "new", SIZE).collect()}
    assert report[1] is None and report[3] is None and why in report[2]
    now = held(index)
    assert now[2, 0] == [7.0, 7.0] and now[2, 1] == [7.0, 7.5] and now[1, 0] == [2.0, 1.0] and now[3, 0] == [7.0, 1.0]
    state = {r["document_id"]: (r["status"], json.loads(r["metadata_json"])) for r in index.documents().collect()}
    assert state[2][0] == "failed" and why in state[2][1]["error"] and state[2][1]["embedding_space"] == "old" and state[1][0] == "ready"
    # the next run tries it again, and takes its error back when it comes through
    again = {r["document_id"]: r["error"] for r in index.reindexed(lambda t: [[float(len(x)), 0.0] for x in t], "new", SIZE).collect()}
    assert again == {2: None}
    status, note = {r["document_id"]: (r["status"], json.loads(r["metadata_json"])) for r in index.documents().collect()}[2]
    assert status == "ready" and "error" not in note and note["embedding_space"] == "new"


def test_vectors_that_are_not_finite_fail():
    with pytest.raises(ValueError, match="finite"):
        reindex.vectors_of(["a"], lambda t: [[float("nan"), 1.0]], 2)
    with pytest.raises(ValueError, match="0 vectors for 1"):
        reindex.vectors_of(["a"], lambda t: [], 2)


def test_nothing_stored_changes_when_staging_fails(spark, stored, monkeypatch):
    index = stored([(1, 0, "ok", [9.0, 9.0])])
    before = held(index)

    def broken(df):
        if "error" in df.columns:
            raise OSError("disk full")
        return df

    monkeypatch.setattr(reindex, "settled", broken)
    with pytest.raises(OSError, match="disk full"):
        index.reindexed(embed, "new", SIZE)
    assert held(index) == before


def test_documents_without_chunks_are_cut_from_pages_or_fail(spark, stored):
    index = stored([(1, 0, "ok", [9.0, 9.0])], {5: ("ready", None), 6: ("ready", None)})
    pages = spark.createDataFrame([(5, 0, 1, "from the page"), (1, 7, 1, "not taken")], "document_id long, chunk_index int, page_number int, text string")
    report = {r["document_id"]: r["error"] for r in index.reindexed(embed, "new", SIZE, pages=pages).collect()}
    assert report == {1: None, 5: None, 6: "no chunks"}
    assert held(index) == {(1, 0): [2.0, 1.0], (5, 0): [13.0, 1.0]}


def test_folders_without_a_changed_document_are_not_written(spark, stored, tmp_path):
    index = stored([(d, 0, "t", [1.0, 1.0]) for d in range(40)], {d: ("ready", '{"embedding_space":"new"}') for d in range(1, 40)})
    files = lambda: {str(p) for p in (tmp_path / "index" / "chunks").rglob("*.parquet")}
    before = files()
    bucket = index.chunks().where("document_id = 0").first()["bucket"]
    assert index.reindexed(embed, "new", SIZE).count() == 1
    changed = before ^ files()
    assert changed and all(f"bucket={bucket}/" in p for p in changed) and len(held(index)) == 40


def test_new_chunks_are_written_once_beside_the_index_and_not_shuffled_to_be_found(spark, stored, monkeypatch):
    index = stored([(d, 0, "boom" if d == 7 else "t", [2.0, 2.0]) for d in range(3000)])
    kept, replaced, plans = reindex.settled, reindex.StoredIndex._replace, {}
    written = []
    monkeypatch.setattr(reindex, "settled", lambda df: written.append(df.columns) or kept(df))
    monkeypatch.setattr(reindex.StoredIndex, "_replace", lambda self, rows, name: plans.update({name: rows._jdf.queryExecution().executedPlan().toString()}) or replaced(self, rows, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        report = index.reindexed(embed, "new", SIZE)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [c for c in written if "embedding" in c or "metadata_json" in c] == [["document_id", "chunk_index", "page_number", "text", "embedding", "error"]]
    assert "SortMergeJoin" in plans["chunks"] and "BroadcastHashJoin" in plans["chunks"]  # what stays; and what was staged
    assert plans["documents"].count("FileScan") == 2
    assert report.count() == 3000 and report.where("error IS NOT NULL").count() == 1
    assert held(index) == {(d, 0): [2.0, 2.0] if d == 7 else [1.0, 1.0] for d in range(3000)}


def test_repeated_and_null_ids_and_chunks_of_no_document(spark, tmp_path):
    chunks = [(1, 0, "ab", [9.0, 9.0]), (1, 0, "ab", [9.0, 9.0]), (None, 0, "n", [5.0, 5.0]), (99, 0, "o", None), (2, 0, None, None), (3, 0, "boom", None), (4, 0, "x", [8.0, 8.0])]
    old, new = '{"embedding_space":"old"}', '{"embedding_space":"new"}'
    docs = [(1, "ready", old), (1, "failed", None), (None, "ready", new), (2, "ready", "no json"), (3, "ready", new), (4, None, new), (5, "failed", new)]
    index = reindex.StoredIndex(spark, str(tmp_path / "odd"), 8).created(spark.createDataFrame(docs, "document_id long, status string, metadata_json string"), spark.createDataFrame([(d, i, 1, t, e) for d, i, t, e in chunks], reindex.CHUNKS))
    report = index.reindexed(embed, "new", SIZE)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, report.collect()), key=key) == sorted([(1, 2, None), (1, 2, None), (None, 0, "no chunks"), (2, 1, None), (3, 1, "RuntimeError: service down"), (5, 0, "no chunks")], key=key)
    rows = sorted(((r["document_id"], r["text"], r["embedding"]) for r in index.chunks().collect()), key=key)
    assert rows == sorted([(1, "ab", [2.0, 1.0]), (1, "ab", [2.0, 1.0]), (None, "n", [5.0, 5.0]), (99, "o", None), (2, None, [0.0, 1.0]), (3, "boom", None), (4, "x", [8.0, 8.0])], key=key)
    # a document that comes twice is told of its result once for each of its rows in the report
    note = lambda n: {"embedding_space": "new", "embedding_dimensions": "2", "chunk_count": n}
    states = sorted(((r["document_id"], r["status"], json.loads(r["metadata_json"])) for r in index.documents().collect()), key=key)
    want = [(1, "ready", note("2"))] * 4 + [(None, "ready", json.loads(new)), (2, "ready", note("1")), (3, "failed", json.loads(new) | {"error": "RuntimeError: service down"}), (4, None, json.loads(new)), (5, "failed", json.loads(new) | {"error": "no chunks"})]
    assert [(*x[:2], sorted(x[2].items())) for x in states] == [(*x[:2], sorted(x[2].items())) for x in sorted(want, key=key)]


def test_a_second_run_computes_nothing(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def compute(keys):
        def run(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b.append_column("n", b.column("key").cast("binary").cast("string"))

        return keys.mapInArrow(run, "key string, n string")

    memo = Memo(spark, str(tmp_path / "memo"), "n string", 4)
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(50)] + [(99, None)], "i int, name string")
    out = memo.looked_up(rows, "name", compute).collect()
    assert len(out) == 51 and all(r["n"] == r["name"] for r in out) and asked.value == 7
    memo.looked_up(rows, "name", compute).collect()
    assert asked.value == 7
    more = rows.unionByName(spark.createDataFrame([(100, "new")], "i int, name string"))
    assert memo.looked_up(more, "name", compute).where(F.col("n") == "new").count() == 1 and asked.value == 8
    assert memo.stored().count() == 8 and memo.missing(rows.select(F.col("name").alias("key"))).count() == 0


def test_a_change_in_mid_call_changes_nothing_of_it(spark):
    calls = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "a", 5), (4, "b", 20), (5, None, 7)], "call int, dept string, t long")
    versions = spark.createDataFrame([("a", 6, "voice", "x"), ("a", 15, "voice", "y"), ("a", 20, "speed", "2"), ("a", 18, "speed", None), ("b", 21, "voice", "z"), (None, 7, "voice", "n"), ("a", 1, "other", "q")], "dept string, t long, name string, value string")
    want = {1: {"voice": "x", "speed": "1"}, 2: {"voice": "y", "speed": "2"}, 3: {"speed": "1"}, 4: {"speed": "1"}, 5: {"voice": "n", "speed": "1"}}
    for most in (1, 10**6):
        out = as_of(calls, versions, "dept", "t", ["voice", "speed"], {"speed": "1"}, most)
        assert out.columns == ["call", "dept", "t", "settings"] and {r["call"]: r["settings"] for r in out.collect()} == want
    held = {(r["dept"], r["valid_from"], r["valid_to"]): r["settings"] for r in spans(versions, "dept", "t", ["voice", "speed"], {"speed": "1"}).collect()}
    assert held["a", 6, 15] == {"voice": "x", "speed": "1"} and held["a", 20, None] == {"voice": "y", "speed": "2"} and held["a", 15, 18]["voice"] == "y" and (None, 7, None) in held
    assert as_of(calls.limit(0), versions, "dept", "t", ["voice"]).count() == 0 and as_of(calls, versions.limit(0), "dept", "t", ["voice"]).where("size(settings) = 0").count() == 5


def test_settings_of_a_stream_of_calls(spark, tmp_path):
    versions = spark.createDataFrame([("a", 6, "voice", "x"), ("a", 15, "voice", "y")], "dept string, t long, name string, value string")
    spark.createDataFrame([(1, "a", 10), (2, "a", 15), (3, "a", 5)], "call int, dept string, t long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("call int, dept string, t long").parquet(str(tmp_path / "in"))
    q = streamed_as_of(stream, spans(versions, "dept", "t", ["voice"]), "dept", "t").writeStream.format("memory").queryName("asof").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["call"]: r["settings"] for r in spark.table("asof").collect()} == {1: {"voice": "x"}, 2: {"voice": "y"}, 3: None}
