from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from belltower.llm import quality
from tests.llm.helpers import HARD, documents

SF = "/root/testdata/sf0.01"


def test_pairs_meet_each_text_of_the_larger_class_and_none_twice():
    for good, bad in ((10, 3), (3, 10), (5, 5), (1, 4), (20, 9)):
        i, j = quality.pairs(good, bad, 4)
        assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i) == max(good, bad) * min(4, good, bad)
        assert set(i) == set(range(good)) or good < bad
        assert i.max() < good and j.max() < bad


def test_weights_minimise_the_pairwise_loss():
    rng = np.random.default_rng(6)
    d = rng.normal(0.5, 1, (400, 3))
    w = quality.fitted(d, 0.01)
    loss = lambda v: np.logaddexp(0, -d @ v).mean() + 0.005 * v @ v
    for k in range(3):
        for step in (1e-3, -1e-3):
            assert loss(w + step * np.eye(3)[k]) > loss(w)


def test_quantile_falls_between_scores():
    s, one = np.array([1.0, 2.0, 2.0, 5.0]), np.ones(4)
    assert quality.quantile(s, one, 0.25) == 1.5 and quality.quantile(s, one, 0.7) == 3.5
    assert quality.quantile(s, np.array([3.0, 1, 1, 1]), 0.5) == 1.5 and quality.quantile(np.ones(3), np.ones(3), 0.2) == 1


def test_measures_tell_shape():
    m = lambda t: dict(zip(quality.MEASURES, quality.measures(t), strict=True))
    assert m("") == m("  \n") == dict.fromkeys(quality.MEASURES, 0.0)
    assert m("AB cd")["upper"] == 0.5 and m("a 1 2")["digits"] == 2 / 3 and m("a$$ b")["signs"] == 0.5 and m("a$$ b")["doubled"] == 0.5
    x = m("a b a b a b")
    assert x["commonest"] == 2 / 16 and x["again"] == 2 / 16 and x["stutter"] == 0
    assert m("w w w w")["stutter"] == 3 / 14 and m("a | b |")["bare"] == 0.5 and m("🙂é")["signs"] == 0


def test_held_out_texts_are_told(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.query(docs, labels).join(labels, "doc_id").where("quality IN (0, 1)").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.98 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_no_held_out_label_is_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r["doc_id"], r["score"]) for r in quality.query(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_hard_texts_and_few_labels(spark):
    rows = [*HARD, *((i, f"Some plain text number {i} is here, and it reads well.") for i in range(20, 40)), *((i, "junk junk JUNK$$ || junk junk junk") for i in range(40, 60))]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(20, 60)] + [(None, 0, 0), (21, None, 0), (7, 5, 0)], "doc_id long, quality int, toxic int")
    out = quality.query(docs, labels).collect()
    assert len(out) == len(rows) and all(r["predicted"] == int(r["doc_id"] < 40) for r in out if (r["doc_id"] or 0) >= 20)
    kept = quality.good_only(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} & set(range(40, 60)) == set()
    none = quality.query(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r["score"] == 1 and r["predicted"] == 1 for r in none)
    assert quality.query(documents(spark, []), labels).count() == 0


def test_every_labelled_text_is_learned_from(spark, monkeypatch):
    """Quantiles in passes, sums over buckets and the threshold equal those of one table in numpy."""
    rng = np.random.default_rng(3)
    x, y = np.round(rng.gamma(1.0, 1.0, (3400, len(quality.MEASURES))), 2), (rng.random(3400) < 0.9).astype(int)
    x[y == 1] += 0.3
    chosen = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "quality int, x array<double>").repartition(5)
    sums = lambda f: quality.summed(chosen, f, "x", "quality")
    got = quality.quantiles(sums, lambda a, b: list(np.ascontiguousarray(a.T)), [len(x)] * x.shape[1], (0.005, 0.5, 0.995))
    assert np.allclose(got, np.quantile(x, (0.005, 0.5, 0.995), 0).T, atol=1e-12)
    for share in (0.0001, 0.1, 0.37, 0.9999):
        w = np.where(y == 1, 0.7, 2.0)
        assert quality.cut_at(sums, lambda a: a[:, 0] - a[:, 1], (2.0, 0.7), float(w.sum()), share) == quality.quantile(x[:, 0] - x[:, 1] + 0.0, w, share)
    good, bad = int(y.sum()), int((1 - y).sum())
    met = quality.bucketed(chosen, good, bad, 400, 100)
    rows = met.collect()
    assert len(rows) == -(-good // 400) and sum(r["n_good"] for r in rows) == good and all(r["n_bad"] >= 40 for r in rows)
    assert {tuple(v) for r in rows for v in np.array(r["bad"]).reshape(-1, x.shape[1])} == {tuple(v) for v in x[y == 0]}
    model = quality.learned(chosen, met, 0.1, good, bad)
    assert abs(((model.raw(x) < model.threshold) * np.where(y == 1, 0.9 / good, 0.1 / bad)).sum() - 0.1) < 0.01
