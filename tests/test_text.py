from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from belltower.functions import text
from belltower.plans import retrieval


def test_normalized_text_trims_what_its_sql_trims(spark):
    """Space separators at the ends of lines go, line separators and other blanks stay, also at the end of the text."""
    odd = ["\u0020", "\u00a0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u180e", "\u200b", "\ufeff", "\u0085", "\u001c", "\u000b", "\u0000", "\u0009", "\u000d", "\u000a"]
    texts = [f"{a}one {a}{b}\n{b} two{a}\n\n\n{b}\nthree {b}{a}" for a in odd for b in odd] + ["", " ", "a \u2028", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in rows.select("doc_id", F.md5(text.normalized(F.col("text")).cast("binary"))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    assert got == dict(con.execute(retrieval.ORACLE_SQL["normalized_text"]).fetchall())


def test_whole_texts_are_sent_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for query in ("document_chunks", "search_text_nfkc"):
        spark.conf.set(name, "10000")
        try:
            assert retrieval.QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0 and int(spark.conf.get(name)) <= 1000
        finally:
            spark.conf.unset(name)
