from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from belltower.llm import fill_middle
from tests.llm.helpers import HARD, documents

ODD = [*HARD, (30, "a😀b𝐀c\n d"), (31, "holds <S> itself"), (32, "\x00a\U0010ffff."), (33, "<"), (34, "ends in <P"), (35, "S> begins so"), (36, "‍🙂‍")]


def plainly(doc_id, text):
    """The contract's row, computed by slices of the text."""
    t = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not n or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
    cut = form != "plain"
    return (doc_id, n, form, a if cut else None, b - a if cut else None, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_slices_of_texts(spark):
    rng = random.Random(3)
    rows = [*ODD, *((100 + i, "".join(rng.choice("ab <>PSM\n😀é") for _ in range(rng.randint(0, 40)))) for i in range(400))]
    found = order(fill_middle.query(documents(spark, rows)).collect())
    assert found == order(plainly(*r) for r in rows)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.query(documents(spark, [])).count() == 0


def test_pieces_of_every_grammar_joined_are_the_text(spark):
    df = documents(spark, ODD).where("text IS NOT NULL")
    for name, grammar in fill_middle.GRAMMARS.items():
        rows = df.select("text", fill_middle.units(F.col("text"), grammar).alias("p")).collect()
        assert all("".join(r["p"]) == r["text"] and all(r["p"]) for r in rows), name
    cut = lambda t, g: spark.createDataFrame([(t,)], "t string").select(fill_middle.units(F.col("t"), fill_middle.GRAMMARS[g])).first()[0]
    assert cut("One two. Three 4you!  Yes", "words") == ["One ", "two. ", "Three ", "4you!  ", "Yes"]
    assert cut("One two. Three 4you!  Yes", "sentences") == ["One two.", " Three 4you!", "  Yes"]
    assert cut("a\n\nb\n", "lines") == ["a\n", "\n", "b\n"]
    assert cut("ab𝐀1𝟐 🙂x", "scripts") == ["ab𝐀", "1𝟐", " 🙂", "x"]
    assert cut("", "chars") == [] and cut("a😀", "chars") == ["a", "😀"]


def test_general_form_keeps_columns_that_clash(spark):
    df = documents(spark, ODD).withColumn("prefix", F.lit("own")).withColumn("__pieces", F.lit(1))
    out = fill_middle.transformed(df, "words", plain_from=100, spm_below=50)
    assert out.columns == [*df.columns, "n_", "form", "prefix_", "middle", "suffix", "output"] and out.count() == len(ODD)
    for r in out.where("form <> 'plain'").collect():
        assert r["prefix"] == "own" and r["prefix_"] + r["middle"] + r["suffix"] == r["text"]
    back = fill_middle.restored(out, "output", "form", "again")
    assert back.where("NOT again <=> coalesce(text, '')").count() == 0
    plan = fill_middle.query(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
