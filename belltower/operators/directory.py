"""Finding which listed place a text names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belltower.functions.text import directory_form
from belltower.sources.stored import settled

#: Names of a directory that texts meet as a broadcast.
FEW = 200_000


def named_centres(texts: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, name): the first listed centre whose district or alias is in the text as whole words.

    Words of a text meet the first words of names by an equi-join, and only where they agree the
    words that follow are looked at; no text is compared with every centre.
    """
    alias = centres.select("ordinal", "name", F.explode(F.concat(F.array("district"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    alias = alias.select("ordinal", "name", directory_form(F.col("a")).alias("run")).where("run <> ''").distinct()
    # a centre's place in the list's order: a number, whose least is found without sorting
    alias = settled(alias.withColumn("place", F.dense_rank().over(Window.orderBy("ordinal", "name"))))
    words = F.split("run", " ")
    firsts = alias.select(F.element_at(words, 1).alias("first"), F.size(words).alias("n"), "run", "place")
    if alias.limit(FEW + 1).count() <= FEW:
        firsts = F.broadcast(firsts)
    w = texts.select(key, F.split(directory_form(F.col("text")), " ").alias("w")).select(key, "w", F.posexplode("w").alias("at", "first"))
    hits = w.join(firsts, "first").where((F.col("n") == 1) | (F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ") == F.col("run")))
    best = hits.groupBy(key).agg(F.min("place").alias("place"))
    return best.join(alias.select("place", "ordinal", "name").distinct(), "place").select(key, "ordinal", "name")
