"""JSON lists that a user edits: synonym groups and the directory of centres. A file that is missing or broken gives no rows, so that what reads it goes on."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    """(entries): the list of a JSON file, bare or under a name; null where the file holds neither."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:  # no such file
        text = spark.createDataFrame([], "value string")
    bare = F.ltrim("value").startswith("[")
    return text.select(F.when(bare, F.from_json("value", f"array<{kind}>")).otherwise(F.from_json("value", f"{name} array<{kind}>")[name]).alias("entries"))


def synonym_groups(spark: SparkSession, path: str, form: Column | None = None) -> DataFrame:
    """(term, synonym) of [[...], ...] or {"groups": [[...], ...]}: every word of a group stands for each other one. Groups of one word and entries that are no lists are ignored. form: how a word `w` is written in the index."""
    groups = entries(spark, path, "groups", "string").select(F.explode("entries").alias("k")).withColumn("g", F.from_json("k", "array<string>")).where(F.size("g") > 1)
    words = groups.select("k", F.explode("g").alias("w")).select("k", (F.trim("w") if form is None else form).alias("w")).where("w <> ''").distinct()
    return words.withColumnRenamed("w", "term").join(words.withColumnRenamed("w", "synonym"), "k").where("term <> synonym").select("term", "synonym").distinct()


def centres(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, district, name, phone, address, aliases) of [{...}, ...] or {"centres": [{...}, ...]}; entries without a district or name are dropped."""
    listed = entries(spark, path, "centres", "struct<district:string,name:string,phone:string,address:string,aliases:array<string>>")
    c = listed.select(F.posexplode("entries").alias("ordinal", "c")).select("ordinal", F.trim("c.district").alias("district"), F.trim("c.name").alias("name"), "c.phone", "c.address", "c.aliases")
    return c.where((F.coalesce("district", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
