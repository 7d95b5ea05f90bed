"""Where rows go: appended tables, JSON lines, and a Markdown table of a short report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Adds rows to a Parquet table, in folders by the given columns."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; nulls are written."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def streamed(rows: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Appends what a stream has now to a folder, each row once."""
    return rows.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def timing_line(fields: dict[str, Column], mark: str = "Turn timing") -> Column:
    """key=value pairs behind a mark; null is written as `-`."""
    return F.concat_ws(" ", F.lit(mark), *(F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("-"))) for k, c in fields.items()))


def markdown_row(columns: list[Column]) -> Column:
    """One row of a Markdown table; bars and line breaks inside a cell are escaped, null is empty."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))


def markdown(rows: DataFrame, path: str, order: list[str]) -> None:
    """A report as one Markdown file: for reports a reader can take in, since a single task writes it."""
    names = rows.columns
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + " --- |" * len(names))], "at long, value string")
    body = rows.orderBy(*order).select(markdown_row([F.col(n) for n in names]).alias("value"))
    lines = body.withColumn("at", F.monotonically_increasing_id() + 2).select("at", "value")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
