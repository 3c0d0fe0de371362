"""Reader of benchmark text reports and writer of the table that compares them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = ["Benchmark", "cpu", "size", "Mode", "Cnt", "Score", "Error", "Units"]


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a report in text files; see :func:`parse_report`."""
    return parse_report(spark.read.text(path))


def parse_report(lines: DataFrame) -> DataFrame:
    """``name, cpu, size, cnt, score`` of a report's lines, ``lines(value)``.

    Headers may repeat; one that has other columns makes reading fail. A name loses what is before its first dot; lines of
    fewer than six words, null and empty ones among them, are passed over.
    """
    words = F.split(F.trim("value"), r"\s+")
    header = F.col("w")[0] == HEADER[0]
    bad = F.raise_error(F.lit("a header of the report has other columns")).cast("boolean")
    right = F.col("w") == F.array(*[F.lit(h) for h in HEADER])
    rows = lines.select(words.alias("w")).where(F.when(header & ~right, bad).when(header, False).otherwise(F.size("w") >= 6))
    return rows.select(F.regexp_replace(F.col("w")[0], r"^[^.]*\.", "").alias("name"), F.col("w")[1].alias("cpu"), F.col("w")[2].cast("long").alias("size"), F.col("w")[4].cast("long").alias("cnt"), F.col("w")[5].cast("double").alias("score"))


def pivot_report(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row for each size, a column for each name (``_gpu`` behind the name where cpu is false): the mean of the scores by their counts."""
    named = rows.withColumn("series", F.when(F.col("cpu") == "false", F.concat("name", F.lit("_gpu"))).otherwise(F.col("name")))
    return named.groupBy("size").pivot("series", names).agg(F.sum(F.col("score") * F.col("cnt")) / F.sum("cnt"))


def table_lines(pivoted: DataFrame) -> DataFrame:
    """Lines ``line`` of the table by size, null for the head line, which names the columns: separated by spaces, 3 decimals, ``nan`` where there is no score."""
    names = [c for c in pivoted.columns if c != "size"]
    cells = [F.when(F.col(n).isNull(), "nan").otherwise(F.format_string("%.3f", F.col(n))) for n in names]
    rows = pivoted.select("size", F.concat_ws(" ", F.col("size").cast("string"), *cells).alias("line"))
    head = pivoted.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("size"), F.lit(" ".join(["size", *names])).alias("line"))
    return head.union(rows).orderBy(F.asc_nulls_first("size"))
