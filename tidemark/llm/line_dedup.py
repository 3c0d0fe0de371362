"""Line dedup by overlapping three-line windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_lines, n_removed, text``.

    A window is three lines in a row, compared as they are. Of the windows that are equal over all documents the first
    by (identifier, line) stays; every later one is covered, in the same document or in another, and the lines that
    covered windows hold are removed. Windows of white space alone are not compared. Equality is that of two 64-bit
    hashes of each line and window.

    A null text counts as empty, which is one empty line; texts of fewer than three lines stay as they are. A null
    identifier comes after all others. Rows that repeat identifier and text are one document and fare alike: they
    keep the first occurrence together. Texts of any length are read whole, a row for each window. An empty table gives
    an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("k1", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("k2", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    hashed = docs.where(F.contains("text", F.lit("\n"))).select("k1", "k2", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(F.regexp_replace(x, r"\s", "")) == "").alias("e"))).alias("h"))
    hashed = hashed.withColumn("n", F.size("h") - 2).where("n > 0")
    three = F.arrays_zip(F.slice("h", 1, F.col("n")).alias("x"), F.slice("h", 2, F.col("n")).alias("y"), F.slice("h", 3, F.col("n")).alias("z"))
    rows = hashed.select("k1", "k2", F.posexplode(three).alias("at", "w")).where("not (w.x.e and w.y.e and w.z.e)")
    rows = scratch.put(rows.select("k1", "k2", "at", F.xxhash64("w.x.a", "w.y.a", "w.z.a").alias("w1"), F.xxhash64("w.x.b", "w.y.b", "w.z.b").alias("w2")))
    first = rows.groupBy("w1", "w2").agg(F.min(F.struct("k1", "k2", "at")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = rows.join(first, ["w1", "w2"]).where(F.struct("k1", "k2", "at") != F.col("first")).select("k1", "k2", "at").distinct()
    # Runs of covered lines: windows that touch or overlap join.
    order = Window.partitionBy("k1", "k2").orderBy("at")
    starts = later.withColumn("new", F.coalesce((F.col("at") > F.lag("at").over(order) + 3).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(order)).groupBy("k1", "k2", "run").agg(F.min("at").alias("s"), (F.max("at") + 3).alias("e"))
    runs = runs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"), F.sum(F.col("e") - F.col("s")).alias("n_removed"))
    out = docs.join(runs, ["k1", "k2"], "left").withColumn("l", lines)
    edge = lambda i: F.element_at("runs", i.cast("int"))
    begin = lambda i: F.when(i == 0, 0).otherwise(edge(F.greatest(i, F.lit(1)))["e"])
    stop = lambda i: F.when(i == F.size("runs"), F.size("l")).otherwise(edge(F.least(i + 1, F.size("runs")))["s"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.slice("l", begin(i) + 1, stop(i) - begin(i))))
    return out.select(
        "doc_id",
        F.size("l").cast("long").alias("n_lines"),
        F.coalesce(F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
