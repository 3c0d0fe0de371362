"""One-pass summaries: n, mean, sum of squared differences, max and min, which can be merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN, INF = float("nan"), float("inf")


def stats(x: Column) -> Column:
    """Summary of a column as ``struct(n, mu, m2, max, min)``. Nothing at all has n 0, mean 0, max -inf, min inf."""
    x = x.cast("double")
    n = F.count(x)
    return F.struct(
        n.alias("n"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mu"),
        F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2"),
        F.coalesce(F.max(x), F.lit(-INF)).alias("max"),
        F.coalesce(F.min(x), F.lit(INF)).alias("min"),
    )


def merge(a: Column, b: Column) -> Column:
    """The summary of two sets of values from the summaries of each: the mean moves towards that of ``b`` by the share of rows that ``b`` has."""
    n = a["n"] + b["n"]
    d, share = b["mu"] - a["mu"], b["n"].cast("double") / n
    both = F.struct(n.alias("n"), (a["mu"] + d * share).alias("mu"), (a["m2"] + b["m2"] + d * d * a["n"] * share).alias("m2"), F.greatest(a["max"], b["max"]).alias("max"), F.least(a["min"], b["min"]).alias("min"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


#: The type of a summary, which is an element type too.
KIND = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("mu", "m2", "max", "min"))])


def empty() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mu"), F.lit(0.0).alias("m2"), F.lit(-INF).alias("max"), F.lit(INF).alias("min"))


def accessors(s: Column) -> dict[str, Column]:
    """What a summary tells: count, mean, sum, max, min, variances, deviations and a text."""
    variance = F.when(s["n"] == 0, NAN).otherwise(s["m2"] / F.greatest(s["n"], F.lit(1)))
    sample = F.when(s["n"] <= 1, NAN).otherwise(s["m2"] / F.greatest(s["n"] - 1, F.lit(1)))
    out = {"count": s["n"], "mean": s["mu"], "sum": s["n"] * s["mu"], "max": s["max"], "min": s["min"], "variance": variance, "sample_variance": sample, "stdev": F.sqrt(variance), "sample_stdev": F.sqrt(sample)}
    out["text"] = F.format_string("(count: %d, mean: %f, stdev: %f, max: %f, min: %f)", s["n"], s["mu"], out["stdev"], s["max"], s["min"])
    return out
