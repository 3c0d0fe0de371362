"""A dense position for every row in the order of the keys, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the first cut, and of the second in all but for one more to each cell of the first.
CELLS = 1 << 14
#: Bytes in common that are looked for.
LONGEST = 1 << 10


def _numeric(df: DataFrame, key: str) -> Column:
    """A number that grows with the key, or stays."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.NumericType):
        return F.col(key).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(key)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(key)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        k = F.col(key)  # by its parts, as a cast would go through the session's zone
        return ((F.unix_date(k.cast("date")).cast("double") * 24 + F.hour(k)) * 60 + F.minute(k)) * 60 + F.extract(F.lit("SECOND"), k)
    if isinstance(kind, T.BooleanType):
        return F.col(key).cast("int").cast("double")
    raw = F.rpad(F.hex(F.substring(F.col(key).cast("binary"), F.col("__same") + 1, F.lit(7))), 14, "0")
    return F.conv(raw, 16, 10).cast("double")


def _with_same(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``__same``, how many bytes all texts begin with in common, up to ``LONGEST``: those that the first and the last have."""
    raw = F.col(key).cast("binary")
    ends = df.agg(F.min(raw).alias("a"), F.max(raw).alias("b"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("a"), F.length("b"), F.lit(LONGEST))))
    same = F.size(F.filter(at, lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    return df.join(F.broadcast(ends.select(same.alias("__same"))), how="left")  # one row


def _parts(key: Column, low: Column, high: Column, n: Column) -> Column:
    """Which of ``n`` parts of one width between ``low`` and ``high`` the key is in, from 0 on."""
    return F.when(high > low, F.least(F.floor((key - low) / (high - low) * n), n - 1)).otherwise(0).cast("int")


def cut(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``__cell`` and ``__part``, which together rise with the key.

    Cells are of one width between the least and the greatest key. A cell is cut again, between its own least and greatest
    key, into as many parts as its share of the rows asks for.
    """
    text = isinstance(df.schema[key].dataType, T.StringType | T.BinaryType)
    if text:
        df = _with_same(df, key)
    first = _numeric(df, key)
    ends = df.agg(F.min(first).alias("__low"), F.max(first).alias("__high"), F.count("*").alias("__all"))
    celled = df.join(F.broadcast(ends), how="left")  # one row
    celled = celled.withColumn("__cell", _parts(first, F.col("__low"), F.col("__high"), F.lit(CELLS))).drop("__low", "__high")
    share = F.floor(F.count("*") / F.first("__all") * CELLS) + 1
    cells = celled.groupBy("__cell").agg(share.alias("__n"), F.min(first).alias("__low"), F.max(first).alias("__high"))
    celled = celled.drop("__all").join(F.broadcast(cells), "__cell")  # at most CELLS rows
    return celled.withColumn("__part", _parts(first, F.col("__low"), F.col("__high"), F.col("__n"))).drop("__low", "__high", "__n", "__same")


def with_index(df: DataFrame, keys: tuple[str, ...], name: str = "idx") -> DataFrame:
    """``df`` with ``name``, the position of each row by ``keys`` from 0 on.

    The rows are cut by the first key, twice, so that neither keys far from the others nor keys close together make a
    part large. The rows before a part are a running sum over the parts, a table of bounded size; the place in a part
    is a window over that part's rows alone. The keys need not be dense, but must be unique for the order to be
    determined, and not null. A text as first key is cut by the 7 bytes behind what all begin with, and texts that agree in
    these share a part.
    """
    here = ["__cell", "__part"]
    celled = cut(df, keys[0])
    sizes = celled.groupBy(*here).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(*here).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*here, F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*here).orderBy(*keys))
    out = celled.withColumn("__place", place).join(F.broadcast(starts), here)  # at most 2 * CELLS rows
    return out.withColumn(name, F.col("__start") + F.col("__place") - 1).drop(*here, "__place", "__start")
