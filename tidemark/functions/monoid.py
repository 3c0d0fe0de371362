"""Reductions by an associative and commutative operation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import typed_sum

FOLD = 12  # rows that one task folds in a round: 2**12


@dataclass(frozen=True)
class Monoid:
    """``lift`` makes a value of an element, ``merge`` joins two, ``zero`` changes none that it is merged with, ``finish`` ends."""

    zero: Column
    merge: Callable[[Column, Column], Column]
    lift: Callable[[Column], Column] = lambda x: x
    finish: Callable[[Column], Column] = lambda x: x


def builtin(body: str, kind: T.DataType) -> Callable[[Column, Column], Column] | None:
    """Spark's own aggregate for a known body over x and y; its second argument is the zero, for no rows."""
    known = "".join(body.replace("return", "").split()).rstrip(";")
    number = lambda x: F.nanvl(x, F.lit(None)) if kind.simpleString() in ("float", "double") else x  # noqa: E731  fmax and fmin prefer what is a number
    simple = {"max(x,y)": F.max, "fmax(x,y)": lambda x: F.max(number(x)), "min(x,y)": F.min, "fmin(x,y)": lambda x: F.min(number(x)), "x&y": F.bit_and, "x|y": F.bit_or, "x^y": F.bit_xor}
    if known in ("x+y", "y+x"):
        return lambda x, zero: typed_sum(x, kind)
    swapped = known.translate(str.maketrans("xy", "yx")).replace("may", "max")
    f = simple.get(known) or simple.get(swapped)
    return (lambda x, zero: F.coalesce(f(x), zero).cast(kind)) if f else None


def reduce_tree(df: DataFrame, monoid: Monoid, by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., value``: one row, or one for each value of ``by``.

    Rows are numbered by partition, 2**33 numbers to each, and folded by groups of 2**12 numbers three times over. What
    is left for the last fold is a row for each eight partitions and value of ``by``: 4,096 rows of 32,768 partitions.
    """
    at = F.monotonically_increasing_id()
    now = df.select(*by, monoid.lift(F.col("x")).alias("v"), F.shiftright(at, FOLD).alias("g"))
    fold = F.aggregate(F.collect_list("v"), monoid.zero, monoid.merge)
    for _ in range(3):
        now = now.groupBy(*by, "g").agg(fold.alias("v")).select(*by, "v", F.shiftright("g", FOLD).alias("g"))
    return now.groupBy(*by).agg(monoid.finish(fold).alias("value"))
