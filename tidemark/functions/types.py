"""Element types: six scalars and tuples of 2, 4, 8 or 16 of one of them, as structs ``_1`` to ``_N``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS: dict[str, T.DataType] = {"char": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}
ARITIES = (1, 2, 4, 8, 16)
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def element_type(name: str) -> T.DataType:
    """The Spark type of a name such as ``double`` or ``int4``."""
    base = name.rstrip("0123456789")
    n = int(name[len(base) :] or 1)
    if base not in SCALARS or n not in ARITIES:
        raise ValueError(f"no element type {name!r}")
    return SCALARS[base] if n == 1 else T.StructType([T.StructField(f"_{i + 1}", SCALARS[base]) for i in range(n)])


def lanes(kind: T.DataType) -> int:
    return len(kind.fields) if isinstance(kind, T.StructType) else 1


def summary(kind: T.DataType) -> bool:
    """Whether elements are summaries, which only merge and report."""
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["n", "mu", "m2", "max", "min"]


def check(kind: T.DataType) -> None:
    if summary(kind):
        return
    own = {f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {kind}
    if len(own) != 1 or own.pop() not in SCALARS.values() or lanes(kind) not in ARITIES:
        raise TypeError(f"not an element type: {kind.simpleString()}")


def lane_type(kind: T.DataType) -> T.DataType:
    return kind.fields[0].dataType if isinstance(kind, T.StructType) else kind


def double_of(kind: T.DataType) -> T.DataType:
    """The type of the same lanes as doubles."""
    n = lanes(kind)
    return T.DoubleType() if n == 1 else T.StructType([T.StructField(f"_{i + 1}", T.DoubleType()) for i in range(n)])


def by_lane(kind: T.DataType, x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` on a scalar, or on each lane into a struct."""
    n = lanes(kind)
    return f(x) if n == 1 else F.struct(*[f(x[f"_{i + 1}"]).alias(f"_{i + 1}") for i in range(n)])


def zip_lanes(kind: T.DataType, x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    n = lanes(kind)
    return f(x, y) if n == 1 else F.struct(*[f(x[f"_{i + 1}"], y[f"_{i + 1}"]).alias(f"_{i + 1}") for i in range(n)])


def wrapped(exact: Column, kind: T.DataType) -> Column:
    """An exact decimal sum as a two's-complement value of an integer type."""
    half = 2 ** (BITS[kind.simpleString()] - 1)
    lit = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    return (F.pmod(exact.cast("decimal(38,0)") + lit(half), lit(2 * half)) - lit(half)).cast(kind)


def typed_sum(x: Column, kind: T.DataType) -> Column:
    """Sum that stays in its type: integers wrap around, none at all gives zero.

    An integer is added up in pieces of 22 bits, the last with the sign, which no table is long enough to overflow.
    """
    if bits := BITS.get(kind.simpleString()):
        whole, exact = x.cast("bigint"), F.lit(0).cast("decimal(38,0)")
        for low in range(0, bits, 22):
            piece = F.shiftright(whole, low) if low + 22 >= bits else F.shiftright(whole, low).bitwiseAND(F.lit((1 << 22) - 1).cast("bigint"))
            total = F.coalesce(F.sum(piece), F.lit(0).cast("bigint")).cast("decimal(20,0)")
            exact = exact + total * F.lit(str(1 << low)).cast("decimal(17,0)")
        return wrapped(exact, kind)
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0)).cast(kind)
