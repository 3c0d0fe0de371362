"""Positional sliding windows of any width and stride over the whole order of a series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.kernel import Value, compile_body, symbol
from tidemark.functions.types import BITS, by_lane, lane_type, wrapped


#: Windows wider than this are put together from two sums of pieces rather than added up one by one.
WIDE = 32


class Frame:
    """What a body sees of one window: elements by place, and aggregates. ``over`` turns an aggregate, as a function and its argument, into one of the window."""

    def __init__(self, kind: T.DataType, width: int, over: Callable[[Callable[[Column], Column], Column], Column], get: Callable[[int], Column], elements: Callable[[], Column]):
        self.kind, self.width, self._over, self._get, self.elements = kind, width, over, get, elements

    def get(self, i: int) -> Column:
        """Element ``i`` of the window, 0 to width - 1."""
        if not 0 <= i < self.width:
            raise IndexError(f"GET({i}) in a window of {self.width}")
        return self._get(i)

    def sum(self) -> Column:
        if isinstance(self.kind, T.StructType):
            return by_lane(self.kind, F.col("x"), lambda c: self._sum(c, lane_type(self.kind)))
        return self._sum(F.col("x"), self.kind)

    def _sum(self, x: Column, kind: T.DataType) -> Column:
        if kind.simpleString() in ("float", "double"):
            return self._over(F.sum, x.cast("double")).cast(kind)
        wide = "bigint" if BITS[kind.simpleString()] <= 32 else "decimal(20,0)"
        return wrapped(self._over(F.sum, x.cast(wide)), kind)

    def mean(self) -> Column:
        """Lanes as doubles, added up and divided by the width."""
        return by_lane(self.kind, F.col("x"), lambda c: self._over(F.sum, c.cast("double")) / self.width)

    def min(self) -> Column:
        return self._over(F.min, F.col("x"))

    def max(self) -> Column:
        return self._over(F.max, F.col("x"))


Body = str | Callable[[Frame], Column]


def _value(body: Body, frame: Frame, to: T.DataType | None) -> Column:
    if callable(body):
        v = body(frame)
        return v.cast(to) if to is not None else v

    def get(i: int) -> Value:
        return symbol(frame.get(i), frame.kind)

    return compile_body(body, {}, to, get)


def sliding(df: DataFrame, kind: T.DataType, width: int, stride: int, body: Body, to: T.DataType | None = None, by: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """``by..., j, x``: for each complete window j, which covers positions j * stride to j * stride + width - 1, the body's value.

    ``df(by..., idx, x)`` has positions without gaps. With a stride below the width, blocks of positions each take
    the first ``width - 1`` rows of the next block along and are windows' partitions of bounded size; with a larger one
    each row is in one window at most, which is a group.

    Aggregates of windows wider than ``WIDE`` take the same work at any width: positions are cut into pieces of
    ``width``, running aggregates go up and down each piece, and a window is the end of one piece and the start of the
    next. Nothing is subtracted, so doubles lose nothing.
    """
    if width < 1 or stride < 1:
        raise ValueError("width and stride must be 1 or more")
    if stride >= width:
        off = F.col("idx") % stride
        rows = df.withColumn("j", F.expr(f"idx div {stride}")).withColumn("off", off).where(F.col("off") < width)
        elements = lambda: F.transform(F.array_sort(F.collect_list(F.struct("off", "x"))), lambda e: e["x"])
        frame = Frame(kind, width, lambda f, x: f(x), lambda i: F.max(F.when(F.col("off") == i, F.col("x"))), elements)
        return rows.groupBy(*by, "j").agg(_value(body, frame, to).alias("v"), F.count("*").alias("n")).where(F.col("n") == width).select(*by, "j", F.col("v").alias("x"))
    block = block or max(4096, 16 * width)
    if block < width - 1:
        raise ValueError("a block must hold a window but for one row")
    home = F.expr(f"idx div {block}")
    blocks = F.when((F.col("idx") % block < width - 1) & (F.col("idx") >= block), F.array(home, home - 1)).otherwise(F.array(home))
    rows = df.withColumn("b", F.explode(blocks))
    order = Window.partitionBy(*by, "b").orderBy("idx")
    here = order.rowsBetween(0, width - 1)
    wanted: list[tuple[Callable[[Column], Column], Column]] = []

    def over(f: Callable[[Column], Column], x: Column) -> Column:
        if width <= WIDE:
            return f(x).over(here)
        wanted.append((f, x))
        return F.col(f"__w{len(wanted) - 1}")

    frame = Frame(kind, width, over, lambda i: F.lead("x", i).over(order) if i else F.col("x"), lambda: F.collect_list("x").over(here))
    value = _value(body, frame, to)
    if wanted:
        piece = Window.partitionBy(*by, "b", "__p")
        rows = rows.repartition(*by, "b").withColumn("__p", F.expr(f"idx div {width}"))
        join = {F.sum: lambda p, q: p + q, F.min: F.least, F.max: F.greatest}
        for i, (f, x) in enumerate(wanted):
            rows = rows.withColumn(f"__d{i}", f(x).over(piece.orderBy(F.desc("idx"))))
        for i, (f, x) in enumerate(wanted):
            rows = rows.withColumn(f"__u{i}", f(x).over(piece.orderBy("idx")))
        for i, (f, _) in enumerate(wanted):
            end = F.lead(f"__u{i}", width - 1).over(order)
            rows = rows.withColumn(f"__w{i}", F.when(F.col("idx") % width == 0, end).otherwise(join[f](F.col(f"__d{i}"), end)))
    rows = rows.withColumn("v", value).withColumn("n", (F.lead("idx", width - 1).over(order) - F.col("idx") + 1) if width > 1 else F.lit(1))
    whole = (F.col("n") == width) & (home == F.col("b")) & (F.col("idx") % stride == 0)
    return rows.where(whole).select(*by, F.expr(f"idx div {stride}").alias("j"), F.col("v").alias("x"))
