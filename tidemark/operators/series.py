"""An ordered series: one value column ``x`` and the key columns that order it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import stats as S
from tidemark.functions.kernel import compile_body, symbol
from tidemark.functions.monoid import Monoid, builtin, reduce_tree
from tidemark.functions.types import by_lane, check, double_of, element_type, lane_type, lanes, summary, typed_sum
from tidemark.operators.index import with_index
from tidemark.operators.windows import Body, sliding

#: Values of a key that a task of a full join takes at a time from either series.
PIECE = 4096


def _kind(to: str | T.DataType) -> T.DataType:
    return element_type(to) if isinstance(to, str) else to


class Series:
    """Every method but ``sum``, ``stats``, ``count``, ``reduce`` and ``collect`` is lazy; each of those has a lazy twin ending in ``_df``.

    ``keys`` must order the rows uniquely, and are their positions if ``placed``; ``by`` splits the series into one for each of its values, null being one.
    """

    def __init__(self, df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = (), placed: bool = False):
        self.df, self.keys, self.by, self.placed = df, keys, by, placed
        check(self.kind)

    # -- sources
    @classmethod
    def wrap(cls, df: DataFrame, value: str | Column, order_by: str | Iterable[str], by: str | Iterable[str] = (), partitions: int | None = None) -> Series:
        """A series of the column ``value``; rows where it or a key of the order is null are left out, as they have no value or no place. ``partitions`` range-partitions by the keys."""
        listed = lambda x: (x,) if isinstance(x, str) else tuple(x)
        keys, by = listed(order_by), listed(by)
        x = F.col(value) if isinstance(value, str) else value
        names = [f"k{i}" for i in range(len(keys))], [f"g{i}" for i in range(len(by))]
        out = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names[0], strict=True)), *(F.col(k).alias(n) for k, n in zip(by, names[1], strict=True)), x.alias("x"))
        out = out.where(" and ".join(f"{c} is not null" for c in ("x", *names[0])))
        if partitions:
            out = out.repartitionByRange(partitions, *names[0])
        return cls(out, tuple(names[0]), tuple(names[1]))

    @classmethod
    def from_values(cls, spark: SparkSession, values: list, kind: str | T.DataType) -> Series:
        rows = [(i, v) for i, v in enumerate(values)]
        return cls(spark.createDataFrame(rows, T.StructType([T.StructField("k0", T.LongType()), T.StructField("x", _kind(kind))])), ("k0",))

    @classmethod
    def range(cls, spark: SparkSession, n: int, partitions: int | None = None) -> Series:
        """0, 1, ... n - 1 as doubles."""
        return cls(spark.range(0, n, 1, partitions).select(F.col("id").alias("k0"), F.col("id").cast("double").alias("x")), ("k0",), placed=True)

    @property
    def kind(self) -> T.DataType:
        return self.df.schema["x"].dataType

    def _with(self, x: Column) -> Series:
        return Series(self.df.select(*self.keys, *self.by, x.alias("x")), self.keys, self.by, self.placed)

    # -- element by element
    def map(self, body: str | Callable[[Column], Column], to: str | T.DataType | None = None) -> Series:
        """Each element by a callable on columns, a body in C that returns, or an SQL expression in ``x``."""
        kind = _kind(to) if to is not None else None
        if summary(self.kind):
            raise TypeError("summaries only merge and report")
        if callable(body):
            x = body(F.col("x"))
        elif "return" in body:
            return self._with(compile_body(body, {"x": symbol(F.col("x"), self.kind)}, kind or (self.kind if lanes(self.kind) == 1 else None)))
        else:
            x = F.expr(body)
        return self._with(x.cast(kind) if kind is not None else x)

    def map_arrow(self, f: Callable[[pa.Array], pa.Array], to: str | T.DataType) -> Series:
        """Each element by a function on Arrow arrays of a batch, for bodies that columns can't express."""
        return self._with(F.arrow_udf(f, _kind(to))(F.col("x")))

    def flat_map(self, f: Callable[[Column], Column]) -> DataFrame:
        """``keys..., by..., x``: the elements of the array that ``f`` makes of each."""
        return self.df.select(*self.keys, *self.by, F.explode(f(F.col("x"))).alias("x"))

    def map_batches(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``f`` makes of each partition's rows, ``keys..., by..., x``, that come in Arrow batches."""
        return self.df.mapInArrow(f, schema)

    def glom(self) -> DataFrame:
        """``part, xs``: the elements of each Arrow batch of a partition, which is as much as one task holds at a time."""

        def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            for b in batches:
                x = b.column(b.schema.get_field_index("x"))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)], names=["part", "xs"])

        return self.df.mapInArrow(batch, f"part int, xs array<{self.kind.simpleString()}>")

    def to(self, kind: str | T.DataType) -> Series:
        """Cast, lane by lane; doubles are cut off towards zero."""
        kind = _kind(kind)
        if lanes(kind) != lanes(self.kind):
            raise TypeError("a cast keeps the number of lanes")
        return self if kind == self.kind else self._with(by_lane(self.kind, F.col("x"), lambda c: c.cast(lane_type(kind))))

    def where(self, condition: str | Column) -> Series:
        return Series(self.df.where(condition), self.keys, self.by)

    # -- reductions
    def _lanes(self) -> int:
        if summary(self.kind):
            raise TypeError("summaries only merge and report")
        return lanes(self.kind)

    def _agg(self, value: Column, name: str) -> DataFrame:
        return self.df.groupBy(*self.by).agg(value.alias(name)) if self.by else self.df.agg(value.alias(name))

    def sum_df(self, name: str = "sum") -> DataFrame:
        """The sum in the type of the elements: integers wrap around; of no elements it is zero."""
        self._lanes()
        return self._agg(by_lane(self.kind, F.col("x"), lambda c: typed_sum(c, lane_type(self.kind))), name)

    def sum(self):
        return self.sum_df().first()[0]

    def sum_wide_df(self, name: str = "sum") -> DataFrame:
        """Spark's own sum, in a wider type; of no elements it is null."""
        return self._agg(by_lane(self.kind, F.col("x"), F.sum), name)

    def stats_df(self, name: str = "stats") -> DataFrame:
        if self._lanes() != 1:
            raise TypeError("stats are of scalars")
        return self._agg(S.stats(F.col("x")), name)

    def merged_df(self, name: str = "stats") -> DataFrame:
        """One summary of a series of summaries."""
        if not summary(self.kind):
            raise TypeError("only summaries merge")
        return self.reduce_df(Monoid(S.empty(), S.merge), name=name)

    def stats_report_df(self) -> DataFrame:
        return (self.merged_df() if summary(self.kind) else self.stats_df()).select(*self.by, *(c.alias(n) for n, c in S.accessors(F.col("stats")).items()))

    def stats(self):
        return self.stats_df().first()[0]

    def count_df(self, name: str = "count") -> DataFrame:
        return self._agg(F.count("*"), name)

    def count(self) -> int:
        return self.df.count()

    def reduce_df(self, op: str | Monoid, zero=None, name: str = "value") -> DataFrame:
        """By a body over x and y, with the neutral ``zero`` for no elements, or by a :class:`Monoid`. The operation must be associative and commutative."""
        if isinstance(op, Monoid):
            return reduce_tree(self.df, op, self.by).withColumnRenamed("value", name)
        if lanes(self.kind) == 1 and (f := builtin(op, self.kind)):
            return self._agg(f(F.col("x"), F.lit(zero)), name)
        kind = self.kind

        def merge(x: Column, y: Column) -> Column:
            return compile_body(op, {"x": symbol(x, kind), "y": symbol(y, kind)}, kind) if "return" in op else F.expr(op)

        if "return" not in op:
            raise ValueError("an operation is a body that returns, one that Spark knows, or a Monoid")
        start = zero if isinstance(zero, Column) else F.lit(zero)
        return reduce_tree(self.df, Monoid(start.cast(kind), merge), self.by).withColumnRenamed("value", name)

    def reduce(self, op: str | Monoid, zero=None):
        return self.reduce_df(op, zero).first()[0]

    # -- windows
    @cached_property
    def indexed(self) -> DataFrame:
        """``by..., idx, x``: each element with its position."""
        if self.placed:
            return self.df.select(*self.by, F.col(self.keys[0]).cast("long").alias("idx"), "x")
        if not self.by:
            return with_index(self.df, self.keys).select("idx", "x")
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy(*self.by).orderBy(*self.keys)).cast("long") - 1
        return self.df.withColumn("idx", place).select(*self.by, "idx", "x")

    def sliding(self, width: int, stride: int, body: Body, to: str | T.DataType | None = None) -> Series:
        """A series of the body's values on all complete windows, in order; its key ``j`` numbers them."""
        self._lanes()
        return Series(sliding(self.indexed, self.kind, width, stride, body, _kind(to) if to is not None else None, self.by), ("j",), self.by, placed=True)

    def moving_average(self, width: int) -> Series:
        """The mean of each element and the ``width - 1`` that follow, as double or lanes of double."""
        return self.sliding(width, 1, lambda w: w.mean(), double_of(self.kind))

    def chunk_average(self, width: int) -> Series:
        return self.sliding(width, width, lambda w: w.mean(), double_of(self.kind))

    # -- lifecycle and output
    def cache(self) -> Series:
        """Keeps the elements once they are first used; gives this series back."""
        self.df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def uncache(self) -> Series:
        self.df.unpersist(blocking=True)
        return self

    def observed(self, name: str) -> tuple[Series, Observation]:
        """This series, and what an action on it will have counted on its way: ``elements``. It takes no pass of its own."""
        seen = Observation(name)
        return Series(self.df.observe(seen, F.count("*").alias("elements")), self.keys, self.by), seen

    def repartition(self, n: int) -> Series:
        """``n`` partitions by range of the keys."""
        return Series(self.df.repartitionByRange(n, *self.keys), self.keys, self.by)

    def coalesce(self, n: int) -> Series:
        return Series(self.df.coalesce(n), self.keys, self.by)

    def write(self, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
        """The keys and elements as files."""
        self.df.write.mode(mode).format(kind).save(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, kind: str = "parquet") -> Series:
        """What :meth:`write` wrote in a format that keeps types."""
        df = spark.read.format(kind).load(path)
        named = lambda c: tuple(sorted((n for n in df.columns if n[0] == c and n[1:].isdigit()), key=lambda n: int(n[1:])))
        return cls(df, named("k") or ("j",), named("g"))

    def take(self, n: int) -> DataFrame:
        """The first ``n`` rows in order."""
        return self.df.orderBy(*self.by, *self.keys).limit(n)

    def sample(self, share: float, seed: int = 0) -> Series:
        """About ``share`` of the elements, drawn by a hash of their keys: the same ones however the rows are dealt."""
        if not 0 <= share <= 1:
            raise ValueError("a share is from 0 to 1")
        drawn = F.pmod(F.xxhash64(F.lit(seed), *self.by, *self.keys), F.lit(1 << 53)) < int(share * (1 << 53))
        return Series(self.df.where(drawn), self.keys, self.by)

    def count_approx_distinct(self, deviation: float = 0.05, name: str = "count") -> DataFrame:
        return self._agg(F.approx_count_distinct("x", deviation), name)

    def cartesian(self, other: Series) -> DataFrame:
        """All pairs ``x, y``. The result has as many rows as the lengths multiplied; nothing else in the engine uses it."""
        return self.df.select("x").crossJoin(other.df.select(F.col("x").alias("y")))

    def _two(self) -> Series:
        if lanes(self.kind) != 2:
            raise TypeError("pairs are elements of two lanes: key and value")
        return self

    def _paired(self, key: str) -> DataFrame:
        return self._two().df.select(F.col("x._1").alias("key"), F.col("x._2").alias(key))

    def join(self, other: Series, how: str = "inner") -> DataFrame:
        """``key, x, y`` of two series of pairs by their first lane, ``how`` as in a DataFrame's join."""
        if how.lower().replace("_", "") not in ("full", "outer", "fullouter"):
            return self._paired("x").join(other._paired("y"), "key", how)
        a, b = self._paired("x"), other._paired("y")
        pairs = self._matched(other)
        only_a, only_b = (s.join(t.select("key").distinct(), "key", "left_anti") for s, t in ((a, b), (b, a)))
        none = lambda c: F.lit(None).cast(pairs.schema[c].dataType).alias(c)
        return pairs.unionAll(only_a.select("key", "x", none("y"))).unionAll(only_b.select("key", none("x"), "y"))

    def _matched(self, other: Series) -> DataFrame:
        """``key, x, y`` of the keys in both series. Spark's full join makes all pairs of a key before it gives one away.

        A key's values are dealt into pieces of about ``PIECE`` by a hash of their place, and each piece of one series meets each of the other, so that no task has a whole key.
        """
        a, b = (s.df.select(F.col("x._1").alias("key"), F.col("x._2").alias(c), F.xxhash64(*s.by, *s.keys).alias("h")) for s, c in ((self._two(), "x"), (other._two(), "y")))
        n = a.select("key", F.lit(1).alias("p"), F.lit(0).alias("q")).unionAll(b.select("key", F.lit(0).alias("p"), F.lit(1).alias("q"))).groupBy("key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        # at most a key for each PIECE of rows
        large = F.broadcast(n.where((F.least("p", "q") > 0) & (F.greatest("p", "q") > PIECE)).select("key", *(F.ceil(F.col(c) / PIECE).alias(f"n{c}") for c in "pq")))

        def dealt(df: DataFrame, own: str, others: str) -> DataFrame:
            n = lambda c: F.coalesce(F.col(f"n{c}"), F.lit(1).cast("long"))
            every = F.explode(F.sequence(F.lit(0).cast("long"), n(others) - 1))
            return df.join(large, "key", "left").select(*df.columns[:2], F.pmod("h", n(own)).alias(own), every.alias(others))

        # a broadcast would leave all pairs to the few tasks that read the first series
        return dealt(a, "p", "q").join(dealt(b, "q", "p").hint("merge"), ["key", "p", "q"]).select("key", "x", "y")

    def cogroup(self, other: Series) -> DataFrame:
        """``key, xs, ys``: the sorted values of each key in either series of pairs; a key's values are held together."""
        a, b = (s._paired("v").groupBy("key").agg(F.sort_array(F.collect_list("v")).alias(n)) for s, n in ((self, "xs"), (other, "ys")))
        none = lambda c: F.coalesce(F.col(c), F.array().cast(a.schema["xs"].dataType if c == "xs" else b.schema["ys"].dataType)).alias(c)
        return a.join(b, "key", "full").select("key", none("xs"), none("ys"))

    def reduce_by_key(self, name: str = "sum") -> DataFrame:
        """``key, sum``: the values of each key of a series of pairs, added up in their type."""
        return self._paired("v").groupBy("key").agg(typed_sum(F.col("v"), lane_type(self.kind)).alias(name))

    def collect(self) -> list:
        return [r.x for r in self.df.orderBy(*self.by, *self.keys).select("x").collect()]

    def iterate(self):
        """Elements in order, a partition at a time."""
        return (r.x for r in self.df.orderBy(*self.by, *self.keys).select("x").toLocalIterator())

    def top(self, n: int) -> DataFrame:
        return self.df.orderBy(F.desc("x"), *self.keys).limit(n)

    def distinct(self) -> DataFrame:
        return self.df.select("x").distinct()

    def union(self, other: Series) -> DataFrame:
        return self.df.select("x").unionAll(other.df.select("x"))

    def intersect(self, other: Series) -> DataFrame:
        return self.df.select("x").intersect(other.df.select("x"))

    def subtract(self, other: Series) -> DataFrame:
        return self.df.select("x").exceptAll(other.df.select("x"))

    def zip(self, other: Series, strict: bool = True) -> DataFrame:
        """Elements of equal position: ``by..., idx, x, y``. Reading it fails if one series is longer, unless not ``strict``, when the rest of that one is left out.

        Series by keys are zipped key by key, and both must have the same ones.
        """
        if self.by != other.by:
            raise ValueError("zip takes two series split by as many columns")
        names = [*self.by, "idx"]
        a, b = self.indexed, other.indexed.withColumnRenamed("x", "y").withColumnsRenamed({c: f"__{c}" for c in names})
        same = reduce(lambda p, q: p & q, [a[c].eqNullSafe(b[f"__{c}"]) for c in names])
        if not strict:
            return a.join(b, same).select(*names, "x", "y")
        both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), same, "full")
        uneven = F.raise_error(F.lit("zip: the series differ in length")).cast("boolean")
        return both.where(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), True).otherwise(uneven)).select(*names, "x", "y")

    def histogram(self, low: float, high: float, buckets: int) -> DataFrame:
        """Counts by bucket of one width in [low, high], the last one closed; ``bucket, n``."""
        at = F.least(F.floor((F.col("x") - low) / ((high - low) / buckets)), F.lit(buckets - 1))
        return self.df.where(F.col("x").between(low, high)).groupBy(at.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
