"""Summaries over windows of event time for streams; an extension beside the positional windows, which need the whole order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import stats as S


def windowed_stats(events: DataFrame, time: str, value: str, length: str, late: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``start, end, by..., stats`` for each window of ``length``; rows later than ``late`` are left out. For streams and tables.

    ``order``, for tables only, are columns that order a window's rows uniquely. They are then added up one by one in that order, in one task
    for each window, so that not even the last digit depends on how rows are dealt.
    """
    if not order:
        rows = events.withWatermark(time, late) if events.isStreaming else events
        out = rows.groupBy(F.window(time, length), *by).agg(S.stats(F.col(value)).alias("stats"))
        return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "stats")
    if events.isStreaming:
        raise ValueError("a stream has no order")
    at = F.window(time, length)
    rows = events.select(at.alias("__w"), *by, F.col(value).cast("double").alias("__x"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
    place = F.row_number().over(Window.partitionBy("__w", *by).orderBy(*(f"__o{i}" for i in range(len(order)))))
    rows = rows.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *by, (place == 1).alias("__first"), "__x")
    return rows.mapInArrow(_in_order, T.StructType([*rows.schema.fields[:-2], T.StructField("stats", S.KIND)]))


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of windows whose rows come one after the other, each window's first one marked in the last but one column."""
    kind = pa.struct([("n", pa.int64()), *((c, pa.float64()) for c in ("mu", "m2", "max", "min"))])
    heads: list[pa.RecordBatch] = []
    sums: list[_Sums] = []

    def made(n: int) -> Iterator[pa.RecordBatch]:
        if n:
            keys = pa.Table.from_batches(heads[:n]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array([s.row() for s in sums[:n]], kind)], names=[*keys.schema.names, "stats"])
            del heads[:n], sums[:n]

    for b in batches:
        first, xs = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        keys = b.select(b.schema.names[:-2])
        for low, high in pairwise([0, *(i for i in range(1, len(xs)) if first[i]), len(xs)] if xs else []):
            if first[low]:
                heads.append(keys.slice(low, 1))
                sums.append(_Sums())
            sums[-1].add(xs[low:high])
        yield from made(len(sums) - 1)
    yield from made(len(sums))


class _Sums:
    def __init__(self):
        self.n, self.sum, self.mean, self.m2, self.max, self.min = 0, 0.0, 0.0, 0.0, None, None

    def add(self, xs: list[float | None]) -> None:
        """Welford's updates of mean and squared differences; NaN is the greatest number, as in Spark."""
        n, total, mean, m2, most, least = self.n, self.sum, self.mean, self.m2, self.max, self.min
        for x in xs:
            if x is None:
                continue
            n += 1
            before = mean
            mean += (x - mean) / n
            m2 += (x - mean) * (x - before)
            total += x
            if most is None or x > most or x != x:
                most = x
            if least is None or x < least or least != least:
                least = x
        self.n, self.sum, self.mean, self.m2, self.max, self.min = n, total, mean, m2, most, least

    def row(self) -> tuple:
        if not self.n:
            return 0, 0.0, 0.0, -S.INF, S.INF
        return self.n, self.sum / self.n, (self.m2 / self.n if self.n > 1 else 0.0 if self.m2 == self.m2 else S.NAN) * self.n, self.max, self.min
