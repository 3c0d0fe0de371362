"""Shared plumbing: written intermediate tables, Arrow batch slicing, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: tables between steps need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_OPEN: ContextVar[list[Scratch] | None] = ContextVar("open scratch", default=None)


class Scratch:
    """Written tables of one operator call.

    ``put`` writes a DataFrame as Parquet in the shared folder and reads it back, which cuts its lineage at a place
    that outlives any executor. ``drop`` deletes tables that nothing reads any more. A result reads the last of them
    when it is used; what is left then goes at the end of the ``with scratch_space():`` that the call was made in.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        if (space := _OPEN.get()) is not None:
            space.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]  # ids stay unique while the frames live
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and (path := self.paths.pop(id(df), None)):
                self._delete(path)

    def clear(self) -> None:
        """Deletes all tables of the call."""
        self.paths.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_space() -> Iterator[None]:
    """Deletes, at its end, the tables of all operators called in it; their results must have been written by then."""
    before = _OPEN.set([])
    try:
        yield
    finally:
        for s in _OPEN.get():
            s.clear()
        _OPEN.reset(before)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or one with more underscores that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give back the memory that a task no longer uses; Spark keeps its Python workers for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to about ``most``; a longer row stands alone."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each row, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Edges that one task contracts.
EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges connect: every node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars; what is held grows with its nodes, not with its edges."""
    u, v, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for b in batches:
        more.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        if sum(len(x[0]) for x in more) > max(EDGES, len(u)):
            u, v = forest(*(np.concatenate([y, *(x[i] for x in more)]) for i, y in enumerate((u, v))))
            more = []
    u, v = forest(*(np.concatenate([y, *(x[i] for x in more)]) for i, y in enumerate((u, v))))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(u, v)`` as ``(node, label)``, label the least node of each.

    Each task contracts its edges, ``EDGES`` or so, to stars. If the stars of different tasks meet, the large-star and
    small-star steps of Kiveris et al. (2014) and contraction alternate on written edge tables until all is stars. A
    step is an aggregate and a join; no neighbourhood is gathered in a task and nothing but counts reaches the driver.
    Nodes without an edge to another node don't appear.
    """

    def stars(e: DataFrame) -> DataFrame:
        n = scratch.put(e)
        few = n.coalesce(max(1, -(-n.count() // EDGES)))
        out = scratch.put(few.mapInArrow(contract, "u long, v long"))
        scratch.drop(n)
        return out

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        # Written, so that the join below has a plain exchange on either side, which Spark can split at a hub.
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        if large:
            out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = stars(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or above = 1 and below = 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        large = scratch.put(star(now, True))
        scratch.drop(now)
        now = stars(star(large, False))
        scratch.drop(large)
