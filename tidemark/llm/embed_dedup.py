"""Embedding near-dedup: Euclidean p-stable hashing in several tables, then exact cosine checks.

A unit vector is projected on random Gaussian directions, shifted and cut into cells of width ``WIDTH`` (Datar et al.,
2004); the cells of ``k`` directions make its bucket in a table. At cosine 0.9 two vectors are 0.447 apart and share a
cell with probability 0.80, unrelated ones with 0.45, so k grows with the logarithm of the rows, which leaves about
``MATES`` unrelated vectors in a bucket, and the number of tables is what gives pairs of just the threshold ``recall``;
closer pairs are found with a higher probability.

Equal vectors are one class, so copies are never paired. What goes to the buckets first are the signs of ``SIGNS`` other
projections: a member that has no other within the angle, by a margin that no pair of the threshold falls out of but one
in 10**9, is done with. Only the others' vectors follow. A bucket with many members is dealt into blocks that meet two
by two. A pair counts in the first table where it meets only, so links are summed where they are found and pairs never
leave the task; all that leaves are sums and the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, components, release

WIDTH, BLOCK, MATES, SIGNS = 1.8, 1024, 64, 256


def _same_cell(distance: float) -> float:
    """The chance that two points so far apart share a cell."""
    x = WIDTH / distance
    return math.erf(x / 2**0.5) - 2 / ((2 * math.pi) ** 0.5 * x) * (1 - math.exp(-(x**2) / 2))


def plan(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """k and the number of tables."""
    k = max(4, math.ceil(math.log(max(rows, 1) / MATES) / -math.log(_same_cell(2**0.5))))
    p = _same_cell((2 - 2 * cosine) ** 0.5) ** k if cosine < 1 else 1.0
    return k, math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1


def most_signs(cosine: float) -> int:
    """In how many signs two vectors of this cosine differ, with six deviations to spare."""
    share = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SIGNS * share + 6 * math.sqrt(SIGNS * share * (1 - share)))


def _unit(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of ``key`` as tables of whole buckets."""
    left: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        left.append(b)
        key = b.column("key").to_numpy()
        if len(left) > 1 and key[-1] == left[0].column("key")[0].as_py():
            continue  # one bucket so far
        both = pa.Table.from_batches(left)
        key = both.column("key").to_numpy()
        keep = int(np.flatnonzero(np.append([True], key[1:] != key[:-1]))[-1])
        if keep:
            yield both.slice(0, keep)
            left = both.slice(keep).to_batches()
    if left:
        yield pa.Table.from_batches(left)


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.append(starts[1:], len(key))


def _meeting(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order of bucket, of ``BLOCK`` at most, those that differ from another of their bucket in ``most`` signs or fewer."""
    for t in _by_bucket(batches):
        key = t.column("key").to_numpy()
        signs = np.frombuffer(b"".join(t.column("signs").to_pylist()), np.uint64).reshape(len(key), -1)
        some = np.zeros(len(key), bool)
        for s, e in zip(*_starts(key), strict=True):
            for i in range(s, e - 1, 128):
                x = signs[i : min(i + 128, e), None]
                near = np.bitwise_count(x ^ signs[None, i:e]).sum(2, dtype=np.int32) <= most
                near[np.arange(len(near)), np.arange(len(near))] = False
                some[i:e] |= near.any(0)
                some[i : i + len(near)] |= near.any(1)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(t.column("cls").to_numpy()[some])], names=["key", "cls"])
    release()


def _forest(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that links connect it with."""
    n = len(close)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(close, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch], cosine: float, tables: int, kind: str) -> Iterator[pa.RecordBatch]:
    """From rows in order of bucket and block pair to ``(a, b, n)``: n links more for a, or with n = 0 an edge."""
    wide = np.dtype(kind).itemsize

    def out(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b, n = (np.concatenate([r[i] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64) for i in range(3))
        sums, at = np.unique(a[n > 0], return_inverse=True)
        e = np.unique(np.stack([a[n == 0], b[n == 0]]), axis=1)
        total = np.bincount(at, n[n > 0], len(sums)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((sums, e[0]), (sums, e[1]), (total, np.zeros(e.shape[1], np.int64)))], names=["a", "b", "n"])

    def work(key: np.ndarray, side: np.ndarray, table: np.ndarray, cls: np.ndarray, copies: np.ndarray, prints: list, vectors: list):
        found = []
        prints = np.frombuffer(b"".join(prints), np.int32).reshape(-1, tables)
        dim = np.array([len(v) // wide for v in vectors])
        unit = np.zeros((len(key), dim.max()))
        for d in np.unique(dim):
            unit[dim == d, :d] = _unit([vectors[i] for i in np.flatnonzero(dim == d)], d, kind)

        def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """The rule for every pair, the same in either order."""
            return (np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine) & (dim[i] == dim[j])

        for s, e in zip(*_starts(key), strict=True):
            near = np.zeros((e - s, e - s), bool)
            for r in range(s, e, 256):
                stop = min(e, r + 256)
                product = unit[r:stop] @ unit[s:e].T
                sure = product >= cosine + 1e-9
                i, j = np.nonzero((product > cosine - 1e-9) & ~sure | sure & (dim[r:stop, None] != dim[None, s:e]))
                sure[i, j] = close(r + i, s + j)  # products round one way or another; these are told by the rule
                sure &= (side[r:stop, None] != side[None, s:e]) | (side[r:stop, None] == 2)
                sure[np.arange(stop - r), np.arange(r - s, stop - s)] = False
                near[r - s : stop - s] = sure
                i, j = np.nonzero(sure)
                first = (prints[r + i] == prints[s + j]).argmax(1) == table[s]
                weight = np.bincount(i[first], copies[s + j[first]], stop - r)
                some = weight > 0
                found.append((cls[r:stop][some], cls[r:stop][some], weight[some]))
            if near.any():
                label = _forest(near)
                found.append((cls[s:e], cls[s:e][label], np.zeros(e - s)))
        return found

    for t in _by_bucket(batches):
        yield out(work(*(t.column(c).to_numpy() for c in ("key", "side", "t", "cls", "copies")), t.column("prints").to_pylist(), t.column("v").to_pylist()))
    release()


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.93, seed: int = 7) -> DataFrame:
    """One row for each input row: ``vec_id, n_links, component_id, kept``.

    Vectors link whose cosine in double precision is ``cosine`` or more and whose lengths are equal, if some table
    finds them; ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the least
    identifier that links reach and ``kept`` says whether it is the row's own.

    A null, empty or zero vector, one with a null or non-finite component and one with a null identifier link with
    nothing: 0 links, their own component, kept. Repeated rows are copies of each other; an identifier may come with
    several vectors, each of which has its own links. Vectors of any length are compared whole. An empty table gives an
    empty result; other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embed_dedup")
    v = F.col("v")
    given = rows.schema[vector_col].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    fine = F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value, and adding 0.0 makes them so.
    flat = F.transform("v", lambda x: x + F.lit(0.0).cast(element))
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("ok"), flat)).withColumn("h", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(seed), "v")))
    classes = rows.where("ok").groupBy("h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = scratch.put(classes.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    k, tables = plan(n, cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random: dict[int, tuple[np.ndarray, ...]] = {}
        weights = np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
        for b in batches:
            vectors = b.column(2)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, begin = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths):
                if d not in random:
                    rng = np.random.default_rng([seed, int(d)])
                    random[d] = rng.standard_normal((int(d), k * tables)), rng.uniform(0, WIDTH, k * tables), rng.standard_normal((int(d), SIGNS))
                which = np.flatnonzero(lengths == d)
                for at in np.array_split(which, -(-len(which) // 1000)):
                    x = np.stack([flat[begin[i] : begin[i] + d] for i in at])
                    raw = [r.tobytes() for r in x]
                    x = x.astype(np.float64)
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    cells = np.floor((x @ random[d][0] + random[d][1]) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(at), tables, k)
                    mixed = (cells * weights).sum(2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(d) * 0xBF58476D1CE4E5B9 % 2**64)
                    prints = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    signs = np.packbits(x @ random[d][2] > 0, axis=1)
                    cols = [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(list(prints), pa.list_(pa.int32())), pa.array([g.tobytes() for g in signs], pa.binary()), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["cls", "copies", "prints", "p", "signs", "v"])
        release()

    prints = scratch.put(classes.select("cls", "copies", "v").mapInArrow(hashed, "cls long, copies long, prints binary, p array<int>, signs binary, v binary"))
    keys = prints.select("cls", "signs", F.posexplode("p").alias("t", "p")).select("cls", "signs", (F.shiftleft(F.col("t").cast("long"), 32) + F.pmod(F.col("p").cast("long"), F.lit(1 << 32))).alias("key"))
    # Buckets of one class have nothing to check; a large one is dealt into parts, and each two of them meet.
    sizes = scratch.put(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    few = keys.join(sizes.where(F.col("n") <= BLOCK).select("key"), "key").select("key", "cls", "signs")
    few = few.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _meeting(it, most_signs(cosine)), "key long, cls long")
    few = few.select("cls", F.shiftright("key", 32).cast("int").alias("t"), "key", F.lit(2).alias("side"))
    sized = keys.select("key", "cls").join(sizes.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("parts")), "key")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j"), F.when(o == F.col("part"), 2).when(o < F.col("part"), 1).otherwise(0).alias("side")))
    many = sized.select("cls", "key", F.explode(others).alias("o")).select("cls", F.shiftright("key", 32).cast("int").alias("t"), F.xxhash64("key", "o.i", "o.j").alias("key"), "o.side")
    met = few.union(many).join(prints.select("cls", "copies", "prints", "v"), "cls")
    met = met.repartition("key").sortWithinPartitions("key").select("key", "side", "t", "cls", "copies", "prints", "v")
    found = scratch.put(met.mapInArrow(lambda it: _links(it, cosine, tables, kind), "a long, b long, n long"))
    links = found.where("n > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    label = components(found.where("n = 0").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).withColumnRenamed("node", "cls")
    done = classes.select("h", "h2", "cls", "id", "copies").join(links, "cls", "left").join(label, "cls", "left")
    done = scratch.put(done.select("h", "h2", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "label"))
    least = done.where("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    done = done.join(least, "label", "left").select("h", "h2", "n_links", F.coalesce("least", "id").alias("component_id"))
    scratch.drop(prints, found, sizes)
    out = rows.select("id", "h", "h2").join(done, ["h", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
