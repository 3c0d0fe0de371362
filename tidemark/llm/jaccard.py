"""N-gram Jaccard join with adaptive multi-match prefixes (after Wang, Li and Feng, SIGMOD 2012).

The set of a document is its distinct word 5-grams as 64-bit hashes. All sets are put in one global order, rare
n-grams first. If two sets of sizes a and b are similar, the first ``n - ceil(0.8 n) + l`` elements of each share at
least l. Each document picks its own l: a longer prefix costs more index rows, but a pair has to share
``min(l, l')`` of them before it is verified. Documents with equal sets are one class, so copies are never paired.

Order and costs come from a sketch of fixed size that counts the n-grams of all documents; it can only change how much
work there is. Classes meet in stars first: in each n-gram's bucket all others are tried against one hub, which joins
a large group in as many pairs as it has members. Pairs that are in one component need no further look; the rest are
enumerated in full, so no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components, release, slices, text_bytes, text_lengths

SLICE = 1 << 18
#: The ranks that the counts of n-grams are told apart by, on a scale of powers of two.
RANKS = 1 << 20
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get((base, 0), np.ones(0, np.uint64))
    if len(have) < n:
        have = np.full(max(n, SLICE + 4096), base, np.uint64)
        have[0] = 1
        have = _POWERS[base, 0] = np.multiply.accumulate(have)
    return have[:n]


def _long_text(raw: np.ndarray) -> np.ndarray:
    """The hashes of the words of one text, a block of it at a time; a block ends before a space, or else in a word."""
    out, at = [], 0
    while at < len(raw):
        block = raw[at : at + SLICE]
        if at + len(block) < len(raw):
            space = np.flatnonzero(_SPACE[block])
            if len(space):
                block = block[: space[-1] + 1]
            else:  # a word longer than a block
                value, n, power = 0, 0, 1
                while at < len(raw) and not _SPACE[raw[at]]:
                    piece = raw[at : at + SLICE]
                    space = np.flatnonzero(_SPACE[piece])
                    piece = _LOWER[piece[: space[0]] if len(space) else piece]
                    value += power * int((_BYTE[piece] * _powers(_BASE, len(piece))).sum(dtype=np.uint64))
                    power = power * pow(_BASE, len(piece), 1 << 64) % (1 << 64)
                    n, at = n + len(piece), at + len(piece)
                out.append(mix(np.array([value % (1 << 64)], np.uint64) ^ np.array([n], np.uint64) << np.uint64(40)))
                continue
        out.append(word_hashes(block, np.array([0, len(block)]))[0])
        at += len(block)
    return np.concatenate(out)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and the number of words before each text.

    A-Z are lower-cased and words are what stands between the bytes 9 to 13 and 32.
    """
    if len(off) == 2 and len(raw) > SLICE:
        words = _long_text(raw)
        return words, np.array([0, len(words)])
    raw = _LOWER[raw]
    space = _SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    edges = off[:-1][np.diff(off) > 0]
    starts[edges] = ~space[edges]
    start = np.flatnonzero(starts)
    ends = np.zeros(len(raw), bool)
    ends[:-1] = ~space[:-1] & (space[1:] | starts[1:])
    if len(raw):
        ends[-1] = not space[-1]
    stop = np.flatnonzero(ends) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=total[1:])
    words = (total[stop] - total[start]) * _powers(_INVERSE, len(raw) + 1)[start]
    return mix(words ^ ((stop - start).astype(np.uint64) << np.uint64(40))), np.searchsorted(start, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word hashes of each text, end to end, and their n+1 offsets. Fewer words: all of them as one."""
    words, before = word_hashes(raw, off)
    n = np.diff(before)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(before[:-1], per)
    short = np.minimum(n, k)[doc] if (n < k).any() else None
    out = np.zeros(len(doc), np.uint64)
    for i in range(k):
        if short is None:
            out += words[at + i] * _FACTOR[i]
        else:
            here = short > i
            out[here] += words[at[here] + i] * _FACTOR[i]
    out = mix(out)
    ends = np.cumsum(per)
    for x, y in zip(ends - per, ends, strict=True):
        out[x:y].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])


def _ids(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set; 0 for an empty one."""
    n = np.diff(off).astype(np.uint64)
    total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[off])
    a, b = (mix(total(mix(sets ^ np.uint64(s))) + n * np.uint64(s)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return np.where(n == 0, 0, a).astype(np.int64), np.where(n == 0, 0, b).astype(np.int64)


def parities(sets: np.ndarray, off: np.ndarray) -> pa.Array:
    """A bit map of each set, of at least a bit for each element up to 2**20: which places an odd number of them fall on.

    Two maps differ in no more places than their sets differ in elements. A longer map folds onto a shorter one.
    """
    n = np.diff(off)
    bits = np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 6, 20))
    start = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(start[:-1], n) + (sets & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(odd)])


def differing(x: bytes, y: bytes) -> int:
    """Places in which two maps differ."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(first columns, sets, offsets) for each slice of the batches; the text is the last column."""
    for b in batches:
        text = b.column(b.num_columns - 1)
        for i, j in slices(text_lengths(text), SLICE):
            raw, off = text_bytes(text.slice(i, j - i))
            yield [b.column(c).slice(i, j - i) for c in range(b.num_columns - 1)], *shingle_sets(raw, off, k)


class Sketch:
    """Counters of n-grams by some of their bits: never too low, too high by about the mean load.

    A count is told by its rank, on a scale of powers of two that no count of 32 bits goes beyond.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, self.bits = counts, int(len(counts)).bit_length() - 1
        mean = float(counts.mean())
        self.noise = mean + 4 * mean**0.5

    def ranks(self, sets: np.ndarray) -> np.ndarray:
        return (np.log2(self.counts[sets >> np.uint64(64 - self.bits)].astype(np.float64) + 1) * (RANKS // 32 - 1)).astype(np.uint64)

    @staticmethod
    def count(ranks: np.ndarray) -> np.ndarray:
        return np.exp2(ranks.astype(np.float64) / (RANKS // 32 - 1)) - 1


def prefixes(sets: np.ndarray, off: np.ndarray, sketch: Sketch, percent: int, most_l: int) -> tuple[np.ndarray, ...]:
    """Key, document, place and l of the prefix of each set in the global order, and the count of each key.

    A key is 21 bits of the count's rank and 43 of the hash. Two n-grams of one key count as one n-gram that a document may
    have twice; that can add candidates and loses none.

    For each l the cost is the index rows that the prefix would meet plus twice the candidates that could share l of
    its elements, both from the sketch; the cheapest l is taken.
    """
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    key = sketch.ranks(sets) << np.uint64(43) | sets & np.uint64((1 << 43) - 1)
    for x, y in zip(off[:-1], off[1:], strict=True):
        key[x:y].sort()
    others = np.maximum(sketch.count(key >> np.uint64(43)) - sketch.noise, 0.0)
    total = np.concatenate([[0.0], np.cumsum(others)])
    need = -(-n * percent // 100)
    best, cost = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for x in range(1, most_l + 1):
        length = n - need + x
        met = total[np.minimum(off[:-1] + length, off[1:])] - total[off[:-1]]
        now = np.where((need >= x) | (x == 1), length + met + 2 * met / x, np.inf)
        best, cost = np.where(now < cost, x, best), np.minimum(now, cost)
    length = np.minimum(n - need + best, n)
    place = np.arange(len(key)) - np.repeat(off[:-1], n)
    keep = np.flatnonzero(place < length[doc])
    return key[keep], doc[keep], place[keep], best[doc[keep]], others[keep]


def _named_and_counted(docs: DataFrame, bits: int, k: int, scratch: Scratch) -> tuple[DataFrame, Sketch]:
    """The names, sizes and maps of all sets, with the row's ``key``, and counts of all n-grams of every document, from one scan.

    Each task sends its counters in 64 packed pieces, which meet 64 at a time.
    """
    piece = 1 << (bits - 6)
    names = ["id", "key", "th", "n", "cls", "cls2", "map", "part", "i", "counts"]
    kinds = [pa.int64(), pa.binary()] + [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def packed(counts: np.ndarray) -> bytes:
        return zlib.compress(counts.astype(np.uint32).tobytes(), 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << bits, np.uint32)
        for (ids, keys, th), sets, off in _sets(batches, k):
            at, n = np.unique(sets >> np.uint64(64 - bits), return_counts=True)
            total[at] += n.astype(np.uint32)
            cols = [ids, keys, th, np.diff(off), *_ids(sets, off), parities(sets, off)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=False)] + [pa.nulls(len(ids), t) for t in kinds[7:]], names=names)
        rows = [(TaskContext.get().partitionId(), i, packed(t)) for i in range(64) if (t := total[i * piece : (i + 1) * piece]).any()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for t in kinds[:7]] + [pa.array([r[c] for r in rows], kinds[c + 7]) for c in range(3)], names=names)
        del total
        release()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"part": [table.column("part")[0].as_py()], "i": table.column("i").slice(0, 1), "counts": [packed(np.minimum(total, 2**32 - 1))]})

    both = scratch.put(docs.mapInArrow(scan, "id long, key binary, th long, n long, cls long, cls2 long, map binary, part long, i int, counts binary"))
    parts, left = both.where("counts is not null").select("part", "i", "counts"), docs.rdd.getNumPartitions()
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / 64)).groupBy("part", "i").applyInArrow(add, "part long, i int, counts binary")
        left = -(-left // 64)
        if left <= 1:
            break
    total = np.zeros(1 << bits, np.uint32)
    for r in parts.collect():  # 64 rows, 2**bits counters in all
        total[r.i * piece : (r.i + 1) * piece] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
    return both.where("counts is null").select("id", "key", "th", "n", "cls", "cls2", "map"), Sketch(total)


def _filter(values: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A filter for the ``n`` rows of ``values(x)``, of 16 bits a row up to 2**28 (32 MB) in all; it lets some others through."""
    bits = min(28, max(16, (16 * n).bit_length()))
    place = F.pmod("x", F.lit(1 << bits)) + 1
    maps = values.groupBy(F.bitmap_bucket_number(place).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()  # maps of 4 KB
    marked = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for r in maps:
        marked[(r.i - 1) << 12 : r.i << 12] = np.frombuffer(bytes(r.m), np.uint8)
    shared = values.sparkSession.sparkContext.broadcast(zlib.compress(marked.tobytes(), 1))
    held: list[np.ndarray] = []

    def wanted(x: np.ndarray) -> np.ndarray:
        if not held:
            held.append(np.frombuffer(zlib.decompress(shared.value), np.uint8))
        at = x & ((1 << bits) - 1)
        return (held[0][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return wanted


def _sets_of(texts: DataFrame, n: int, docs: DataFrame, k: int) -> DataFrame:
    """The sets of the texts whose hashes are the ``n`` rows of ``texts(x)``, and of some others, made anew by a scan, ``cls, s``.

    A class comes once for each task that has such a text of it, and of those one is taken.
    """
    wanted = _filter(texts, n)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        few = (x for b in batches if (x := b.filter(pa.array(wanted(b.column(0).to_numpy(zero_copy_only=False))))).num_rows)
        for _, sets, off in _sets(few, k):
            a, _ = _ids(sets, off)
            rows = np.flatnonzero(np.diff(off) > 0)
            rows = rows[np.array([not (x in seen or seen.add(x)) for x in a[rows].tolist()], bool)]
            if len(rows):
                n = np.diff(off)[rows]
                take = np.repeat(off[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(sets[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(a[rows]), lists], names=["cls", "s"])
        release()

    return docs.select("th", "text").mapInArrow(make, "cls long, s array<long>").dropDuplicates(["cls"])


def _near(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b, la, lb)`` whose maps don't differ in more places than similar sets may in elements, with the hashes of a text of each, ``ta, tb``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb, ma, mb = (x.column(c) for c in ("na", "nb", "mapa", "mapb"))
            most = (na.to_numpy() + nb.to_numpy()) * (100 - percent)
            ok = [differing(p.as_py(), q.as_py()) * (100 + percent) <= m for p, q, m in zip(ma, mb, most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(i) for i in range(6)], names=["a", "b", "la", "lb", "tha", "thb"]).filter(pa.array(ok, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(held.select(F.col("cls").alias(side), *(F.col(c).alias(c + side) for c in ("n", "map", "th"))), side)
    return pairs.select("a", "b", "la", "lb", "tha", "thb", "na", "nb", "mapa", "mapb").mapInArrow(compare, "a long, b long, la long, lb long, tha long, thb long")


def _verified(pairs: DataFrame, n: int, docs: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """Those of the ``n`` rows ``pairs(a, b, la, lb, tha, thb)`` whose sets are similar.

    Of the two the one with more partners is the middle: its set goes once to each 64 or so of them, which pass by it one
    at a time. So the set of a class with many partners isn't sent to each.
    """
    names = ["a", "b", "la", "lb"]
    if not n:
        return pairs.select(*names)
    partners = scratch.put(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).groupBy("cls").count())
    dealt = pairs.select(*names)
    for side in "ab":
        dealt = dealt.join(partners.select(F.col("cls").alias(side), F.col("count").alias(f"n{side}")), side)
    turn = F.col("na") > F.col("nb")
    dealt = dealt.select(*(F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("la", "lb"), ("lb", "la"))), F.greatest("na", "nb").alias("most"))
    dealt = dealt.select(*names, F.pmod(F.xxhash64("a"), F.ceil(F.col("most") / 64)).alias("part"))
    none = F.lit(None).cast("long")
    sent = dealt.select(F.col("a").alias("cls"), *names, "part").union(dealt.select(F.col("b").alias("cls"), none, "b", none, none, "part").distinct())
    sets = _sets_of(pairs.select(F.col("tha").alias("x")).union(pairs.select("thb")), 2 * n, docs, k).join(sent, "cls")
    so_far = Window.partitionBy("b", "part").orderBy(F.col("a").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = sets.select(*names, "part", "s").withColumn("sb", F.first("s").over(so_far)).where("a is not null")
    both = both.select(*names, (F.size("s") + F.size("sb")).alias("n"), F.size(F.array_intersect("s", "sb")).alias("i"))
    return scratch.put(both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select(*names))


def _meet(percent: int) -> Column:
    """Whether rows of sets of sizes n, m at places and with l of ``pa``, ``pb`` count for their pair.

    To be similar the sets must share t elements, so they share l of the first n - t + l and m - t + l. In their whole
    prefixes they share at most the ``ca`` and ``cb`` elements that each shares with any other class.
    """
    t = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    least = F.least(F.col("pa") % 16, F.col("pb") % 16)
    i, j = F.floor(F.col("pa") / 16), F.floor(F.col("pb") / 16)
    most = F.least(i, j) + F.least(F.col("n") - i, F.col("m") - j)  # shared before these places, and from them on
    rest = lambda n, at: F.ceil(F.col(n) * percent / 100) - F.col(at) % 16
    shared = F.least("ca", "cb") + F.greatest(rest("n", "pa"), rest("m", "pb"))
    return (i < F.col("n") - t + least) & (j < F.col("m") - t + least) & (most >= t) & (shared >= t)


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs ``a, b, la, lb`` of rows ``met(a, b, label, lb, pa, pb)`` that share as many elements as the shorter l asks for."""
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(F.least(F.col("pa") % 16, F.col("pb") % 16)).alias("l"), F.first("label").alias("la"), F.first("lb").alias("lb"))
    return pairs.where("c >= l").select("a", "b", "la", "lb")


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """The ``pairs`` that aren't among ``tried``, in either order."""
    if tried is None:
        return pairs
    ends = lambda df: df.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    return ends(pairs).join(ends(tried).select("x", "y"), ["x", "y"], "left_anti").drop("x", "y")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5, most_l: int = 6, sketch_bits: int | None = None) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``k``-word hashes; components
    are the classes that links connect, named by their least identifier. A document with fewer than ``k`` words has
    all its words as one element; a null text, an empty one and one of white space alone have the empty set and link
    with nothing, so each is its own component. Copies and repeated rows link with each other. A row with a null
    identifier takes part, but gives its component no name unless it stands alone, when ``component_id`` is null. Texts
    and words of any length are read whole, in blocks. An empty table gives an empty result; other columns are not read.
    Words are compared by 64-bit hashes.
    """
    return jaccard_rows(docs, None, id_col, text_col, percent, k, most_l, sketch_bits).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, key: Column | None = None, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5, most_l: int = 6, sketch_bits: int | None = None) -> DataFrame:
    """As :func:`jaccard_components`, with ``key``, a binary that goes with the row, and ``label``.

    Identifiers may repeat or be null, so that components can share a ``component_id``; ``label`` tells components apart
    and is null for an empty set, which links with nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), (F.lit(None) if key is None else key).cast("binary").alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))
    if sketch_bits is None:  # a counter for each 256 bytes of the table by Spark's estimate, from 2**21 (8 MB) to 2**24 (64 MB)
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        sketch_bits = min(24, max(21, (size >> 8).bit_length()))
    named, sketch = _named_and_counted(docs, sketch_bits, k, scratch)
    shared = spark.sparkContext.broadcast(zlib.compress(sketch.counts.tobytes(), 1))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Sketch(np.frombuffer(zlib.decompress(shared.value), np.uint32))
        seen: set[int] = set()
        for _, sets, off in _sets(batches, k):
            a, _ = _ids(sets, off)
            if len(seen) > 200_000:  # what comes again becomes one row with the first further down
                seen.clear()
            new = np.array([not (x in seen or seen.add(x)) for x in a.tolist()], bool)
            n = np.diff(off)
            sets, a, off = sets[np.repeat(new, n)], a[new], np.concatenate([[0], np.cumsum(n[new])])
            gram, doc, place, best, others = prefixes(sets, off, order, percent, most_l)
            n = np.diff(off)[doc]
            parts = (others / 500).astype(np.int64)
            part = np.where(parts > 0, 1 + (mix(a[doc].view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(a[doc]), pa.array(n.astype(np.int32)), pa.array((place * 16 + best).astype(np.int32))], names=["gram", "part", "cls", "n", "at"])
        del order
        release()

    rows = docs.select("text").mapInArrow(index, "gram long, part int, cls long, n int, at int")
    # N-grams of one class alone pair nothing. Those that the sketch calls frequent are dealt by class into parts and all
    # stay; as it never counts too low, no window below holds more classes than some hundreds and the sketch's noise, and
    # of each class no more than a row from each task. Copies from several tasks meet in one part and become one row there.
    here = Window.partitionBy("gram", "part")
    # A row at its place needs a partner small enough; the smallest set in the bucket says whether there can be one.
    place, l = F.floor(F.col("at") / 16), F.col("at") % 16
    m = F.greatest(F.min("n").over(here), F.ceil(F.col("n") * percent / 100))
    t = F.ceil((F.col("n") + m) * percent / (100 + percent))
    rows = rows.withColumn("x", F.min("cls").over(here)).withColumn("y", F.max("cls").over(here)).withColumn("live", place < F.col("n") - t + l).where("part > 0 or x <> y")
    alive = F.when(F.col("live"), F.col("cls"))
    rows = rows.withColumn("x", F.min(alive).over(here)).withColumn("y", F.max(alive).over(here))
    one = rows.groupBy("gram", "part", "cls", "n", "at").agg(F.first((F.col("part") > 0) | (F.col("live") & (F.col("x") < F.col("y")))).alias("live"))
    # The index is kept by class, a prefix to a row: all that follows reads it from there.
    held = one.groupBy("cls").agg(F.collect_list(F.struct("gram", (F.col("at") * 2 + F.col("live").cast("int")).alias("at"))).alias("rows"), F.first("n").alias("n"))
    # The more of a class's prefix other classes share, the nearer it is to the middle of its group.
    cnt = F.size("rows").cast("long")
    about = named.where("n > 0").groupBy("cls").agg(F.first("map").alias("map"), F.min("th").alias("th"))
    held = scratch.put(held.select("cls", "n", "rows", cnt.alias("cnt"), (cnt * 1000 / F.col("n")).cast("long").alias("score")).join(about, "cls"))
    label = held.select(F.col("cls").alias("node"), F.col("cls").alias("label"), "score", "cnt")
    fits = _meet(percent)
    tried: DataFrame | None = None

    def look(met: DataFrame) -> tuple[int, int]:
        """Verifies the pairs of ``met`` not tried yet and joins the components that they link; how many there were, and how many linked."""
        nonlocal label, tried
        pairs = scratch.put(_near(_untried(_candidates(met), tried), held, percent))
        n = pairs.count()
        found = _verified(pairs, n, docs, percent, k, scratch)
        tried = pairs if tried is None else tried.union(pairs)
        if links := found.count() if n else 0:
            new = scratch.put(components(found.select(F.col("la").alias("u"), F.col("lb").alias("v")), scratch))
            before, label = label, scratch.put(label.join(new.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"), "score", "cnt"))
            scratch.drop(before, new, found)
        return n, links

    def open_rows(rows: DataFrame) -> DataFrame:
        """Those of ``rows`` of the index whose n-grams still meet another component in a set of a size that can be similar.

        Components only grow, so other rows never do again. A row at its place needs a partner small enough, and none
        is smaller than the smallest of the n-gram.
        """
        at = rows.select("gram", "cls", "n", "at").join(label.withColumnRenamed("node", "cls"), "cls")
        mixed = at.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("least"), F.max("n").alias("most")).where("x <> y")
        most = (F.col("n") + F.col("at") % 16 - 1 - F.floor(F.col("at") / 16)) * (100 + percent) / percent - F.col("n")
        fit = (F.col("least") <= most) & (F.col("most") * 100 >= F.col("n") * percent)
        mixed = scratch.put(mixed.select("gram", "least", "most"))
        out = scratch.put(at.join(mixed, "gram").where(fit).drop("least", "most"))
        scratch.drop(mixed)
        return out

    live = held.select("cls", "n", F.col("cls").alias("label"), "score", "cnt", F.inline("rows")).where("at % 2 = 1")
    live, left = live.withColumn("at", F.shiftright("at", 1)), None
    for turn in range(4):
        # The hub: the most central class of the n-gram; in later turns the most central one of a component drawn by hash.
        central = [F.col("score"), F.col("cls")] if not turn else [F.xxhash64("label", F.lit(turn)), F.col("score"), F.col("cls")]
        best = F.max(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(central)), F.col("cls").alias("b"), F.col("label").alias("lb"), F.col("n").alias("m"), F.col("cnt").alias("cb"), F.col("at").alias("pb"))).alias("h")
        # Written, as is what an n-gram meets above, so that Spark can split a frequent n-gram in the join.
        hub = scratch.put(live.groupBy("gram").agg(best).select("gram", *(f"h.{c}" for c in ("b", "lb", "m", "cb", "pb"))))
        _, links = look(live.withColumnsRenamed({"at": "pa", "cls": "a", "cnt": "ca"}).join(hub, "gram").where((F.col("label") != F.col("lb")) & fits))
        scratch.drop(hub)
        if links:
            before, live = live, open_rows(live)
            scratch.drop(before)
        # Pairs across components that share an n-gram: few enough to look at each?
        sizes = live.groupBy("gram", "label").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        total = sizes.agg(F.sum("c").alias("c"), F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs")).first()
        if (total.pairs or 0) <= 8 * (total.c or 0) or left is not None and total.pairs > 0.9 * left:  # or stars join little more
            break
        left = total.pairs
    # All pairs that are left, by the full multi-match rule.
    x = live.select("gram", F.col("cls").alias("a"), "n", "label", F.col("at").alias("pa"), F.col("cnt").alias("ca"))
    y = live.select("gram", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("label").alias("lb"), F.col("at").alias("pb"), F.col("cnt").alias("cb"))
    look(x.join(y, "gram").where((F.col("a") < F.col("b")) & (F.col("label") != F.col("lb")) & fits))

    # Names: the least identifier of each class, then of each component.
    cls = named.where("n > 0").groupBy("cls", "cls2").agg(F.min("id").alias("id"))
    cls = cls.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    cls = scratch.put(cls)
    scratch.drop(live, held)  # held is where the labels are while nothing has linked
    least = cls.groupBy("label").agg(F.min("id").alias("least"))
    cls = cls.join(least, "label").select("cls", "cls2", "label", "least")
    out = named.join(cls, ["cls", "cls2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "key", "label")
