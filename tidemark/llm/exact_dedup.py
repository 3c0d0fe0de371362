"""Exact dedup: a tree-merge of sorted digest runs.

Each input partition sorts its digests into one run, a row for each distinct text. Runs then meet in rounds, two at
least: the nodes are numbered in base ``FAN``, round r joins the nodes that differ in digit r alone, and each takes
the part of the digest space that its digit names from all of them. A multiway merge keeps, for every digest, the
identifier to retain and the number of rows. After the last round a node holds all entries of its part of the digest
space, so no task ever holds more than that part, and a text with any number of copies is one entry of each run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release

FAN, BITS = 4, 2
PART = "node int, digest binary, check binary, keep binary, size binary"
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _joined(run: Run, largest: bool) -> Run:
    """A run in order of digest with the entries of equal digest and equal check value joined."""
    digest, check, keep, size = run
    same = digest[1:] == digest[:-1]
    if (same & (check[1:] != check[:-1])).any():  # one digest of two texts: they are told apart by the check value
        order = np.lexsort((check, digest))
        digest, check, keep, size = (x[order] for x in run)
        same = digest[1:] == digest[:-1]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(digest)), bool), ~same | (check[1:] != check[:-1])]))
    pick = np.maximum if largest else np.minimum
    return digest[at], check[at], pick.reduceat(keep, at), np.add.reduceat(size, at)


def _merge(runs: list[Run], largest: bool) -> Run:
    """One run from several: a multiway merge by digest. The stable sort is one that finds the runs and merges them."""
    digest, *rest = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(digest, kind="stable")
    return _joined((digest[order], *(x[order] for x in rest)), largest)


def _cut(run: Run, node: int, rounds: int, r: int) -> pa.RecordBatch:
    """The parts of a run by the node that each goes to in round r; a run there has the first r digits in common, so its parts lie one behind the other."""
    top = np.frombuffer(run[0].tobytes(), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
    digit = (top >> np.uint64(64 - BITS * (r + 1))) & np.uint64(FAN - 1)
    ends = np.searchsorted(digit, np.arange(FAN + 1, dtype=np.uint64))
    rows, unit = [], FAN ** (rounds - 1 - r)
    for d in range(FAN):
        if ends[d] < ends[d + 1]:
            rows.append([node + (d - node // unit % FAN) * unit, *(x[ends[d] : ends[d + 1]].tobytes() for x in run)])
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kinds[i]) for i in range(5)], names=["node", "digest", "check", "keep", "size"])


def _first(largest: bool, rounds: int) -> Callable:
    none = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[Run] = []
        for b in batches:
            if b.num_rows:
                digest = np.array(b.column(0).to_pylist(), "S32")
                keep = b.column(2).fill_null(int(none)).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append(_merge([(digest, b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), keep, np.ones(len(keep), np.int64))], largest))
                if sum(len(x[0]) for x in held[1:]) > len(held[0][0]):
                    held = [_merge(held, largest)]
        if held:
            yield _cut(_merge(held, largest), TaskContext.get().partitionId() % FAN**rounds, rounds, 0)
        del held
        release()

    return run


def _runs(table: pa.Table, largest: bool) -> Run:
    kinds = ["S32", np.int64, np.int64, np.int64]
    return _merge([tuple(np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True)) for row in zip(*(table.column(i).to_pylist() for i in range(1, 5)), strict=True)], largest)


def _round(largest: bool, rounds: int, r: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_cut(_runs(table, largest), table.column(0)[0].as_py(), rounds, r)])

    return run


def _last(largest: bool) -> Callable:
    none = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        digest, check, keep, size = _runs(table, largest)
        raw = digest.tobytes()
        return pa.table({"digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), "check": check, "keep_id": pa.array(keep, mask=keep == none), "group_size": size})

    return run


def digest_groups(rows: DataFrame, rounds: int, largest: bool) -> DataFrame:
    """``rows(digest binary(32), check long, id long)`` to one row for each distinct text: ``digest, check, keep_id, group_size``.

    Every round is an exchange by node and a merge there, of ``FAN`` runs or, first, as many more as there are partitions to a node.
    """
    parts = rows.select("digest", "check", "id").mapInArrow(_first(largest, rounds), PART)
    for r in range(1, rounds):
        parts = parts.groupBy("node").applyInArrow(_round(largest, rounds, r), PART)
    return parts.groupBy("node").applyInArrow(_last(largest), "digest binary, check long, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", per_node: int = 50_000) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; null counts as the empty text. ``keep`` says whether the row with the
    least ("min") or the greatest ("max") identifier stays. Two texts are taken for equal when SHA-256 and an
    independent 64-bit hash both agree. There are at least ``rows / per_node`` nodes, at least as many as partitions, and
    at least ``FAN**2``, so runs are exchanged in two rounds or more.

    Null identifiers are never kept for one that isn't null; a text all of whose identifiers are null has a null
    ``keep_id`` and all its rows count as kept. Rows that repeat identifier and text are one document twice: they
    share one flag and each counts in ``group_size``. An empty table gives an empty result. Texts of any length are
    digested whole and go no further. Columns beside the two that are named are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"))
    rows = scratch.put(rows)
    nodes, rounds = max(rows.count() // per_node, rows.rdd.getNumPartitions()), 2
    while FAN**rounds < nodes:
        rounds += 1
    groups = scratch.put(digest_groups(rows, rounds, keep == "max"))
    return rows.join(groups, ["digest", "check"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
