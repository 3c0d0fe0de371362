"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, slices, text_lengths

_TABLE: list[np.ndarray] = []
#: Code points need 21 bits; three of them and the order of the n-gram fill a word.
_SHIFT = np.uint64(21)


def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all letter n-grams, n from 1 to 3, of the lower-cased whole text; what lies between words is one space, code 0.

    An n-gram of three is ``a<<42 | b<<21 | c``. A shorter one is written with leading ``0x1FFFFF``, which is no code point.
    """
    a = _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not a.any():
        return np.zeros(0, np.uint64)
    a = np.concatenate([[0], a, [0]]).astype(np.uint64)
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]
    fill = np.uint64(0x1FFFFF)
    one = a[a != 0] | fill << _SHIFT | fill << np.uint64(42)
    two = a[:-1] << _SHIFT | a[1:] | fill << np.uint64(42)
    three = a[:-2] << np.uint64(42) | a[1:-1] << _SHIFT | a[2:]
    return np.concatenate([one, two, three])


def _ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, more frequent first, then by code."""
    codes, n = np.unique(codes, return_counts=True)
    if len(codes) > most:
        edge = -np.partition(-n, most - 1)[most - 1]
        codes, n = codes[n >= edge], n[n >= edge]
    return codes[np.lexsort((codes, -n))][:most]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """``lang, gram, rank``: the ``size`` most frequent n-grams of each language over all given rows and whole texts.

    Counts leave a task already summed; the ranking first takes the best of each of 64 hashed parts of a language,
    so no task sees all n-grams of one. Rows without text or language teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([k for k, v in held.items() for _ in range(len(v[0]))], pa.string()), *(pa.array(np.concatenate([v[i] for v in held.values()]).astype(np.int64)) for i in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["lang", "gram", "n"])

        for b in batches:
            for i, j in slices(text_lengths(b.column(1)), 1 << 19):
                texts, langs = b.column(1).slice(i, j - i).to_pylist(), b.column(0).slice(i, j - i).to_pylist()
                for lang in set(langs):
                    codes = np.concatenate([ngrams(t) for t, x in zip(texts, langs, strict=True) if x == lang])
                    codes, n = np.unique(codes, return_counts=True)
                    if lang in held:
                        both, back = np.unique(np.concatenate([held[lang][0], codes]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([held[lang][1], n]), len(both)).astype(np.int64)
                        codes = both
                    held[lang] = codes, n
                if sum(len(v[0]) for v in held.values()) > 1_000_000:
                    yield out()
        if held:
            yield out()
        release()

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))
    few = counts.withColumn("part", part).withColumn("r", best("lang", "part")).where(F.col("r") <= size)
    return few.withColumn("rank", best("lang")).where(F.col("rank") <= size).select("lang", "gram", "rank")


def predict_language(docs: DataFrame, profiles: list[tuple[str, int, int]], id_col: str = "doc_id", text_col: str = "text", size: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns of ``carry``, one row for each input row.

    The distance of a text to a language is the sum over the text's ``size`` most frequent n-grams of the difference
    of ranks, ``size`` for an n-gram that the profile lacks; the nearest language wins, on a tie the first by name.
    ``score`` is 1 / sum of exp(-(distance - least distance) / scale), scale being 2 % of the greatest distance that
    the text could have: 1 for a clear case, 1 / languages where all are equally far. A text that is null or has no
    letter is ``und`` with score 0, as is every text when no language was learned.
    """
    langs = sorted({x[0] for x in profiles})
    grams = np.unique(np.array([x[1] for x in profiles], np.uint64))
    ranks = np.full((len(grams) + 1, max(1, len(langs))), -1, np.int32)
    for lang, gram, rank in profiles:
        ranks[np.searchsorted(grams, np.uint64(gram)), langs.index(lang)] = rank

    def one(text: str | None) -> tuple[str, float]:
        mine = _ranked(ngrams(text), size) if text and langs else ()
        if not len(mine):
            return "und", 0.0
        at = np.searchsorted(grams, mine)
        at[(at == len(grams)) | (np.append(grams, np.uint64(0))[at] != mine)] = len(grams)
        theirs = ranks[at]
        away = np.where(theirs < 0, size, np.abs(theirs - np.arange(1, len(mine) + 1)[:, None])).sum(0)
        best = int(np.argmin(away))
        return langs[best], float(1 / np.exp(-(away - away[best]) / (0.02 * size * len(mine))).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(b.column(0)[i].as_py()) for i in range(b.num_rows)]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            rest = range(0 if text_col in carry else 1, b.num_columns)
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(i) for i in rest)], names=["lang_pred", "score", *(named[i] for i in rest)])
            del b, found, cols
        release()

    # A text that is carried goes to the worker and back as the column that is read, not as a second one.
    rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("doc_id"), *(c for c in carry if c != text_col))
    named = [text_col, *rows.columns[1:]]
    kinds = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(named, rows.schema.fields, strict=True) if n != text_col or text_col in carry)
    return rows.mapInArrow(run, f"lang_pred string, score double, {kinds}").select("doc_id", "lang_pred", "score", *carry)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the rows outside the held-out quarter and predict every row: ``doc_id, held_out, lang_pred, score``.

    A row is held out when crc32 of its identifier as text leaves 2 divided by 4. A null identifier is neither held
    out nor learned from. Only ``size`` n-grams of each language reach the driver. Repeated rows teach and are predicted
    each; texts of any length are read whole; an empty table gives an empty result. Columns beside the three named and
    those of ``carry`` are not read.
    """
    part = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))
    profiles = [(r.lang, r.gram, r.rank) for r in learn_profiles(docs.where(part != 2), text_col, lang_col, size).collect()]
    out = predict_language(docs, profiles, id_col, text_col, size, carry)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", *carry)
