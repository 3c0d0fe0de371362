"""Token counts: Arrow batches are encoded in slices of about equal bytes, and only lengths return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, slices, text_lengths

_LOADED: dict[str, object] = {}


def _processor(path: str):
    """The tokenizer, loaded once in a worker."""
    if path not in _LOADED:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        #: No piece holds a space after another character, so no merge reaches across such a place.
        safe = all("▁" not in p.lstrip("▁") for i, p in enumerate(pieces) if not m.is_byte(i))
        #: White space is kept as it is and a text gets one space in front: what is cut off at a space gets that space back.
        safe = safe and m.encode("a  b", out_type=str) == m.encode("a", out_type=str) + m.encode(" b", out_type=str) and m.encode("b c  d") == m.encode("b") + m.encode("c  d")
        _LOADED[path] = m, safe
    return _LOADED[path]


def cut_text(text: str, most: int) -> list[str]:
    """Parts of about ``most`` characters, cut at single spaces, which the cut takes out: the encoder puts one before each part."""
    parts, start = [], 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at >= 0 and (at + 1 >= len(text) or text[at + 1] in " ▁" or text[at - 1] in " ▁"):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def _counts(texts: list[str], path: str, piece_chars: int) -> np.ndarray:
    m, safe = _processor(path)
    parts, owner = [], []
    for i, t in enumerate(texts):
        own = cut_text(t, piece_chars) if safe and len(t) > 2 * piece_chars else [t]
        parts += own
        owner += [i] * len(own)
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
    found = m.encode([parts[k] for k in order], num_threads=1)
    out = np.zeros(len(texts), np.int64)
    np.add.at(out, [owner[k] for k in order], [len(x) for x in found])
    return out


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, slice_bytes: int = 1 << 20, piece_chars: int = 8192) -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``n_tokens`` is the number of ids that the SentencePiece model at ``model_path`` gives for the whole text, without
    begin or end tokens. Texts are encoded in slices of about ``slice_bytes``; a text of over twice ``piece_chars``
    characters is cut at spaces where the model's pieces allow it, else it is encoded in one. Null and empty texts
    have no bytes and no tokens. Null identifiers and repeated rows pass through; an empty table gives an empty
    result; other columns are not read. The model file must be at ``model_path`` on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = text_lengths(b.column(1))
            tokens = [np.zeros(0, np.int64)]
            for i, j in slices(size, slice_bytes):
                tokens.append(_counts([t or "" for t in b.column(1).slice(i, j - i).to_pylist()], model_path, piece_chars))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(np.concatenate(tokens))], names=["doc_id", "n_bytes", "n_tokens"])
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
