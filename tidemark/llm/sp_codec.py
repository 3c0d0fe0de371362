"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that the worker hasn't met lately, each once, are laid end to end and indexed by a suffix array;
the ids of the others are remembered from the batches before. Every piece of the vocabulary is found
by binary search, which gives all its occurrences as one range; the occurrences are edges from their first to behind
their last character, and are sorted by position. Relaxing them in that order gives the ids: an edge is taken if its
start has been reached and if it may follow the piece that the start was reached by.

The models here are byte-pair models, for which "may follow" is exact: the encoding of a prefix ends in one piece, and
piece q can follow piece p just when no merge across their border would have come before both were complete. So each
position is reached by one edge, the library's own choice, not by the best of several.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, slices, text_lengths

_LOADED: dict[str, Codec] = {}
_RAW: dict[str, tuple[np.ndarray, np.ndarray]] = {}
#: Words whose ids a worker remembers from one slice to the next; then it starts anew.
MEMORY = 120_000
SPACE = "▁"


class Codec:
    """The pieces of a byte-pair SentencePiece model and what matching needs of them."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.rank = {self.pieces[i]: -m.get_score(i) for i in normal}
        self.id = {self.pieces[i]: i for i in normal}
        self.bytes = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # Compact numbers of the characters of pieces; 0 for any other.
        chars = sorted({c for p in self.id for c in p})
        self.char = np.zeros(0x110000, np.int64)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.base = len(chars) + 1
        #: Neighbours inside some piece. Between two other characters no merge can reach.
        self.joined = np.unique(np.array([self._code(a) * self.base + self._code(b) for p in self.id for a, b in zip(p, p[1:], strict=False)], np.int64))
        # What merging makes: for each piece that it can make, the parts of its last merge.
        self.parts: dict[str, tuple[str, str]] = {}
        for p in self.id:
            if len(p) > 1:
                out, last = self.merge(p)
                if len(out) == 1:
                    self.parts[p] = last
        # Matching alphabet: single characters of pieces, whether or not they are pieces, and all that merging can make.
        self.names = sorted({*chars, *self.parts}, key=lambda p: (len(p), p))
        self.number = {p: i for i, p in enumerate(self.names)}
        self.ids = np.array([self.id.get(p, -1) for p in self.names])
        self.length = np.array([len(p) for p in self.names])
        self.most = int(self.length.max())
        self.letters = np.zeros((len(self.names), self.most), np.int64)
        for i, p in enumerate(self.names):
            self.letters[i, : len(p)] = [self._code(c) for c in p]
        self._spines()
        self.slots = np.full(1 << 21, -1, np.int64)
        self.answers = np.zeros(1 << 21, bool)
        self.forget()

    def _code(self, c: str) -> int:
        return int(self.char[ord(c)])

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Plain byte-pair merging of a short string, leftmost first among equals, and the last merge's parts."""
        parts, last = list(text), ("", "")
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts, last
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _spines(self) -> None:
        """For each name, the names along its right and its left edge, with ranks when made and when used up."""
        n, depth = len(self.names), 0
        edges = {}
        for side in (0, 1):
            rows = []
            for p in self.names:
                row, end = [], np.inf
                while True:
                    made = self.rank[p] if p in self.parts else -np.inf
                    row.append((self.number[p], made, end))
                    if p not in self.parts:
                        break
                    end, p = made, self.parts[p][1 - side]
                rows.append(row)
                depth = max(depth, len(row))
            edges[side] = rows
        self.spine = []
        for side in (0, 1):
            name, made, end = np.full((n, depth), -1), np.zeros((n, depth)), np.zeros((n, depth))
            for i, row in enumerate(edges[side]):
                for j, (a, b, c) in enumerate(row):
                    name[i, j], made[i, j], end[i, j] = a, b, c
            self.spine.append((name, made, end))
        pairs = sorted((self.number[p[:i]] * n + self.number[p[i:]], self.rank[p]) for p in self.id for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number)
        self.pair = np.array([x[0] for x in pairs], np.int64)
        self.pair_rank = np.array([x[1] for x in pairs])
        self.is_space = np.array([not p.strip(SPACE) for p in self.names])

    def _follows(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether merging the text of p and q leaves just p and q. On the left, p's right edge counts, on the right q's left edge."""
        (pn, pm, pe), (qn, qm, qe) = self.spine
        ok = np.ones(len(p), bool)
        for i in range(pn.shape[1]):
            for j in range(qn.shape[1]):
                at = np.flatnonzero(ok & (pn[p, i] >= 0) & (qn[q, j] >= 0))
                if not len(at):
                    continue
                a, b = p[at], q[at]
                key = pn[a, i] * len(self.names) + qn[b, j]
                k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                hit = np.flatnonzero(self.pair[k] == key)
                at, a, b, r = at[hit], a[hit], b[hit], self.pair_rank[k[hit]]
                begin = np.maximum(np.maximum(pm[a, i], qm[b, j]), r)
                ok[at[(begin < pe[a, i]) & (np.maximum(pm[a, i], qm[b, j]) < qe[b, j]) & (r <= qe[b, j])]] = False
        for x in np.flatnonzero(self.is_space[p]):  # runs of spaces have pieces of one rank, where place alone decides
            a, b = self.names[p[x]], self.names[q[x]]
            ok[x] = self.merge(a + b)[0] == [a, b]
        return ok

    def follows(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """:meth:`_follows`, with the answers to recent questions kept in a table of fixed size."""
        key = p * len(self.names) + q
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        out = self.answers[slot]
        new = np.flatnonzero(self.slots[slot] != key)
        if len(new):
            distinct, first = np.unique(key[new], return_index=True)
            first = new[first]
            answer = self._follows(p[first], q[first])
            out[new] = answer[np.searchsorted(distinct, key[new])]
            self.slots[slot[first]], self.answers[slot[first]] = distinct, answer
        return out

    def suffixes(self, a: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Suffix array of ``a`` by prefix doubling, as far as the longest piece. ``left``: characters to the end of the segment."""
        rank, width = a.copy(), 1
        while width < self.most:
            ahead = np.zeros_like(rank)
            ahead[:-width] = rank[width:]
            ahead[left <= width] = 0
            _, rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
            rank += 1
            width *= 2
        return np.argsort(rank, kind="stable")

    def edges(self, a: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and name of every occurrence of every name within a segment."""
        sa = self.suffixes(a, left)
        group = np.zeros(len(a), np.int64)
        low = np.zeros(len(self.names), np.int64)
        high = np.full(len(self.names), len(a), np.int64)
        live = np.arange(len(self.names))
        padded = np.concatenate([a, np.zeros(self.most, np.int64)])
        for c in range(self.most):
            key = group * self.base + np.where(left[sa] > c, padded[sa + c], 0)
            want = group[low[live]] * self.base + self.letters[live, c]
            low[live], high[live] = np.searchsorted(key, want), np.searchsorted(key, want, "right")
            live = live[(high[live] > low[live]) & (self.length[live] > c + 1)]
            if not len(live):
                break
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        n = np.maximum(high - low, 0)
        name = np.repeat(np.arange(len(self.names)), n)
        return sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)], name

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units end to end, and the n+1 offsets."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        if not len(points):
            return np.zeros(0, np.int64), begin
        a = self.char[points]
        cut = np.ones(len(a), bool)
        pair = a[:-1] * self.base + a[1:]
        cut[1:] = self.joined[np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)] != pair
        cut[begin[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(a))
        segment = np.cumsum(cut) - 1
        start, name = self.edges(a, ends[segment] - np.arange(len(a)))
        # Sorted by where they end in their segment, the edges of all segments are relaxed together.
        stop = start + self.length[name]
        depth = stop - starts[segment[start]]
        order = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 65536 else depth, kind="stable")
        start, name, stop, depth = start[order], name[order], stop[order], depth[order]
        last = np.full(len(a) + 1, -1, np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) if len(depth) else []
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            s, q = start[x:y], name[x:y]
            first = cut[s]
            p = last[s - 1]
            ok = first | (p >= 0)
            both = np.flatnonzero(ok & ~first)
            ok[both] = self.follows(p[both], q[both])
            last[stop[x:y][ok] - 1] = q[ok]
        # Back from the end of each segment.
        at, tokens, places = ends[a[ends - 1] > 0] - 1, [], []
        while len(at):
            q = last[at]
            begin_of = at - self.length[q] + 1
            tokens.append(q)
            places.append(begin_of)
            at = begin_of[~cut[begin_of]] - 1
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        ids = self.ids[np.concatenate(tokens)] if tokens else np.zeros(0, np.int64)
        raw_at = np.concatenate([np.flatnonzero(a == 0), place[ids < 0]])
        raw = [chr(points[i]).encode() for i in raw_at]
        n = np.array([len(r) for r in raw], np.int64)
        place, keep = np.concatenate([place[ids >= 0] * 8, np.repeat(raw_at * 8, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]), ids[ids >= 0]
        ids = np.concatenate([keep, self.bytes[np.frombuffer(b"".join(raw), np.uint8)]])
        order = np.argsort(place, kind="stable")
        return ids[order], np.searchsorted(place[order], begin * 8)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_ids, self.known_off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str], most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n+1 offsets. A word is matched once while it is remembered."""
        if len(self.known) > MEMORY:
            self.forget()
        known, old = self.known, len(self.known)
        at, per = [], []
        for t in texts:
            own = _units(t) if t else []
            at.append(np.fromiter((known.setdefault(u, len(known)) for u in own), np.int64, len(own)))
            per.append(len(own))
        names = list(itertools.islice(known, old, None))
        ids, ends, base = [self.known_ids], [self.known_off], len(self.known_ids)
        for i, j in slices(np.array([len(u) for u in names], np.int64), most):
            x, off = self.encode_units(names[i:j])
            ids.append(x.astype(np.int32))
            ends.append(off[1:] + base)
            base += len(x)
        self.known_ids, self.known_off = np.concatenate(ids), np.concatenate(ends)
        which = np.concatenate(at) if at else np.zeros(0, np.int64)
        n = self.known_off[which + 1] - self.known_off[which]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.known_ids[np.arange(total[-1]) - np.repeat(total[:-1] - self.known_off[which], n)]
        return flat, total[np.concatenate([[0], np.cumsum(per, dtype=np.int64)])]


def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end, ``▁`` as a space and none for control pieces, and the n+1 offsets."""
    if path not in _RAW:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [b"" if m.is_control(i) or m.is_unknown(i) else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(m.get_piece_size())]
        _RAW[path] = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return _RAW[path]


def decode_ids(path: str, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """The texts of ids laid end to end: pieces one after another, byte tokens as UTF-8, without the space put in front."""
    table, at = _bytes_of(path)
    n = np.diff(at)[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    raw = table[np.arange(ends[-1]) - np.repeat(ends[:-1] - at[ids], n)].tobytes()
    return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[off[:-1]], ends[off[1:]], strict=True)]


def _units(text: str) -> list[str]:
    """A space in front, then units of spaces and what follows up to the next space."""
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return [SPACE + w for w in words]
    out, spaces = [], ""
    for w in words:
        spaces += SPACE
        if w:
            out.append(spaces + w)
            spaces = ""
    return [*out, spaces] if spaces else out


def codec(path: str) -> Codec:
    """The codec of a model, made once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
        release()
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """One row for each input row: ``doc_id, n_tokens, ids``; the ids the library gives for the whole text.

    No begin or end tokens; strings of special tokens are ordinary text. Null and empty texts have no ids. Null
    identifiers and repeated rows pass through; an empty table gives an empty result; other columns are not read. The
    model must be a byte-pair model with byte fallback, without normalisation, at ``model_path`` on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            for i, j in slices(text_lengths(b.column(1)), slice_bytes):
                flat, off = c.encode(b.column(1).slice(i, j - i).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off)), ids], names=["doc_id", "n_tokens", "ids"])
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: ``doc_id, text`` and the columns of ``carry``. Null or no ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                lists = part.column(1)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode_ids(model_path, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *(part.column(k) for k in range(2, part.num_columns))], names=["doc_id", "text", *carry])
        release()

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("__ids"), *carry)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join([kinds[0], "text string", *kinds[2:]]))
