"""Byte-level BPE encoding and decoding with numpy matrices (operator 9).

A batch's texts are cut into pre-tokens; its distinct new pre-tokens are grouped
by length into padded matrices of token ids. In each round every row merges its
leftmost pair of the smallest rank, found in an open-addressing hash table over
(left id, right id), and closes the gap; finished rows leave the matrix.
Pre-tokens of over LONG bytes, where one merge a round would be quadratic, take
the same merges from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapweave.llm import wordhash

LONG = 1024
#: Cells of one matrix, and pre-tokens whose ids a worker remembers.
CELLS, REMEMBERED = 1 << 19, 150_000
_NONE = np.int64(1 << 40)


class PairTable:
    """(left, right) -> merged id, by linear probing from a multiplicative hash."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, _NONE, np.int64)
        key = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at = todo[free]
            _, one = np.unique(slot[at], return_index=True)
            at = at[one]
            self.keys[slot[at]], self.ids[slot[at]] = key[at], merged[at]
            todo = np.setdiff1d(todo, at, assume_unique=True)
            slot[todo] = np.where(self.keys[slot[todo]] != -1, (slot[todo] + 1) & (len(self.keys) - 1), slot[todo])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of flat arrays of pairs; _NONE where a pair doesn't merge or an id is -1."""
        out = np.full(len(left), _NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[todo].astype(np.int64) << 32) | right[todo]
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.ids[slot[hit]]
            on = ~hit & (there != -1)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class Bpe:
    """The vocabulary of a rank file: a line for each token, its base64 form and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.lengths = np.array([len(t) for t in self.tokens])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).T)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (known := self.ranks.get(piece)) is not None:
                out[i] = np.array([known], np.uint32)
            elif len(piece) > LONG:
                out[i] = self._heap(piece)
            else:
                by.setdefault((len(piece) + 3) // 4, []).append(i)
        for group, rows in by.items():
            step = max(1, CELLS // (4 * group))
            for k in range(0, len(rows), step):
                self._matrix(pieces, rows[k : k + step], 4 * group, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        size = np.array([len(pieces[i]) for i in rows])
        ids = np.full((len(rows), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        rows = np.array(rows)
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost of equal ones
            best = rank[np.arange(len(rows)), at]
            going = best != _NONE
            if not going.all():
                for i, row in zip(rows[~going].tolist(), ids[~going], strict=True):
                    out[i] = row[row >= 0].astype(np.uint32)
                rows, ids, rank, at, best = rows[going], ids[going], rank[going], at[going], best[going]
            if not len(rows):
                return
            width = ids.shape[1] - 1
            shift = np.arange(width) > at[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            rank = np.where(shift[:, : width - 1], rank[:, 1:], rank[:, :-1])
            line = np.arange(len(rows))
            ids[line, at] = best
            # Only the pairs on both sides of a merged one are new.
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.pairs.find(ids[has, at[has] - 1], best[has])
            has = np.flatnonzero(at + 1 < width)
            rank[has, at[has]] = self.pairs.find(best[has], ids[has, at[has] + 1])
            if width == 1:
                ids, rank = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), np.full((len(rows), 1), _NONE)

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        merge = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := merge(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, end = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if not size[i] or j >= n or j + size[j] != end:
                continue
            ids[i], size[i], size[j], after[i] = rank, size[i] + size[j], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := merge(piece[i : after[i] + size[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, after[i] + size[after[i]]))
            if (p := before[i]) >= 0 and (r := merge(piece[p : i + size[i]])) is not None:
                heapq.heappush(heap, (r, p, i + size[i]))
        return np.array([x for x, s in zip(ids, size, strict=True) if s], np.uint32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a flat array of ids."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - ends + size, size)]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


_ids: dict[tuple[str, str], dict[str, bytes]] = {}
wordhash.forget.append(_ids.clear)


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    import regex

    bpe, known = load(path), _ids.setdefault((path, pattern), {})
    cut = [regex.findall(pattern, t) for t in texts]
    new = set().union(*cut).difference(known) if len(known) < REMEMBERED else None
    if new is None:
        known.clear()
        new = set().union(*cut)
    fresh = list(new)
    for piece, ids in zip(fresh, bpe.encode_pieces([p.encode() for p in fresh]), strict=True):
        known[piece] = ids.astype("<u4").tobytes()
    return [b"".join(map(known.__getitem__, c)) for c in cut]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary of little-endian unsigned 32-bit integers) for each row of `docs` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches):
            found = encode_texts([t or "" for t in batch.column("text").to_pylist()], path, pattern)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(wordhash.tidy(rows), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (binary) for each row of encode(); null ids are empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in wordhash.chunks(batches, column="ids"):
            data, at = wordhash.utf8(batch.column("ids"))
            out = [bpe.decode(np.frombuffer(data[a:b].tobytes(), "<u4")).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(wordhash.tidy(rows), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() in one pass over the rows.

    Null and empty texts have no tokens. Every row gives a row, repeated rows
    too; other columns are not read; an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in wordhash.chunks(batches):
            found = encode_texts([t or "" for t in batch.column("text").to_pylist()], path, pattern)
            back = (bpe.decode(np.frombuffer(f, "<u4")).data for f in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in found], pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(wordhash.tidy(rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
