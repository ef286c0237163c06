"""Token counts under a unigram model, shared over a trie of pre-tokens (operator 4).

A pre-token is a word with its leading space mark. A batch's distinct pre-tokens
go into a trie level by level: a node is a distinct prefix. The forward score of
a node, the best total of piece scores that spells its prefix, depends on the
prefix only, so each is computed once, whatever the number of pre-tokens that
share it: over all piece lengths, the best of an ancestor's score and the score
of the piece that leads from there. Nodes at which pre-tokens end keep the number
of pieces of their best path, their terminal count.

Where no piece holds two neighbouring characters side by side, every path ends a
piece between them. Pre-tokens are cut there before they go into the trie, which
changes no count and makes short parts of lines and of scripts without spaces.
Once the prefixes that are left belong to one pre-token each, nothing is shared
any more, and few such branches are followed one by one to their ends.

Piece scores are Zipf's: the piece of rank r among the vocabulary's pieces has
-log(r + 1). A character that is no piece costs UNKNOWN and counts as one token
for each of its bytes. Among equal totals the longer last piece wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapweave.llm import wordhash

SPACE = "▁"
UNKNOWN = -30.0
#: Branches that nothing else shares are followed one by one if there are so few.
FEW = 64
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


class Unigram:
    """Pieces and their scores, found by hashes of code points."""

    def __init__(self, scores: dict[str, float]):
        self.scores = {p: s for p, s in scores.items() if p}
        self.longest = max(map(len, self.scores), default=1)
        self.powers = [_U(pow(int(_BASE), k + 1, 1 << 64)) for k in range(self.longest)]
        h = np.array([self._hash(p) for p in self.scores], _U)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces have one hash")
        # An open-addressing table, at most an eighth full.
        self.shift = _U(64 - max(4, int(8 * len(h)).bit_length()))
        self.keys, self.values = np.zeros(1 << (64 - int(self.shift)), _U), np.full(1 << (64 - int(self.shift)), -np.inf)
        for key, score in zip(h.tolist(), self.scores.values(), strict=True):
            at = key >> int(self.shift)
            while self.values[at] > -np.inf:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at] = key, score
        #: Characters that stand side by side in a piece.
        self.inside = np.unique(np.array([ord(x) << 21 | ord(y) for p in self.scores for x, y in zip(p, p[1:], strict=False)], np.int64))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_BASE)) % (1 << 64)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Scores of pieces by hash; -inf where there is none."""
        at = (h >> self.shift).astype(np.int64)
        out = self.values[at]
        todo = np.flatnonzero((out > -np.inf) & (self.keys[at] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            out[todo] = self.values[at[todo]]
            todo = todo[(out[todo] > -np.inf) & (self.keys[at[todo]] != h[todo])]
        return out

    def parts(self, tokens: list[str]) -> list[list[str]]:
        """Each pre-token in parts that no piece spans."""
        flat = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.array([len(t) for t in tokens], np.int64))
        pairs = flat[:-1] << 21 | flat[1:]
        at = np.searchsorted(self.inside, pairs)
        apart = np.ones(len(pairs), bool) if not len(self.inside) else self.inside[np.minimum(at, len(self.inside) - 1)] != pairs
        apart[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(flat))] - 1] = False  # between two pre-tokens
        cuts = np.flatnonzero(apart) + 1
        of = np.searchsorted(ends, cuts, "right")
        out = [[t] for t in tokens]
        if not len(cuts):
            return out
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(of)], strict=True):
            i = int(of[a])
            start = int(ends[i]) - len(tokens[i])
            places = [0, *(cuts[a:b] - start).tolist(), len(tokens[i])]
            out[i] = [tokens[i][x:y] for x, y in zip(places, places[1:], strict=False)]
        return out

    def counts(self, tokens: list[str]) -> np.ndarray:
        """The number of pieces on the best path of each pre-token."""
        cut = self.parts(tokens)
        distinct = list({p for c in cut for p in c})
        of = dict(zip(distinct, self._trie(distinct).tolist(), strict=True))
        return np.array([sum(map(of.__getitem__, c)) for c in cut], np.int64)

    def _branch(self, token: str, depth: int, totals: list[float], pieces: list[int]) -> int:
        """The count of a pre-token whose prefixes from `depth` on are its own; totals and pieces are those of its last prefixes, the shortest first."""
        first = depth + 1 - len(totals)
        for end in range(depth + 1, len(token) + 1):
            best, count = -np.inf, 0
            for size in range(1, min(end - first, self.longest) + 1):
                score, at = self.scores.get(token[end - size : end]), end - size - first
                if score is not None and totals[at] + score >= best:
                    best, count = totals[at] + score, pieces[at] + 1
                elif score is None and size == 1:
                    best, count = totals[at] + UNKNOWN, pieces[at] + len(token[end - 1].encode("utf-8", "surrogatepass"))
            totals.append(best)
            pieces.append(count)
        return pieces[-1]

    def _trie(self, tokens: list[str]) -> np.ndarray:
        """The number of pieces on the best path of each of the distinct strings."""
        out = np.zeros(len(tokens), np.int64)
        rank = sorted(range(len(tokens)), key=tokens.__getitem__)
        flat = np.frombuffer("".join(tokens[i] for i in rank).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(tokens[i]) for i in rank], np.int64)
        start = np.cumsum(size) - size
        rows = np.flatnonzero(size > 0)
        node = np.zeros(len(tokens), np.int64)
        # Level by level; of each the nodes' parents, characters, best totals, counts and hashes of their last characters.
        parents, totals, pieces = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        trail: list[tuple[np.ndarray, np.ndarray]] = []  # (parents, characters) of the last levels
        depth = 0
        while len(rows):
            char = flat[start[rows] + depth].astype(np.int64)
            key = node[rows] << 21 | char  # rows are sorted, so equal prefixes stand together
            head = np.concatenate(([True], key[1:] != key[:-1]))
            up, ch = node[rows][head], char[head]
            node[rows] = np.cumsum(head) - 1
            trail = [(up, ch), *trail][: self.longest]
            best, count = np.full(len(up), -np.inf), np.zeros(len(up), np.int64)
            ancestor, h = np.arange(len(up)), np.zeros(len(up), _U)
            for back, (ups, chars) in enumerate(trail):
                # The suffix grows to the left: its new first character takes the highest power.
                h = h + (chars[ancestor].astype(_U) + _U(1)) * self.powers[back]
                ancestor = ups[ancestor]
                total = totals[back][ancestor] + self.find(h)
                more = total >= best if back else total > best
                better = more & (total > -np.inf)
                best[better], count[better] = total[better], pieces[back][ancestor][better] + 1
                if back == 0:
                    lost = ~better
                    width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
                    best[lost], count[lost] = (totals[0][ancestor] + UNKNOWN)[lost], (pieces[0][ancestor] + width)[lost]
            totals, pieces = [best, *totals][: self.longest], [count, *pieces][: self.longest]
            depth += 1
            over = size[rows] == depth
            out[np.array(rank)[rows[over]]] = count[node[rows[over]]]
            rows = rows[~over]
            if 0 < len(rows) <= FEW and len(np.unique(node[rows])) == len(rows):
                for row in rows.tolist():
                    at, path = int(node[row]), []
                    for back, (ups, _) in enumerate(trail):
                        path.append((float(totals[back][at]), int(pieces[back][at])))
                        at = int(ups[at])
                    if len(trail) < self.longest:  # from the root on
                        path.append((0.0, 0))
                    out[rank[row]] = self._branch(tokens[rank[row]], depth, *(list(x) for x in zip(*path[::-1], strict=True)))
                break
        return out


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Scores of pieces in order of rank."""
    return {p: -float(np.log(i + 1)) for i, p in enumerate(pieces)}


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """The ordinary pieces of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return Unigram(zipf_scores([m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]))


def pre_tokens(text: str) -> list[str]:
    """Words at the spaces of the text, each after a space mark."""
    return [SPACE + w for w in text.split(" ") if w]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens for each row of `docs` (doc_id, text) with the vocabulary at `path`.

    Null and empty texts, and texts of spaces only, have 0. Repeated rows each
    give a row, other columns are not read, and an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(path), _known.setdefault(path, {})
        for batch in wordhash.chunks(batches):
            cut = [pre_tokens(t or "") for t in batch.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union(*cut).difference(known))
            known.update(zip(new, model.counts(new).tolist(), strict=True))
            n = [sum(map(known.__getitem__, c)) for c in cut]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(map(len, cut), pa.int64())], names=["doc_id", "n_tokens", "n_pre_tokens"])

    return docs.select("doc_id", "text").mapInArrow(wordhash.tidy(rows), "doc_id long, n_tokens long, n_pre_tokens long")


_known: dict[str, dict[str, int]] = {}
wordhash.forget.append(_known.clear)
