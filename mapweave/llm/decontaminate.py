"""Benchmark decontamination over a distributed positional inverted index (operator 6).

build_index() cuts the corpus into shards of a few megabytes of text and stores
each shard's postings: its distinct terms in order, and for each term the sorted
word positions at which it occurs. A search reads every shard once. For each
benchmark window it starts from the rarest term's list, and intersects it with
the other terms' lists, each moved by the term's offset in the window, in order
of rising frequency. Nothing is shuffled, so neither a hot source nor groups of
copies can fill one task.

Terms are kept as 64-bit hashes of words; a window matches when the hashes of
all its words match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import wordhash
from mapweave.llm.scratch import Scratch

WINDOW = 13
#: All words of a window within so many words of its longest one, the first of those, make a proximity match.
SLOP = 20
#: Candidate positions that are looked at together; more are taken in turns, which bounds memory.
TURN = 1 << 20
#: Bytes of text of a shard, about; every shard looks for every window, so fewer are better, and one is in a worker's memory.
SHARD_BYTES = 1 << 22
#: Bytes of benchmark text that one pass over the index looks for; a larger benchmark takes more passes.
PASS_BYTES = 8 << 20

INDEX = "shard string, ids array<long>, first binary, terms binary, lists binary, positions binary"


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a batch of texts, and for each text the index of its first word (n + 1 entries)."""
    first, found = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)]
    for part in wordhash.chunks(iter([batch])):
        data, at = wordhash.utf8(part.column("text"))
        low = wordhash.LOWER[data]
        starts, ends, begin = wordhash.words(low, at, wordhash.ALNUM)
        found.append(wordhash.hashes(low, starts, ends))
        first.append(first[-1][-1] + begin[1:])
    return np.concatenate(found), np.concatenate(first)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import uuid

    for batch in wordhash.chunks(batches, SHARD_BYTES):
        h, first = _hashes(batch)
        order = np.argsort(h, kind="stable")
        h = h[order]
        lists = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
        parts = [first.astype("<u4"), h[lists], np.append(lists, len(h)).astype("<u4"), order.astype("<u4")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([batch.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
            names=["shard", "ids", "first", "terms", "lists", "positions"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The index of `docs` (doc_id, text): one row for each shard. Save it before searching it."""
    return docs.select("doc_id", "text").mapInArrow(wordhash.tidy(_postings), INDEX)


class Shard:
    """One shard's postings, ready for searching."""

    def __init__(self, ids: list, first: bytes, terms: bytes, lists: bytes, positions: bytes):
        self.ids = ids
        self.first = np.frombuffer(first, "<u4").astype(np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.lists = np.frombuffer(lists, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.n = int(self.first[-1])
        #: Term and position in one number: rises over all lists.
        self.where = np.repeat(np.arange(len(self.terms)) * (self.n + 1), np.diff(self.lists)) + self.positions

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash among the shard's terms, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def count(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often each term occurs at low <= position < high."""
        base = term * (self.n + 1)
        return np.searchsorted(self.where, base + high) - np.searchsorted(self.where, base + low)

    def _turns(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every position at which each of the terms occurs, as (place in `term`, position), at most about TURN together."""
        n = self.lists[term + 1] - self.lists[term]
        ends = np.cumsum(n)
        start = 0
        while start < len(term):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + TURN, "right")))
            some = n[start:stop]
            held = np.repeat(np.arange(start, stop), some)
            yield held, self.positions[self.lists[term[held]] + np.arange(len(held)) - np.repeat(np.cumsum(some) - some, some)]
            start = stop

    def search(self, windows: "Windows", slop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows and start positions of phrase matches; windows and texts of proximity matches."""
        term = self.term_ids(windows.known)[windows.place]
        frequency = np.where(term >= 0, self.lists[term + 1] - self.lists[term], 0)
        none = np.zeros(0, np.int64)
        phrase, near = [(none, none)], [(none, none)]
        for size, begins in windows.by_size.items():
            grid = begins[:, None] + np.arange(size)
            often = frequency[grid]
            live = np.flatnonzero(often.min(axis=1) > 0) if len(begins) else none
            grid, order, at = grid[live], np.argsort(often[live], axis=1, kind="stable"), begins[live]
            line = np.arange(len(live))
            for held, spots in self._turns(term[grid[line, order[:, 0]]]):
                begin = spots - order[held, 0]
                doc = np.searchsorted(self.first, spots, "right") - 1
                ok = (begin >= self.first[doc]) & (begin + size <= self.first[doc + 1])
                win, begin = held[ok], begin[ok]
                for k in range(1, size):
                    j = order[win, k]
                    keep = self.count(term[grid[win, j]], begin + j, begin + j + 1) > 0
                    win, begin = win[keep], begin[keep]
                phrase.append((at[win], begin))
            if slop is None:
                continue
            for held, spots in self._turns(term[grid[line, windows.lengths[grid].argmax(axis=1)]] if len(live) else none):
                doc = np.searchsorted(self.first, spots, "right") - 1
                low, high = np.maximum(self.first[doc], spots - slop), np.minimum(self.first[doc + 1], spots + slop + 1)
                for k in range(size):
                    keep = self.count(term[grid[held, order[held, k]]], low, high) > 0
                    held, low, high, doc = held[keep], low[keep], high[keep], doc[keep]
                near.append((at[held], doc))
        return *(np.concatenate(x) for x in zip(*phrase, strict=True)), *(np.concatenate(x) for x in zip(*near, strict=True))


class Windows:
    """The windows of a benchmark block: hashes of all item words, and the windows' first words by size."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        column = pa.array([t for _, t in items], pa.string())
        data, at = wordhash.utf8(column)
        low = wordhash.LOWER[data]
        starts, ends, first = wordhash.words(low, at, wordhash.ALNUM)
        self.words, self.lengths = wordhash.hashes(low, starts, ends), ends - starts
        #: Each different word once, and which of them stands where.
        self.known, self.place = np.unique(self.words, return_inverse=True)
        self.names = [i for i, _ in items]
        self.item = np.repeat(np.arange(len(items)), np.diff(first))
        by: dict[int, list[np.ndarray]] = {}
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                by.setdefault(min(size, b - a), []).append(np.arange(a, max(a + 1, b - size + 1)))
        self.by_size = {k: np.concatenate(v) for k, v in by.items()}


def _search(items: list, size: int, slop: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items, size)
        width = np.zeros(len(windows.words), np.int64)
        for k, begins in windows.by_size.items():
            width[begins] = k
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row["ids"], row["first"], row["terms"], row["lists"], row["positions"])
                win, begin, near, near_doc = shard.search(windows, slop)
                n = len(shard.ids)
                step = np.bincount(begin, minlength=shard.n + 1)[: shard.n + 1] - np.bincount(begin + width[win], minlength=shard.n + 1)[: shard.n + 1]
                hit = np.cumsum(step)[: shard.n] > 0
                found: list[set] = [set() for _ in range(n)]
                close: list[set] = [set() for _ in range(n)]
                doc = np.searchsorted(shard.first, begin, "right") - 1
                for into, docs, of in ((found, doc, win), (close, near_doc, near)):
                    for d, w in np.unique(np.stack((docs, windows.item[of])), axis=1).T.tolist() if len(docs) else ():
                        if windows.names[w] is not None:
                            into[d].add(windows.names[w])
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                # A run of hit words ends at its text's end at the latest.
                spans: list[list[int]] = [[] for _ in range(n)]
                for a, b in edge.reshape(-1, 2).tolist():
                    d = int(np.searchsorted(shard.first, a, "right")) - 1
                    while a < b:
                        stop = min(b, int(shard.first[d + 1]))
                        if stop > a:
                            spans[d] += [a - int(shard.first[d]), stop - int(shard.first[d])]
                        a, d = stop, d + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(shard.ids, pa.int64()), pa.array(np.diff(shard.first), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(s) for s in found], pa.list_(pa.string())), pa.array([sorted(s) for s in close], pa.list_(pa.string()))],
                    names=["shard", "at", "doc_id", "n_words", "spans", "items", "near_items"],
                )

    return rows


def search_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """shard, at, doc_id, n_words, spans, items, near_items for each indexed text.

    spans: word positions [from, to, from, to, ...] of the union of all phrase
    matches; items and near_items: ids of the benchmark items with a phrase or
    a proximity match. `benchmark` has item_id and text. The driver holds
    PASS_BYTES of it at a time: a larger one takes several passes.
    """
    spark: SparkSession = index.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = total // PASS_BYTES + 1
    kind = "shard string, at int, doc_id long, n_words long, spans array<long>, items array<string>, near_items array<string>"
    if passes == 1:
        return index.mapInArrow(wordhash.tidy(_search([tuple(r) for r in items.collect()], window, slop)), kind)
    scratch, found = Scratch(spark, "decontaminate"), None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        part = scratch.save(index.mapInArrow(wordhash.tidy(_search([tuple(r) for r in block.collect()], window, slop)), kind), f"pass-{k}")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("shard", "at").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.collect_list("spans").alias("lists"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")))

    def places(s):
        """The word positions of a list of spans."""
        pairs = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(pairs, lambda i: F.sequence(F.get(s, 2 * i), F.get(s, 2 * i + 1) - 1)))

    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("lists", places))))
    singles = F.flatten(F.transform(covered, lambda p: F.array(p, p + 1)))
    return merged.select("shard", "at", "doc_id", "n_words", singles.alias("spans"), "items", "near_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, items, near_items, spans, contaminated for each row of `docs` (doc_id, text).

    A text is contaminated when words in phrase matches are at least a
    twentieth of its words. Null and empty texts have no words and are clean.
    Null and empty items match nothing; an item without id counts its hits but
    is in no list. Repeated rows each give a row, repeated items count once.
    Empty tables give an empty result, or clean documents.
    """
    index = Scratch(docs.sparkSession, "positional-index").save(build_index(docs), "index")
    found = search_index(index, benchmark, window, slop)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "near_items", "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
