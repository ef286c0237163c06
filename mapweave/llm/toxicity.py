"""Compression-distance toxicity scores with zstandard dictionaries (operator 8).

zstandard's trainer makes two dictionaries, one of ordinary and one of toxic
texts. Most of a toxic text is ordinary prose, which both would hold alike, so
the toxic one is trained on the passages that set toxic texts apart: runs of
byte 6-grams inside words that are RATIO times as frequent there, each counted
once for every different surroundings, so that copies of a text count once.

Every text is cut into short windows at spaces. A window is compressed with the
ordinary dictionary alone and with both in one; what the toxic one saves is the
window's distance. The distances of all windows give a text's features. A
logistic curve and its threshold are calibrated on texts that the dictionaries
used for them did not see: those of another fold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm import wordhash
from mapweave.llm.scratch import Scratch

WINDOW = 64
#: Bounds of the training sample: rows of each label, taken by a hash of their id. Their texts are read whole.
TOXIC_ROWS, ORDINARY_ROWS = 4000, 6000
#: Bytes of the dictionaries and of the segments that the trainer picks for the toxic one; folds of the calibration.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, FOLDS = 16_384, 1200, 32, 5
#: Bytes of a gram and of what is around it on each side.
GRAM, AROUND = 6, 8
#: A telling gram has so many times its share of ordinary text, in so many surroundings at least, and in so many of a million.
RATIO, LEAST, LEAST_PPM = 6.0, 8, 8.0
#: Surroundings counted for one side; of more text, those whose hash falls in an even share of all hashes.
MOST_COUNTED = 1 << 22
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BUCKETS = 1 << 24


def lowered(text: str | None) -> bytes:
    return b" " + (text or "").encode().translate(_LOWER)


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The whole text in pieces of at most `size` bytes, cut before a space where there is one."""
    at, n = 0, len(text)
    while at < n:
        stop = at + size
        if stop < n and (space := text.rfind(b" ", at + size // 2, stop)) > 0:
            stop = space
        yield text[at:stop]
        at = stop


def _rolled(a: np.ndarray, width: int, n: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _BASE + a[k : k + n] + np.uint64(1)
    return h * _MIX


def grams(text: bytes) -> np.ndarray:
    """A bucket for the gram at each place of a text."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    return (_rolled(a, GRAM, max(0, len(a) - GRAM + 1)) >> np.uint64(40)).astype(np.uint32)


def surroundings(text: bytes) -> np.ndarray:
    """A hash of the gram at each place with what is around it."""
    a = np.frombuffer(b" " * AROUND + text + b" " * AROUND, np.uint8).astype(np.uint64)
    return _rolled(a, GRAM + 2 * AROUND, max(0, len(text) - GRAM + 1))


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, rising, and in how many different surroundings their grams stand."""
    step = np.uint64(max(1, -(-sum(map(len, texts)) // MOST_COUNTED)))
    where, what = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for text in texts:
        h = surroundings(text)
        some = np.flatnonzero((h >> np.uint64(20)) % step == 0)
        where.append(h[some])
        what.append(grams(text)[some])
    _, once = np.unique(np.concatenate(where), return_index=True)
    buckets, n = np.unique(np.concatenate(what)[once], return_counts=True)
    return buckets, n * int(step)


def telling(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Which buckets are much more frequent in toxic than in ordinary texts."""
    (buckets, one), (known, two) = gram_counts(toxic), gram_counts(ordinary)
    n_one, n_two = max(1, int(one.sum())), max(1, int(two.sum()))
    many = one >= max(LEAST, LEAST_PPM * n_one / 1e6)
    buckets, one = buckets[many], one[many]
    at = np.minimum(np.searchsorted(known, buckets), max(0, len(known) - 1))
    other = np.where(known[at] == buckets, two[at], 0) if len(known) else np.zeros(len(buckets))
    marked = np.zeros(_BUCKETS, bool)
    marked[buckets[(one + 0.5) / n_one > RATIO * (other + 0.5) / n_two]] = True
    return marked


def passages(text: bytes, marked: np.ndarray) -> list[bytes]:
    """The different runs of marked grams of a text; a gram has white space at its ends only."""
    if len(text) < GRAM:
        return []
    blank = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) <= 32)))
    n = len(text) - GRAM + 1
    ok = marked[grams(text)] & (blank[GRAM - 1 : GRAM - 1 + n] == blank[1 : 1 + n])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(np.int8), [0]))))
    found = {text[a : b + GRAM - 1].rstrip() for a, b in edge.reshape(-1, 2).tolist()}
    return sorted(found, key=lambda p: (zlib.crc32(p), p))  # no order by content: neighbours make up segments


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains; the last samples themselves where they are too few to train on."""
    import zstandard

    try:
        made = zstandard.train_dictionary(size, samples, k=segment, d=GRAM).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]
    # The content follows the entropy tables, which end with the three first repeat offsets.
    return made[made.index(np.array([1, 4, 8], "<u4").tobytes()) + 12 :]


def learn_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of lowered() texts. Both begin with what was trained on ordinary windows."""
    base = trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES, 50)
    marked = telling(toxic, ordinary)
    # The trainer doesn't look at the last bytes of a sample.
    apart = [b"".join(p) + b" " * 8 for t in toxic if (p := passages(t, marked))]
    extra = trained(apart, TOXIC_BYTES, SEGMENT) if apart else b" " * 8
    return base + extra, base + bytes(len(extra))


@lru_cache(maxsize=2 * FOLDS + 2)
def _compressor(dictionary: bytes):
    import zstandard

    how = zstandard.ZstdCompressionParameters(window_log=16, chain_log=15, hash_log=15, search_log=6, min_match=5, strategy=zstandard.STRATEGY_LAZY2, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def window_lengths(text: str | None, toxic: bytes, ordinary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Compressed bytes of each window with the ordinary and with the toxic dictionary."""
    one, two = _compressor(ordinary).compress, _compressor(toxic).compress
    cut = list(windows(lowered(text)))
    return np.array([len(one(w)) for w in cut]), np.array([len(two(w)) for w in cut])


STEPS = (1, 2, 3, 4, 5, 6, 8)
#: Places of features in a row of features().
SHARES, RATIO_AT, LENGTH = slice(3, 3 + len(STEPS)), 3 + len(STEPS), 5 + len(STEPS)


def features(texts: list[str | None], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """What the toxic dictionary saves over a text's windows, against the ordinary one.

    The most bytes in a window, all bytes and those above one for each length;
    the shares of windows that save STEPS bytes or more; the ordinary ratio of
    compression; the spread of the savings; the length; and what is lost.
    """
    out = np.zeros((len(texts), len(STEPS) + 7))
    for i, text in enumerate(texts):
        plain, other = window_lengths(text, toxic, ordinary)
        saved = plain - other
        n, m = len((text or "").encode()) + 101, len(saved) + 2
        out[i] = saved.max(), 100 * saved.sum() / n, 100 * np.maximum(saved - 1, 0).sum() / n, *((saved >= k).sum() / m for k in STEPS), plain.sum() / n, saved.std(), np.log(n), 100 * np.minimum(saved, 0).sum() / n
    return out


class Model:
    """The two dictionaries and the calibrated curve; `rate`, the score of all texts, where only one label was learned."""

    def __init__(self, rate: float, toxic: bytes = b"", ordinary: bytes = b"", x: np.ndarray | None = None, y: np.ndarray | None = None):
        self.rate, self.toxic, self.ordinary, self.ready = rate, toxic, ordinary, x is not None
        if x is None:
            return
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self._design(x)
        self.curve = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(x.shape[1])
            self.curve += np.linalg.solve(hess, x.T @ (y - p) - 0.3 * self.curve)
        z = x @ self.curve
        order = np.argsort(-z, kind="stable")
        right = np.cumsum(y[order])
        f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
        # The best one alone hangs on single texts: of those about as good, the lowest loses the fewest toxic texts.
        best = int(np.flatnonzero(f1 >= f1.max() - 0.01)[-1])
        self.threshold = float(z[order[best]]) - 1e-9

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        signs = z[:, : SHARES.stop]
        return np.column_stack((np.ones(len(z)), z, z[:, :3] ** 2, signs * z[:, LENGTH, None], signs * z[:, RATIO_AT, None]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text; 0.5 is the calibrated threshold."""
        if not self.ready:
            return np.full(len(texts), self.rate)
        z = self._design(features(texts, self.toxic, self.ordinary)) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z - self.threshold, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, fold, text: whole texts of TOXIC_ROWS and ORDINARY_ROWS rows at most that `labels` (doc_id, toxic) marks with 1 or 0."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).distinct()
    count = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000))
    most = {0: ORDINARY_ROWS, 1: TOXIC_ROWS}
    # A little more than the bound by hash, so that few rows are sorted for the exact one.
    picked = [marked.where((F.col("label") == k) & (place < int(min(1.0, 1.2 * n / max(1, count.get(k, 0))) * 1_000_000))).orderBy(place, "id").limit(n) for k, n in most.items()]
    rows = docs.select("doc_id", "text").join(picked[0].unionByName(picked[1]), F.col("doc_id") == F.col("id")).where("text IS NOT NULL")
    return rows.select("label", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of `docs` (doc_id, text) whose id `labels` (doc_id, toxic) marks with 0 or 1; other columns are not read.

    The driver holds the texts of the bounded sample while it trains
    dictionaries; all compression for the calibration runs in the executors.
    Without rows of both labels the model scores all texts alike.
    """
    spark = docs.sparkSession
    sample = Scratch(spark, "toxicity").save(training_sample(docs, labels), "sample")
    sides: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for label, fold, text in sample.toLocalIterator():
        sides[label].append((fold, lowered(text)))
    for side in sides.values():
        side.sort()
    rate = (len(sides[1]) + 0.5) / (len(sides[1]) + len(sides[0]) + 1)
    if not sides[0] or not sides[1]:
        return Model(rate)
    # Each fold is measured with dictionaries of the others: the curve must not see what they learned.
    pairs = [learn_dictionaries(*([t for f, t in sides[k] if f != fold] or [t for _, t in sides[k]] for k in (1, 0))) for fold in range(FOLDS)]
    whole = learn_dictionaries(*([t for _, t in sides[k]] for k in (1, 0)))
    sides.clear()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches):
            texts = batch.column("text").to_pylist()
            found = [features([t], *pairs[f])[0].tolist() for t, f in zip(texts, batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    measured = sample.repartition(spark.sparkContext.defaultParallelism).mapInArrow(wordhash.tidy(rows), "label int, x array<double>")
    held = sorted((r["label"], *r["x"]) for r in measured.collect())
    table = np.array(held)
    return Model(rate, *whole, table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of `docs` (doc_id, text); other columns are not read.

    Null texts count as empty. Every row gives a row, equal texts equal scores;
    an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.score(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(wordhash.tidy(rows), "doc_id long, score double")
