"""Language identification by error-correcting output codes (operator 10).

Every learned language has a codeword of bits. Each bit has a binary n-gram
classifier: the log-odds of hashed byte n-grams (1 to 4 bytes) between the
languages whose bit is 1 and those whose bit is 0, from counts over all training
rows. A text's mean log-odds for each bit are compared with every codeword:
the loss exp(-margin) of each bit, weighted by how reliable the bit was for that
language on training rows, adds up to a distance. The nearest codeword wins; a
text whose two nearest codewords are about as far is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType

from mapweave.llm import wordhash

BUCKETS, GRAMS, SMOOTH = 1 << 15, 4, 0.5
#: Rows on which the weights of bits are measured: a sample of the training rows by a hash of their id.
WEIGHT_ROWS = 4000
#: Mean log-odds are multiplied by this before the loss, and cut off at +-CLIP.
SHARP, CLIP = 4.0, 3.0
#: A text is ambiguous if its two best shares differ by less.
AMBIGUOUS = 0.10


def codewords(n: int) -> np.ndarray:
    """n codewords of +-1, far apart: the exhaustive code up to 7 languages, else random rows.

    With b bits, two words of the exhaustive code differ in (b + 1) / 2 of them,
    and of the random one in b / 4 at least, so that (b / 4 - 1) / 2 wrong bits
    do no harm.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        columns = np.arange(1, 1 << (n - 1))
        # The first language has 1 throughout; no column or its complement repeats.
        return np.vstack([np.ones(len(columns)), *(np.where(columns >> k & 1, -1.0, 1.0) for k in range(n - 1))])
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(n)))
    while True:
        words: list[np.ndarray] = []
        while len(words) < n:
            word = rng.choice([-1.0, 1.0], bits)
            if all((word != w).sum() >= bits // 4 for w in words):
                words.append(word)
        m = np.array(words)
        if (np.abs(m.sum(axis=0)) < n).all():  # every bit parts the languages
            return m


def gram_buckets(low: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For n of 1 to GRAMS, a bucket for each byte's n-gram; BUCKETS where it would leave its text."""
    h = np.zeros(len(low), np.uint32)
    last = np.repeat(at[1:], np.diff(at)) - np.arange(len(low))
    for n in range(1, GRAMS + 1):
        h = h * np.uint32(0x01000193)
        h[: len(low) - n + 1] += low[n - 1 :]
        mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
        yield np.where(last >= n, mixed >> np.uint32(17), BUCKETS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in wordhash.chunks(batches):
        data, at = wordhash.utf8(batch.column("text"))
        low, size = wordhash.LOWER[data], np.diff(at)
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        of = np.repeat(np.array([names.index(x) for x in langs]), size)
        seen = np.zeros((len(names), BUCKETS + 1), np.int64)
        for bucket in gram_buckets(low, at):
            seen += np.bincount(of * (BUCKETS + 1) + bucket, minlength=seen.size).reshape(seen.shape)
        for name, row in zip(names, seen, strict=True):
            total[name] = total.get(name, 0) + row[:BUCKETS]
    for name, row in total.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(row[some], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """Languages, their codewords, the bit classifiers' n-gram weights, and the bits' weights for each language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        n = np.array([counts[x] for x in self.langs]).reshape(len(self.langs), BUCKETS)
        share = (n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
        self.weights = np.zeros((self.code.shape[1], BUCKETS + 1), np.float32)
        for b in range(self.code.shape[1]):
            yes = self.code[:, b] > 0
            self.weights[b, :BUCKETS] = np.log(share[yes].mean(axis=0)) - np.log(share[~yes].mean(axis=0))
        self.bits = np.full(self.code.shape, 1 / max(1, self.code.shape[1]))

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean log-odds of each text for each bit; 0 for an empty text. One bit at a time, so memory doesn't grow with the languages."""
        out = np.zeros((len(at) - 1, self.code.shape[1]))
        size = np.diff(at)
        some = np.flatnonzero(size)
        if not len(some) or not out.shape[1]:
            return out
        low = wordhash.LOWER[data]
        for bucket in gram_buckets(low, at):
            for b, weights in enumerate(self.weights):
                out[some, b] += np.add.reduceat(weights[bucket], at[some], dtype=np.float64)
        out[some] /= GRAMS * size[some, None]
        return out

    def weigh(self, hits: np.ndarray, rows: np.ndarray) -> None:
        """Bit weights from how often each bit was right for each language."""
        right = (hits + 1) / (rows[:, None] + 2)
        self.bits = right / right.sum(axis=1, keepdims=True) if right.size else right

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the confidence, and whether the second is about as near."""
        z = np.clip(SHARP * margins, -CLIP, CLIP)
        far = (np.exp(-z[:, None, :] * self.code[None]) * self.bits[None]).sum(axis=2)
        share = np.exp(-4 * (far - far.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        second = order[:, -2] if share.shape[1] > 1 else 0.0
        return share.argmax(axis=1), order[:, -1], order[:, -1] - second < AMBIGUOUS


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = data | 0x20
    run = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))))
    out = run[at[1:]] > run[at[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _bit_hits(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches):
            right = (np.sign(model.margins(*wordhash.utf8(batch.column("text")))) == model.code[[model.langs.index(x) for x in batch.column("lang").to_pylist()]]).astype(int)
            yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), pa.array(right.tolist(), pa.list_(pa.int32()))], names=["lang", "hits"])

    return rows


def train(docs: DataFrame) -> Model:
    """A model of all rows of `docs` (doc_id, text, lang) with text and lang.

    The driver gets a count for each language and n-gram bucket, and the bits'
    hits on WEIGHT_ROWS rows: both don't grow with the input.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = rows.select("text", "lang").mapInArrow(wordhash.tidy(_counts), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    held: dict[str, np.ndarray] = {}
    for lang, bucket, n in counts.collect():
        held.setdefault(lang, np.zeros(BUCKETS))[bucket] = n
    model = Model(held)
    if model.code.shape[1]:
        share = min(1.0, WEIGHT_ROWS / max(1, rows.select("lang").count()))
        sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).where(F.octet_length("text") > 0)
        hits = sample.where(F.col("lang").isin(model.langs)).mapInArrow(wordhash.tidy(_bit_hits(model)), "lang string, hits array<int>")
        per = hits.groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(F.get("hits", F.lit(b))).alias(f"b{b}") for b in range(model.code.shape[1]))).collect()
        found, n = np.zeros(model.code.shape), np.zeros(len(model.langs))
        for row in per:
            k = model.langs.index(row["lang"])
            n[k], found[k] = row["n"], [row[f"b{b}"] for b in range(found.shape[1])]
        model.weigh(found, n)
    return model


def _found(texts: pa.Array, model: Model) -> tuple[pa.Array, pa.Array, pa.Array]:
    """lang_pred, score and ambiguous of each text."""
    data, at = wordhash.utf8(texts)
    known = has_letter(data, at) & bool(model.langs)
    pred, score, unsure = np.full(len(known), "und", object), np.zeros(len(known)), np.zeros(len(known), bool)
    if known.any():
        k, share, flag = model.decode(model.margins(data, at))
        pred[known], score[known], unsure[known] = np.array(model.langs, object)[k][known], share[known], flag[known]
    return pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of `docs` (doc_id, text); other columns are not read.

    Texts that are null or have no letter, and all texts if no language was
    learned, get 'und' and score 0. Of codewords that are equally near, the
    first in the order of the languages' names wins, and the text is ambiguous.
    Repeated rows each give a row; an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordhash.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *_found(batch.column("text"), model)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(wordhash.tidy(rows), "doc_id long, lang_pred string, score double, ambiguous boolean")


def language(text: Column, model: Model) -> Column:
    """identify()'s lang_pred as a column: only the text goes to Python, and the rest of its row stays behind."""

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = wordhash.chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))
            yield pa.concat_arrays([pa.array([], pa.string()), *(_found(part.column(0), model)[0] for part in parts)])

    return F.arrow_udf(wordhash.tidy(column), T.StringType(), ArrowUDFType.SCALAR_ITER)(text)
