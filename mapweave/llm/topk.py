"""Exact top-k inner-product search by best-first walks of M-trees (operator 5).

Vectors are made whole numbers, floor(256 * x). A shard of them becomes one
M-tree: pages of entries, each with its distance to the page's routing vector,
and in inner pages a covering radius and a child page. The metric is Euclidean
after one more component, sqrt(R^2 - |v|^2) with R the shard's largest norm, so
that nearer means a larger inner product with any query, whose component is 0.

A search keeps a queue of pages by the least distance that anything below can
have. Entries whose stored parent distance already puts them beyond the k-th
result, by the triangle inequality, are passed over without a distance. Scores
are exact whole numbers; bounds have slack, so rounding can't lose a result.

One tree is searched first. Its k-th scores are lower bounds of the final ones,
and the other trees' searches start from them.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.llm import wordhash
from mapweave.llm.scratch import Scratch

PAGE, SHARD_ROWS = 512, 16_384
#: Queries that one pass over the trees answers: bounds what is sent to the tasks.
PASS_QUERIES = 20_000
SLACK = 1e-6
_PAGE = "struct<leaf: boolean, ids: binary, vectors: binary, parent: binary, radius: binary>"
INDEX = f"tree string, size double, width int, pages array<{_PAGE}>"


def whole(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of each vector as a row of doubles, shorter ones filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


class Tree:
    """Pages in memory; page 0 is the root."""

    def __init__(self, pages: list[dict], size: float):
        self.pages, self.size = pages, size
        #: Distances that searches have computed so far.
        self.computed = 0

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray) -> "Tree":
        norms = (vectors**2).sum(axis=1)
        top = float(norms.max(initial=0))
        points = np.column_stack((vectors, np.sqrt(np.maximum(top - norms, 0))))
        rng, pages = np.random.default_rng(11), []

        def page(rows: np.ndarray, routing: int | None) -> int:
            at = len(pages)
            pages.append(None)
            from_parent = (lambda r: np.zeros(len(r))) if routing is None else lambda r: np.sqrt(((points[r] - points[routing]) ** 2).sum(axis=1))
            if len(rows) <= PAGE:
                pages[at] = {"leaf": True, "ids": ids[rows], "vectors": vectors[rows], "parent": from_parent(rows), "radius": np.zeros(len(rows))}
                return at
            seeds = np.sort(rng.choice(rows, min(PAGE // 2, -(-len(rows) // (PAGE // 2))), replace=False))
            far = (points[rows] ** 2).sum(axis=1)[:, None] + (points[seeds] ** 2).sum(axis=1) - 2 * points[rows] @ points[seeds].T
            group = far.argmin(axis=1)
            if np.bincount(group).max() == len(rows):  # equal vectors
                group = np.arange(len(rows)) * len(seeds) // len(rows)
            groups = [(int(s), rows[group == k]) for k, s in enumerate(seeds) if (group == k).any()]
            reach = [float(np.sqrt(((points[r] - points[s]) ** 2).sum(axis=1).max())) for s, r in groups]
            routes = np.array([s for s, _ in groups])
            children = np.array([page(r, s) for s, r in groups])
            pages[at] = {"leaf": False, "ids": children, "vectors": vectors[routes], "parent": from_parent(routes), "radius": np.array(reach)}
            return at

        if len(ids):
            page(np.arange(len(ids)), None)
        return Tree(pages, top)

    def search(self, query: np.ndarray, own: int, k: int, bound: float = -np.inf) -> list[tuple[int, int]]:
        """The k highest (score, id), ties to smaller ids; without id `own`. Scores below `bound` may be left out."""
        if not self.pages:
            return []
        square = float(query @ query) + self.size
        scores, ids, least = np.zeros(0), np.zeros(0, np.int64), bound
        beyond = lambda: np.sqrt(max(square - 2 * least, 0.0)) * (1 + SLACK) + SLACK
        reach = beyond() if least > -np.inf else np.inf  # nothing farther can be a result
        queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while queue:
            nearest, at, parent = heapq.heappop(queue)
            if nearest > reach:
                break
            page = self.pages[at]
            near = slice(None)
            if parent >= 0 and reach < np.inf:
                near = np.flatnonzero(np.abs(parent - page["parent"]) - page["radius"] <= reach)
                if not len(near):
                    continue
            inner = page["vectors"][near] @ query
            self.computed += len(inner)
            if page["leaf"]:
                held = page["ids"][near]
                ok = (inner >= least) & (held != own)
                if ok.any():
                    scores, ids = np.concatenate((scores, inner[ok])), np.concatenate((ids, held[ok]))
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    if len(scores) == k:
                        least = max(bound, scores[-1])
                        reach = beyond()
            else:
                far = np.sqrt(np.maximum(square - 2 * inner, 0))
                low = far - page["radius"][near]
                for i in np.flatnonzero(low <= reach):
                    heapq.heappush(queue, (max(0.0, low[i] - SLACK * (1 + far[i])), int(page["ids"][near][i]), float(far[i])))
        return [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def tree() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        vectors = whole(table.column("embedding"))
        made = Tree.build(table.column("vec_id").to_numpy().astype(np.int64), vectors)
        kinds = {"ids": np.int64, "vectors": np.float64, "parent": np.float64, "radius": np.float64}
        pages = [{"leaf": p["leaf"]} | {c: np.ascontiguousarray(p[c], t).tobytes() for c, t in kinds.items()} for p in made.pages]
        kind = pa.list_(pa.struct([("leaf", pa.bool_()), *((c, pa.binary()) for c in kinds)]))
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([made.size]), pa.array([vectors.shape[1]], pa.int32()), pa.array([pages], kind)], names=["tree", "size", "width", "pages"])

    for batch in batches:
        for start in range(0, batch.num_rows, SHARD_ROWS):
            held.append(batch.slice(start, SHARD_ROWS))
            if sum(b.num_rows for b in held) >= SHARD_ROWS:
                yield tree()
                held.clear()
    if held:
        yield tree()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows with an id and a vector of finite components only."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & real)


def build_index(vectors: DataFrame) -> DataFrame:
    """One row for each M-tree over the usable rows of `vectors` (vec_id, embedding). Save it before searching it."""
    return usable(vectors).mapInArrow(wordhash.tidy(_build), INDEX)


def _search(queries: list[tuple[int, list[float], float]], k: int):
    """queries: id, vector of whole numbers, and a score that the k-th result has at least."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"ids": np.int64, "vectors": np.float64, "parent": np.float64, "radius": np.float64}
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                width = row["width"]
                pages = [{"leaf": p["leaf"]} | {c: np.frombuffer(p[c], t) for c, t in kinds.items()} for p in row["pages"]]
                for p in pages:
                    p["vectors"] = p["vectors"].reshape(len(p["ids"]), width)
                tree, out = Tree(pages, row["size"]), []
                for own, vector, bound in queries:
                    query = np.zeros(width)
                    query[: len(vector[:width])] = vector[:width]
                    out += [(own, i, s) for s, i in tree.search(query, own, k, bound)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], names=["query_id", "vec_id", "score"])

    return wordhash.tidy(rows)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to smaller vec_id.

    `vectors` and `queries` have vec_id and embedding. Rows without id, without
    vector, or with a null or non-finite component take no part. Missing
    components of a shorter vector count as zero. A query's own row is any row
    with its id; a query id that is repeated is asked once, with the least of
    its vectors, while repeated candidate rows count each. A query without candidates has no rows. Components of up to
    2^20 in size give exact scores.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "m-tree")
    index = scratch.save(build_index(vectors), "trees")
    asked = usable(queries).select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x).cast("double")).alias("embedding"))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    passes = asked.count() // PASS_QUERIES + 1
    head = index.agg(F.min("tree").alias("tree")).first()["tree"]
    kind, found = "query_id long, vec_id long, score long", None
    for p in range(passes):
        block = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p)
        queries = [(r[0], list(r[1])) for r in block.collect()]
        first = scratch.save(index.where(F.col("tree") == F.lit(head)).mapInArrow(_search([(*q, -np.inf) for q in queries], k), kind), f"pass-{p}-first")
        kth = {r["query_id"]: r["least"] for r in first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        rest = index.where(F.col("tree") != F.lit(head)).mapInArrow(_search([(*q, float(kth.get(q[0], -np.inf))) for q in queries], k), kind)
        part = first.unionByName(scratch.save(rest, f"pass-{p}"))
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
