"""MinHash near-duplicate groups of documents (operator 2).

1. Every text gets a signature of universal hash minima over its distinct
   5-word shingles, and band keys of `ROWS` minima each.
2. Texts with equal sets collapse to one node, a 64-bit key that no other set
   has; the smallest id among them stands for it.
3. Every node is paired with the smallest centre of its band buckets, a bucket's
   centre being its smallest member; then with the centres of all its buckets
   that are not in its component yet. Pairs pass a signature check, then an
   exact comparison of full shingle sets. Components of these links follow.
4. Buckets whose members are still in several components are compared in full,
   block against block by signatures, leaving out members of the bucket's
   largest component among themselves: they are connected already. Blocks hold
   members of like set size, and only blocks of the same or the next class of
   sizes meet, since others can't be similar. So every pair that shares a bucket
   is either compared, connected already, or too different in size, and no step
   lists all pairs of a group of copies.
5. The smallest id of a component labels all its texts. Where an id comes with
   several sets, links of nodes become links of ids, and components of ids follow.

With 40 bands of 5 minima a pair at similarity 0.75 shares no band with
probability 2e-5, one at 0.85 with 3e-11.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import wordhash
from mapweave.llm.components import connected_components
from mapweave.llm.scratch import Scratch

BANDS, ROWS = 40, 5
#: Minima of a signature; the first BANDS * ROWS also make the band keys.
MINIMA = 512
#: Pairs whose share of equal signature bytes is lower are dropped: 0.75 less four standard errors of MINIMA minima.
LEAST_ESTIMATE = 0.67
#: Members in a block of step 4, and how much larger than the last a class of set sizes begins: two similar sets are in the same or neighbouring ones.
BLOCK, CLASS = 128, 100 / 75
#: Most bits of the filter that keeps unneeded texts out of a shuffle, which bounds what is broadcast to 16 bytes for 64 bits; more ids than an eighth take none.
FILTER_BITS = 1 << 26
_U = np.uint64


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift functions ((a * x + b) mod 2^64) >> 32 of 32-bit x."""
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, n, dtype=_U) * _U(2) + _U(1), rng.integers(0, 1 << 63, n, dtype=_U)


def minima(sets: list[np.ndarray], n: int, cache: int = 1 << 15) -> np.ndarray:
    """n minima for each of the non-empty sets: a matrix of 32-bit values, one row a set."""
    a, b = _families(n)
    out = np.zeros((len(sets), n), np.uint32)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= cache):
            size += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[start:stop]) >> _U(32)
        cuts = np.cumsum([0] + [len(s) for s in sets[start : stop - 1]])
        v = np.empty_like(x)
        for k in range(n):
            np.multiply(x, a[k], out=v)
            v += b[k]
            out[start:stop, k] = np.minimum.reduceat(v, cuts) >> _U(32)
        start = stop
    return out


def print_of(shingles: np.ndarray) -> bytes:
    """A digest of a set, equal for equal sets only."""
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in wordhash.chunks(batches):
        data, at = wordhash.utf8(batch.column("text"))
        sets = list(wordhash.shingle_sets(data, at))
        sizes = np.array([len(s) for s in sets])
        full = np.flatnonzero(sizes)
        m = minima([sets[i] for i in full], MINIMA)
        keys = np.zeros((len(full), BANDS), np.int64)
        for k in range(BANDS):
            h = np.full(len(full), k + 1, _U)
            for r in range(ROWS):
                h = wordhash.mix(h * wordhash._STEP[r] + m[:, k * ROWS + r])
            keys[:, k] = h.view(np.int64)
        signed, bands, packed, prints = ([None] * len(sets) for _ in range(4))
        small = m.astype(np.uint8)
        for row, i in enumerate(full.tolist()):
            signed[i], bands[i], packed[i] = small[row].tobytes(), keys[row], keys[row].tobytes()
            prints[i] = print_of(sets[i])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array(signed, pa.binary())],
            names=["doc_id", "n_shingles", "print", "bands", "keys", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in wordhash.chunks(batches):
        data, at = wordhash.utf8(batch.column("text"))
        sets = list(wordhash.shingle_sets(data, at))
        yield pa.RecordBatch.from_arrays([pa.array([print_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["print", "set"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures agree well enough."""
    for batch in batches:
        if batch.num_rows:
            one, two = (wordhash.utf8(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            small, large = (f(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) for f in (np.minimum, np.maximum))
            ok = ((one == two).mean(axis=1) >= LEAST_ESTIMATE) & (100 * small >= 75 * large)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with 100 * intersection >= 75 * union of the full sets."""
    for batch in batches:
        (one, at1), (two, at2) = (wordhash.utf8(batch.column(c)) for c in ("set_a", "set_b"))
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = one[at1[i] : at1[i + 1]].view(_U), two[at2[i] : at2[i + 1]].view(_U)
            where = np.searchsorted(a, b)
            where[where == len(a)] = 0
            shared = int((a[where] == b).sum()) if len(a) else 0
            ok[i] = shared and 100 * shared >= 75 * (len(a) + len(b) - shared)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))


def _blocks_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose signatures agree, of two blocks of a bucket.

    Of the buckets that a pair shares, the one of the first band gives the pair.
    """
    for batch in batches:
        left, right = [], []
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            a, b = row["one"], row["two"]
            sig_a, sig_b = (np.frombuffer(b"".join(m["sig"] for m in s), np.uint8).reshape(len(s), -1) for s in (a, b))
            keys_a, keys_b = (np.frombuffer(b"".join(m["keys"] for m in s), np.int64).reshape(len(s), -1) for s in (a, b))
            id_a, id_b, comp_a, comp_b, n_a, n_b = (np.array([m[k] for m in s]) for k in ("id", "comp", "n") for s in (a, b))
            for i in range(len(a)):
                ok = (comp_b != comp_a[i]) & (100 * np.minimum(n_a[i], n_b) >= 75 * np.maximum(n_a[i], n_b))
                if row["same"]:
                    ok &= id_b > id_a[i]
                if ok.any():
                    near = np.flatnonzero(ok)
                    near = near[(sig_b[near] == sig_a[i]).mean(axis=1) >= LEAST_ESTIMATE]
                    near = near[keys_a[i][(keys_b[near] == keys_a[i]).argmax(axis=1)] == row["key"]]
                    left += [int(id_a[i])] * len(near)
                    right += id_b[near].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _only(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of `docs` whose doc_id is among the n different ones in `ids` (doc_id).

    A bit map of eight bits an id goes to all tasks and leaves few other texts;
    the semi-join on what passes is exact. Beyond the bound of the map there is
    the join alone.
    """
    bits = 1 << max(16, math.ceil(math.log2(8 * max(1, n))))
    if bits <= FILTER_BITS:
        word, mask = f"cast(pmod(xxhash64(doc_id), {bits}) div 64 AS int)", "shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) AS int))"
        held = ids.select(F.expr(word).alias("word"), F.expr(mask).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))
        docs = docs.join(F.broadcast(held), F.expr(word) == F.col("word")).where(F.expr(f"held & {mask} <> 0")).select("doc_id", "text")
    return docs.join(ids, "doc_id", "left_semi")


class _Texts:
    """Where the sets of nodes come from: the texts of the ids that stand for them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, salt: int, repeated: bool):
        self.docs, self.nodes, self.salt, self.repeated = docs, nodes, salt, repeated

    def sets(self, ids: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
        """id and set of each of the nodes in `ids` (id)."""
        of = scratch.save(self.nodes.join(ids, "id", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), f"{tag}-of")
        found = _only(self.docs, of, of.count()).mapInArrow(wordhash.tidy(_sets), "print binary, set binary").select(_key(self.salt).alias("id"), "set")
        if self.repeated:  # an id may have texts of several nodes, and a text several rows
            found = found.join(ids, "id", "left_semi").groupBy("id").agg(F.any_value("set").alias("set"))
        return scratch.save(found, f"{tag}-sets")


def _key(salt: int) -> Column:
    return F.xxhash64("print", F.lit(salt))


def _nodes(real: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(print, id, rep, copies) of every different set, and the salt of the keys: one by which no two sets share a key."""
    groups = scratch.save(real.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "groups")
    salt = 0
    while not groups.groupBy(_key(salt).alias("id")).count().where("count > 1").isEmpty():
        salt += 1
    return groups.withColumn("id", _key(salt)), salt


def _links(pairs: DataFrame, texts: _Texts, scratch: Scratch, tag: str) -> DataFrame:
    """Those of the distinct pairs (a, b) that hold on the full sets. Only texts in pairs are read into sets."""
    pairs = scratch.save(pairs, f"{tag}-pairs")
    ids = scratch.save(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{tag}-ids")
    sets = texts.sets(ids, scratch, tag)
    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    full = full.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    links = scratch.save(full.select("a", "b", "set_a", "set_b").mapInArrow(wordhash.tidy(_confirm), "a long, b long"), f"{tag}-links")
    scratch.drop(*(f"{tag}-{t}" for t in ("sets", "pairs", "ids", "of")))
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text; other columns are not read).

    Null and empty texts, and texts without words, have no shingles and no
    links. Rows that share a doc_id count as one document with the links of
    all, whether their texts are equal or not. A row without doc_id takes no
    part: its component_id is null and it is kept. An empty table gives an
    empty one.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select("doc_id", "text")
    signed = scratch.save(docs.mapInArrow(wordhash.tidy(_sign), "doc_id long, n_shingles long, print binary, bands array<long>, keys binary, sig binary"), "signed")
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    repeated = not signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()

    nodes, salt = _nodes(real, scratch)
    texts = _Texts(docs, nodes, salt, repeated)
    reps = real.join(nodes.select(F.col("rep").alias("doc_id"), "print", "id"), ["doc_id", "print"]).select("id", F.col("n_shingles").alias("n"), "bands", "keys", "sig")
    reps = scratch.save(reps.dropDuplicates(["id"]) if repeated else reps, "reps")

    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = scratch.save(banded.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1"), "buckets")
    star = banded.join(buckets.select(F.col("key").alias("k"), "centre", "size"), F.col("key") == F.col("k"))
    star = scratch.save(star.select("key", "id", "centre", "size"), "members")
    sigs = reps.select("id", "n", "sig")
    found, links = None, None
    first_centre = star.groupBy("id").agg(F.min("centre").alias("centre")).where("id <> centre")
    for tag, step in (("first", lambda: _centres(first_centre, sigs)), ("rest", lambda: _centres(_apart(star, found), sigs)), ("across", lambda: _across(star, found, reps.drop("bands"), scratch))):
        new = _links(step(), texts, scratch, tag).select(F.col("b").alias("u"), F.col("a").alias("v"))
        if found is None or not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            found = scratch.save(connected_components(links, scratch, f"cc-{tag}"), f"found-{tag}")
            links = found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    scratch.drop("members", "buckets", "reps")
    none, real = signed.where("doc_id IS NULL OR n_shingles = 0"), signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    if repeated:
        labels = _labels_of_ids(real, nodes, links, scratch)
        out = signed.where("doc_id IS NOT NULL").join(labels, "doc_id", "left")
        none = signed.where("doc_id IS NULL")
    else:
        out = real.join(_labels_of_nodes(nodes, links, scratch), "print", "left")
    row = lambda of: ("doc_id", "n_shingles", of.alias("component_id"), of.eqNullSafe(F.col("doc_id")).alias("kept"))
    return out.select(*row(F.coalesce("component", "doc_id"))).unionByName(none.select(*row(F.col("doc_id"))))


def _labels_of_nodes(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(print, component): the smallest id of each node's component, of nodes that have copies or links. Each id has one node."""
    of = links.unionByName(links.select(F.col("v").alias("u"), "v").distinct())
    held = nodes.join(of.select(F.col("u").alias("id"), F.col("v").alias("centre")), "id", "left").where("copies > 1 OR centre IS NOT NULL")
    held = scratch.save(held.select("print", "rep", F.coalesce("centre", "id").alias("centre")), "held")
    least = held.groupBy("centre").agg(F.min("rep").alias("component"))
    return scratch.save(held.join(least, "centre").select("print", "component"), "labels")


def _labels_of_ids(real: DataFrame, nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, component) where ids may have several nodes: components of ids, which join the nodes of an id."""
    copies = nodes.where("copies > 1").select(F.col("print").alias("p"), "rep")
    copies = real.select("doc_id", "print").join(copies, F.col("print") == F.col("p")).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    named = links.join(nodes.select(F.col("id").alias("u"), F.col("rep").alias("one")), "u").join(nodes.select(F.col("id").alias("v"), F.col("rep").alias("two")), "v")
    found = scratch.save(connected_components(copies.unionByName(named.select(F.col("one").alias("u"), F.col("two").alias("v"))), scratch, "cc-ids"), "found-ids")
    return found.where("node <> component").select(F.col("node").alias("doc_id"), "component")


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """(id, centre): members with those of their buckets' centres that are in another component."""
    labels = found.where("node <> component")
    own = members.where("id <> centre").select("id", "centre").distinct().join(labels.select(F.col("node").alias("id"), F.col("component").alias("own")), "id", "left")
    both = own.join(labels.select(F.col("node").alias("centre"), F.col("component").alias("its")), "centre", "left")
    return both.where(F.coalesce("own", "id") != F.coalesce("its", "centre")).select("id", "centre")


def _centres(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those pairs (id, centre) whose signatures agree, as (a, b)."""
    pairs = pairs.select(F.col("id").alias("b"), F.col("centre").alias("a"))
    pairs = pairs.join(sigs.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    pairs = pairs.join(sigs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
    return pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(wordhash.tidy(_alike), "a long, b long")


def _across(members: DataFrame, found: DataFrame, sigs: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) of different components in the same bucket."""
    labelled = members.where("size > 2").join(found.where("node <> component").select(F.col("node").alias("id"), "component"), "id", "left")
    labelled = labelled.select("key", "id", F.coalesce("component", "id").alias("comp"))
    counts = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    mixed = scratch.save(mixed.select(F.col("key").alias("k"), "largest"), "mixed")
    inside = labelled.join(mixed, F.col("key") == F.col("k")).select("key", "id", "comp", (F.col("comp") != F.col("largest")).alias("rest"))
    level = F.floor(F.log("n") / math.log(CLASS)).cast("int")
    inside = scratch.save(inside.join(sigs.select("id", "n"), "id").select("key", "id", "comp", "rest", level.alias("level")), "inside")
    group = ["key", "rest", "level"]
    sizes = scratch.save(inside.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "sizes")
    placed = inside.join(sizes, group).join(sigs, "id").select(*group, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.struct("id", "comp", "n", "sig", "keys").alias("member"))
    full = scratch.save(placed.groupBy(*group, "part").agg(F.collect_list("member").alias("held")), "blocks")
    # A block of the rest meets all blocks of the largest component of about its size, itself, and those of the rest that come after it.
    lists = sizes.groupBy("key").agg(F.collect_list(F.struct("rest", "level", "parts")).alias("groups"))
    near = F.filter("groups", lambda g: F.abs(g["level"] - F.col("level")) <= 1)
    blocks = F.flatten(F.transform(near, lambda g: F.transform(F.sequence(F.lit(0), g["parts"] - 1), lambda p: F.struct(g["rest"].alias("rest"), g["level"].alias("level"), p.alias("part")))))
    own = F.struct("rest", "level", "part")
    left = full.where("rest").join(lists, "key").select("key", own.alias("own"), F.col("held").alias("one"), F.explode(F.filter(blocks, lambda b: ~b["rest"] | (b >= own))).alias("with"))
    both = left.join(full.select("key", own.alias("with"), F.col("held").alias("two")), ["key", "with"])
    return both.select("key", (F.col("own") == F.col("with")).alias("same"), "one", "two").mapInArrow(wordhash.tidy(_blocks_alike), "a long, b long").distinct()
