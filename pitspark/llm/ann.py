"""Approximate nearest neighbours by inner product: a hash-prefix forest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitspark.session import materialize

TREES = 12
BITS = 64
COUNTED_BITS = 24
BLOCK_ROWS = 8192
BLOCK_BYTES = 32 << 20
PART_BYTES = 16 << 20
LEAST_BLOCKS = 16
TILE = 64
SAMPLE_QUERIES = 100
TARGET_RECALL = 0.96
NEIGHBOURS = "query_id long, rank int, vec_id long, score double"
NEAR = "node long, near array<struct<below: double, least: long, found: long>>"


# --- rows -------------------------------------------------------------------

def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, packed, norm): finite non-zero vectors of any length, as bytes in double precision.

    Rows without an id take no part; rows equal in both are one.
    """
    lists = table.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"),
    ).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("v").offsets.to_numpy()
            # a null component reads as nan, and zeros lose their sign, so that equal vectors are equal bytes
            x = np.asarray(batch.column("v").values.to_numpy(zero_copy_only=False), "<f8") + 0.0
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            filled = np.concatenate([[0], np.cumsum(x != 0)])
            at = np.flatnonzero((np.diff(odd[ends]) == 0) & (np.diff(filled[ends]) > 0))
            rows = [x[ends[i]:ends[i + 1]] for i in at]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(at)), pa.array([r.tobytes() for r in rows], pa.binary()),
                pa.array([np.sqrt(r @ r) for r in rows], pa.float64())], ["vec_id", "packed", "norm"])

    return lists.mapInArrow(pack, "vec_id long, packed binary, norm double").distinct()


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(packed, ids): one row per distinct vector with its k + 1 least ids.

    Ties go to the smaller id, so of equal vectors no query needs more than these.
    Spark cuts the ranks before the shuffle, so copies never gather in one task.
    """
    rank = F.row_number().over(W.partitionBy("packed").orderBy("vec_id"))
    least = rows.select("vec_id", "packed").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return least.groupBy("packed").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _large(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so never broadcast.

    Spark judges a stored table by its compressed size on disk, and by the share that a row's columns have of it; such tables
    pass as small though they take the driver fifty times as much.
    """
    return table.hint("merge")


def _digest(packed: str = "packed") -> Column:
    return F.unhex(F.sha2(packed, 256))


def _unpack(vectors) -> np.ndarray:
    """The rows of packed vectors of one length."""
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def _by_length(packed: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
    """(places, vectors) for each length among packed vectors."""
    places: dict[int, list[int]] = {}
    for i, p in enumerate(packed):
        places.setdefault(len(p), []).append(i)
    return [(at, _unpack([packed[i] for i in at])) for at in places.values()]


# --- the forest ---------------------------------------------------------------

def hash_strings(vectors: np.ndarray, highest: float, trees: int, seed: int, query: bool) -> np.ndarray:
    """A 64-bit string per vector and tree: signs of random projections.

    A stored vector gets one more component that makes all norms equal, a query a zero
    there, so that the angle between them follows their inner product.
    """
    norm = np.linalg.norm(vectors, axis=1)
    extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, highest**2 - norm**2))
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * BITS))
    signs = (vectors @ planes[:-1] + extra[:, None] * planes[-1]) > 0
    return np.packbits(signs, axis=1).view(">i8").astype(np.int64)


def with_strings(vectors: DataFrame, highest: dict[int, float], trees: int, seed: int, query: bool) -> DataFrame:
    """``vectors`` with ``keys``, a string for each tree, and ``first``, the number of the first of these trees.

    Each length of vectors has trees of its own, numbered from length times ``trees``; ``highest`` has the
    greatest norm of each length.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys, first = np.empty((len(batch), trees), np.int64), np.empty(len(batch), np.int64)
            for at, rows in _by_length(batch.column("packed").to_pylist()):
                keys[at] = hash_strings(rows, highest[rows.shape[1]], trees, seed, query)
                first[at] = rows.shape[1] * trees
            lists = pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, trees, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first), lists], [*batch.schema.names, "first", "keys"])

    columns = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(hashed, f"{columns}, first bigint, keys array<bigint>")


def by_tree(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, tree, key) for every row and tree."""
    return rows.select(*columns, "first", F.posexplode("keys").alias("at", "key")).select(
        *columns, (F.col("first") + F.col("at")).alias("tree"), "key")


def _prefix(key: Column, length: Column) -> Column:
    """The first ``length`` bits of a string, the others zero; no bits for length 0."""
    shift = F.lit(BITS) - length
    cut = F.call_function("shiftleft", F.call_function("shiftrightunsigned", key, shift.cast("int")), shift.cast("int"))
    return F.when(length <= 0, F.lit(0).cast("long")).otherwise(cut)


def deep_counts(stored: DataFrame, cut: int, bits: int, least: int) -> DataFrame:
    """(tree, length, prefix, rows): the subtrees of at least ``least`` rows, below length ``cut`` down to ``bits``.

    A group is a subtree of length ``cut`` with its rows counted by their first ``bits`` bits, 2^(bits - cut) at most.
    """
    def count(subtree: pa.Table) -> pa.Table:
        fine = subtree.column("fine").to_numpy().view(np.uint64)
        order = np.argsort(fine)
        fine, n = fine[order], subtree.column("n").to_numpy()[order]
        found = [(np.empty(0, np.int64),) * 3]
        for length in range(cut + 1, bits + 1):
            prefix = fine >> np.uint64(BITS - length) << np.uint64(BITS - length)
            starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            rows = np.add.reduceat(n, starts)
            large = rows >= least
            if not large.any():
                break
            found.append((np.full(large.sum(), length), prefix[starts[large]].view(np.int64), rows[large]))
        length, prefix, rows = (np.concatenate(x) for x in zip(*found))
        tree = np.full(len(length), subtree.column("tree")[0].as_py())
        return pa.table({"tree": tree, "length": length.astype(np.int32), "prefix": prefix, "rows": rows})

    fine = by_tree(stored).groupBy("tree", _prefix(F.col("key"), F.lit(bits)).alias("fine")).agg(F.count("*").alias("n"))
    return fine.groupBy("tree", _prefix(F.col("fine"), F.lit(cut)).alias("block")).applyInArrow(
        count, "tree long, length int, prefix long, rows long")


def upper_counts(placed: DataFrame, cut: int) -> DataFrame:
    """(tree, length, prefix, rows, chunks): the subtrees of lengths up to ``cut``, with the chunks their rows lie in."""
    rows = placed.groupBy("tree", _prefix(F.col("key"), F.lit(cut)).alias("block"), "chunk").agg(F.count("*").alias("n"))
    return rows.select("tree", "block", "chunk", "n", F.explode(F.sequence(F.lit(0), F.lit(cut))).alias("length")).groupBy(
        "tree", "length", _prefix(F.col("block"), F.col("length")).alias("prefix")
    ).agg(F.sum("n").alias("rows"), F.collect_set("chunk").alias("chunks"))


def query_levels(queries: DataFrame, counts: DataFrame, bits: int) -> DataFrame:
    """(node, length, rows): rows of the counted subtrees that share at least ``length`` bits with the query, in all
    trees together."""
    asked = by_tree(queries, "node").select("node", "tree", "key", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("length")).select(
        "node", "tree", "length", _prefix(F.col("key"), F.col("length")).alias("prefix"),
    )
    return asked.join(_large(counts), ["tree", "length", "prefix"]).groupBy("node", "length").agg(F.sum("rows").alias("rows"))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of at least the k best of each row of scores, with all ties of the last."""
    if scores.shape[1] <= k:
        return scores > -np.inf
    last = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
    return (scores >= last) & (scores > -np.inf)


def sample_truth(vectors: DataFrame, sample: list, k: int) -> DataFrame:
    """(node, found) of brute force for a bounded list of (node, packed) queries over all rows."""
    lengths = _by_length([r[1] for r in sample])
    asked = {rows.shape[1]: (np.array([sample[i][0] for i in at], np.int64), rows) for at, rows in lengths}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.array(batch.column("node"))
            for at, rows in _by_length(batch.column("packed").to_pylist()):
                if rows.shape[1] not in asked:
                    continue
                nodes, queries = asked[rows.shape[1]]
                found, scores = every[at], queries @ rows.T
                scores[nodes[:, None] == found[None, :]] = -np.inf
                a, b = np.nonzero(_best(scores, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[a]), pa.array(found[b]), pa.array(scores[a, b])], ["node", "found", "score"])

    near = vectors.select("node", "packed").mapInArrow(search, "node long, found long, score double")
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "found"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("node", "found")


def choose_candidates(
    stored: DataFrame, queries: DataFrame, counts: DataFrame, truth: DataFrame, bits: int, recall: float,
) -> int:
    """Rows to gather per query over all trees so that ``recall`` of the sampled true neighbours are met.

    A neighbour is met at the longest prefix it shares with the query in any tree; the
    rows at the next longer prefix must then be too few. The answer is a quantile of these counts.
    ``truth`` has k rows for each of ``SAMPLE_QUERIES`` queries, and is broadcast.
    """
    sampled = queries.join(F.broadcast(truth.select("node").distinct()), "node", "left_semi")
    asked = sampled.select("node", F.col("keys").alias("asked")).join(F.broadcast(truth), "node")
    pair = stored.select(F.col("node").alias("found"), "keys").join(F.broadcast(asked), "found")

    def shared(a: Column, b: Column) -> Column:
        differ = a.bitwiseXOR(b)
        return F.when(differ == 0, F.lit(BITS)).otherwise(F.lit(BITS) - F.length(F.bin(differ)))

    met = pair.select("node", "found", F.least(F.array_max(F.zip_with("asked", "keys", shared)), F.lit(bits)).alias("length"))
    levels = query_levels(sampled, counts, bits).withColumn("length", F.col("length") - 1)
    needed = met.join(_large(levels), ["node", "length"], "left").select(F.coalesce("rows", F.lit(0)).alias("rows"))
    found = needed.agg(F.percentile("rows", recall)).first()[0]
    return int(found or 0) + 1


# --- search -------------------------------------------------------------------

class _Chunk:
    """Stored rows of one chunk, with the sorted array of each tree."""

    def __init__(self, stored: pa.Table, keep: int):
        self.vectors = _unpack(stored.column("packed").to_pylist())
        self.nodes, self.least = stored.column("node").to_numpy(), stored.column("least").to_numpy()
        self.keys = _strings(stored)
        self.order = [np.argsort(x) for x in self.keys.T.copy()]
        self.keep = keep
        self.highest = np.linalg.norm(self.vectors, axis=1).max()

    def runs(self, keys: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the rows that share ``depth`` bits with each query, in each tree's sorted array."""
        low, first, last = _cut(keys, depth), np.empty(keys.shape, np.int64), np.empty(keys.shape, np.int64)
        high = low | _rest(depth)
        for t, order in enumerate(self.order):
            array = self.keys[order, t]
            first[:, t], last[:, t] = np.searchsorted(array, low[:, t], "left"), np.searchsorted(array, high[:, t], "right")
        return first, last

    def plain(self, queries: np.ndarray) -> np.ndarray:
        """Whether single precision holds the products with each query."""
        norm = np.linalg.norm(queries, axis=1)
        return (norm > 1e-15) & (norm < 1e15) & (1e-15 < self.highest < 1e15)

    def sparse(self, query: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` nearest among the rows of a query's runs, and their scores."""
        rows = np.unique(np.concatenate([x[a:b] for x, a, b in zip(self.order, first, last)]))
        scores = (self.vectors[rows] * query).sum(axis=1)
        near = np.flatnonzero(_best(scores[None, :], self.keep)[0])
        near = near[np.lexsort((self.nodes[rows[near]], self.least[rows[near]], -scores[near]))][:self.keep]
        return rows[near], scores[near]

    @cached_property
    def single(self) -> np.ndarray:
        return self.vectors.astype(np.float32)

    def dense(self, queries: np.ndarray, keys: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The same for queries whose runs hold a good part of the chunk; None where this way finds too few.

        A matrix product in single precision gives bounds of all scores. Rows that may be among the best of the chunk
        are tested for a shared prefix; of these, only rows in the runs are scored and kept.
        """
        m, width = self.vectors.shape
        wanted = 2 * self.keep
        step = int(np.clip(m // (16 * wanted), 1, 64))
        groups = -(-m // step)
        scores = np.full((len(queries), groups * step), -np.inf, np.float32)
        np.matmul(queries.astype(np.float32), self.single.T, out=scores[:, :m])
        scores = scores.reshape(len(queries), groups, step)
        error = 4 * (width + 8) * np.finfo(np.float32).eps * self.highest * np.linalg.norm(queries, axis=1)
        tops = scores.max(axis=2)
        # as many groups, so at least ``wanted`` rows, reach ``floor``; rows that do so have bounds above ``limit``
        floor = -np.partition(-tops, wanted - 1, axis=1)[:, wanted - 1] - error
        limit = (floor - error).astype(np.float32)
        q, group = np.nonzero(tops >= limit[:, None])
        at, place = np.nonzero(scores[q, group] >= limit[q, None])
        q, row = q[at], group[at] * step + place
        inside = (_cut(self.keys[row] ^ keys[q], depth[q]) == 0).any(axis=1)
        q, row = q[inside], row[inside]
        exact = (self.vectors[row] * queries[q]).sum(axis=1)
        order = np.lexsort((self.nodes[row], self.least[row], -exact, q))
        row, exact = row[order], exact[order]
        ends = np.searchsorted(q, np.arange(len(queries) + 1))
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            sure = b - a >= self.keep and exact[a + self.keep - 1] >= floor[i]
            yield (row[a:a + self.keep], exact[a:a + self.keep]) if sure else None


def _strings(table: pa.Table) -> np.ndarray:
    return table.column("keys").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)


def _rest(depth: np.ndarray) -> np.ndarray:
    """Strings whose first ``depth`` bits are zero, the others one, one for each row."""
    ones = np.uint64(2**BITS - 1)
    return np.where(depth >= BITS, np.uint64(0), ones >> np.minimum(depth, BITS - 1).astype(np.uint64))[:, None]


def _cut(keys: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return keys & ~_rest(depth)


def _score_chunk(keep: int):
    def score(asked: pa.Table, stored: pa.Table) -> pa.Table:
        nodes, found, below, least, sizes = [], [], [], [], []
        if len(asked) and len(stored):
            chunk = _Chunk(stored, keep)
            queries, keys, depth = _unpack(asked.column("packed").to_pylist()), _strings(asked), asked.column("depth").to_numpy()
            first, last = chunk.runs(keys, depth)
            met = (last - first).sum(axis=1)
            many = np.flatnonzero(chunk.plain(queries) & (met * 32 >= len(stored)) & (len(stored) >= 4 * keep))
            near: dict[int, tuple | None] = {}
            for at in range(0, len(many), TILE):
                tile = many[at:at + TILE]
                near.update(zip(tile, chunk.dense(queries[tile], keys[tile], depth[tile])))
            every = asked.column("node").to_numpy()
            for i in np.flatnonzero(met):
                rows, scores = near.get(i) or chunk.sparse(queries[i], first[i], last[i])
                nodes.append(every[i])
                sizes.append(len(rows))
                found.append(chunk.nodes[rows])
                least.append(chunk.least[rows])
                below.append(0.0 - scores)
        flat = [pa.array(np.concatenate([np.empty(0, t), *x])) for x, t in ((below, float), (least, np.int64), (found, np.int64))]
        lists = pa.ListArray.from_arrays(
            np.cumsum([0, *sizes], dtype=np.int32), pa.StructArray.from_arrays(flat, ["below", "least", "found"]))
        return pa.table({"node": pa.array(nodes, pa.int64()), "near": lists})

    return score


def nearest_neighbours(
    table: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, seed: int = 7,
    recall: float = TARGET_RECALL, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest others found.

    Every row is indexed. Each tree orders all rows by a 64-bit string of random
    projections. A query starts at its longest matching prefixes in all trees and ascends,
    all trees together one bit at a time, until enough rows share its prefix; these rows are
    scored exactly. How many are enough is measured: brute force over all rows for
    ``SAMPLE_QUERIES`` queries gives the count that meets ``recall`` of their true neighbours.
    Subtrees of k rows or fewer are not counted.

    In any case a query ascends until one tree holds k others that share its prefix, or to the root.

    Rows are dealt into chunks by their prefix in the first tree, crowded ones by a hash of the row, so a vector is sent once
    for all trees. A chunk holds ``BLOCK_BYTES`` of vectors at most, and a part of the queries ``PART_BYTES``, so a task holds two bounded
    sides. A query is sent to the chunks in which rows share its prefix in any tree: few where vectors are clustered;
    on vectors without clusters, where half of all rows must be met, all of them. Of a chunk it takes k + 1 rows at most.
    Nothing that grows with the table passes through the driver but a row for each length of vectors, and a broadcast row
    for each chunk.
    Equal vectors are one row of the index with their k + 1 least ids. Vectors that are
    null, zero or hold null or non-finite components take no part, nor do rows without id.
    Rows sharing an id are rows of their own unless their vectors are equal too; a query is each of them. Vectors of each
    length have trees of their own and are searched among themselves;
    fewer candidates than k give fewer rows, all of them; an empty table gives an empty result; other
    columns are not read. ``is_query`` is a condition on ``vec_id``.
    """
    rows = materialize(usable_vectors(table, id_column, vector_column), "ann-rows")
    spark = rows.sparkSession
    # one row for each length of vectors
    per_length = rows.groupBy((F.length("packed") / 8).cast("long").alias("width")).agg(F.max("norm").alias("highest")).collect()
    if not per_length:
        return spark.createDataFrame([], NEIGHBOURS)
    highest = {r.width: r.highest for r in per_length}
    unique = distinct_vectors(rows, k).withColumn("node", F.monotonically_increasing_id())
    vectors = materialize(with_strings(unique, highest, trees, seed, False), "ann-vectors")
    members = materialize(rows.where(is_query).select("vec_id", "packed", _digest().alias("digest")).join(
        _large(vectors.select("node", _digest().alias("digest"))), "digest").select("vec_id", "node", "packed"), "ann-queries")
    asked = materialize(with_strings(members.select("node", "packed").distinct(), highest, trees, seed, True), "ann-asked")
    first_nodes = [r.node for r in asked.select("node").orderBy(F.xxhash64("node")).limit(SAMPLE_QUERIES).collect()]
    if not first_nodes:
        return spark.createDataFrame([], NEIGHBOURS)
    sample = asked.where(F.col("node").isin(first_nodes)).select("node", "packed").collect()
    total, size = vectors.agg(F.count("*"), F.sum(F.length("packed"))).first()
    bits = max(1, min(COUNTED_BITS, math.ceil(math.log2(total)) + 1))
    cut = min(bits, max(0, math.ceil(math.log2(max(1, total / BLOCK_ROWS)))))
    block = _prefix(F.get("keys", F.lit(0)), F.lit(max(min(cut, int(math.log2(LEAST_BLOCKS))), math.ceil(math.log2(size / BLOCK_BYTES)))))
    cells = F.ceil(F.count("*") * F.col("first") / F.lit(trees) * 8 / F.lit(float(BLOCK_BYTES)))
    blocks = materialize(vectors.groupBy("first", block.alias("block")).agg(cells.cast("int").alias("cells")).withColumn(
        "base", F.sum("cells").over(W.orderBy("first", "block")) - F.col("cells")), "ann-blocks")
    stored = vectors.withColumn("block", block).join(F.broadcast(blocks), ["first", "block"]).withColumn(
        "chunk", (F.col("base") + F.pmod(F.xxhash64("node"), "cells")).cast("int"))
    upper = materialize(upper_counts(by_tree(stored, "chunk"), cut), "ann-upper")
    counts = materialize(upper.where(F.col("rows") > k).select("tree", "length", "prefix", "rows").unionByName(
        deep_counts(vectors, cut, bits, k + 1)), "ann-counts")
    truth = materialize(sample_truth(vectors, sample, k), "ann-truth")
    wanted = choose_candidates(vectors, asked, counts, truth, bits, recall)
    deepest = counts.agg(F.max("length")).first()[0] or 0
    depth = query_levels(asked, counts, deepest).where(F.col("rows") >= wanted).groupBy("node").agg(F.max("length").alias("depth"))
    start = asked.select("node", "first", "keys").join(_large(depth), "node", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    met = by_tree(start, "node", "depth").select(
        "node", "depth", "tree", F.least("depth", F.lit(cut)).alias("length"),
        _prefix(F.col("key"), F.least("depth", F.lit(cut))).alias("prefix"),
    ).join(_large(upper.select("tree", "length", "prefix", "chunks")), ["tree", "length", "prefix"])
    routes = met.groupBy("node", "depth").agg(F.array_distinct(F.flatten(F.collect_list("chunks"))).alias("chunks"))
    routed = materialize(asked.select("node", "packed", "keys").join(_large(routes), "node"), "ann-routed")
    parts = F.broadcast(routed.select(F.length("packed").alias("size"), F.explode("chunks").alias("chunk")).groupBy("chunk").agg(
        F.ceil(F.sum("size") / F.lit(float(PART_BYTES))).cast("int").alias("parts")))
    data = stored.join(parts, "chunk").select(
        "node", F.get("ids", F.lit(0)).alias("least"), "packed", "keys", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sought = routed.withColumn("chunk", F.explode("chunks")).join(parts, "chunk").select(
        "node", "packed", "keys", "depth", "chunk", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    unit = ["chunk", "part"]
    scored = sought.groupBy(unit).cogroup(data.groupBy(unit)).applyInArrow(_score_chunk(k + 1), NEAR)
    best = scored.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    listed = best.select("node", F.explode("near").alias("n")).select(
        "node", F.col("n.found").alias("found"), (F.lit(0.0) - F.col("n.below")).alias("score"),
    ).join(_large(vectors.select(F.col("node").alias("found"), "ids")), "found").select("node", "found", "score", F.explode("ids").alias("vec_id"))
    top = W.partitionBy("node").orderBy(F.desc("score"), "vec_id", "found")
    short = materialize(listed.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1), "ann-short")
    mine = members.select(F.col("vec_id").alias("query_id"), "node").join(
        _large(short.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "found"))).alias("near"))), "node")
    others = F.slice(F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["found"] != F.col("node"))), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("rank", "n")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"),
        F.col("n.score").alias("score"),
    )
