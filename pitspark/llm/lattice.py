"""Near duplicates among embeddings: random projections hashed to points of the E8 lattice."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitspark.session import materialize

from .components import connected_components
from .ngram_join import _least_nodes, _shares_bucket, candidate_groups, deal_blocks
from .shingles import mix64

THRESHOLD = 0.95
RECALL = 0.999
BLOCK_VECTORS = 2048
BLOCK_VALUES = 2_000_000
SCALES = (1.0, 1.25, 1.5, 1.75, 2.0, 2.5)
PROBES = (1, 2, 4, 8)
MAX_CELLS = 256  # of a vector in one table
_SHIP_COST = 400.0  # shipping a vector to a cell against one comparison of two vectors
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- the lattice ----------------------------------------------------------------

def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    whole = np.rint(x)
    off = x - whole
    row, worst = np.arange(len(x)), np.abs(off).argmax(axis=1)
    other = whole.copy()
    other[row, worst] += np.where(off[row, worst] >= 0, 1, -1)
    return np.where((whole.sum(axis=1) % 2 != 0)[:, None], other, whole)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by a half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


@cache
def least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps from a cell to those it touches."""
    eye = np.eye(8)
    pairs = [s * eye[i] + t * eye[j] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(c < 0 for c in s) % 2 == 0]
    return np.array(pairs + halves)


def probed_cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, 8) doubled coordinates of the own cell and the nearest neighbouring ones."""
    own = nearest_e8(x)
    toward = (x - own) @ least_vectors().T
    near = np.argpartition(-toward, probes - 1, axis=1)[:, :probes - 1]
    cells = np.concatenate([own[:, None, :], own[:, None, :] + least_vectors()[near]], axis=1)
    return np.rint(2 * cells).astype(np.int64)


def cell_hashes(x: np.ndarray, probes: int, seed: int) -> np.ndarray:
    cells = probed_cells(x, probes).view(np.uint64)
    out = np.full(cells.shape[:2], mix64(np.array([seed], np.uint64))[0])
    for i in range(8):
        out = mix64(out + cells[:, :, i] + _STEP)
    return out


# --- parameters -----------------------------------------------------------------

@lru_cache(32)
def _measured(threshold: float) -> dict[tuple[float, int], tuple[float, float]]:
    """(scale, probes): chance that two vectors share a cell, at the threshold and unrelated.

    Gaussian projections of two unit vectors are jointly normal with their cosine as correlation,
    whatever the vectors, so both chances are measured on normal pairs drawn from a fixed seed.
    """
    rng = np.random.default_rng(11)
    a, z, lone = rng.standard_normal((3, 2000, 8))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * z
    found = {}
    for scale in SCALES:
        for probes in PROBES:
            x, y, other = (cell_hashes(v / scale, probes, 1) for v in (a, b, lone))
            hit = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).sum() / (len(x) + 3)  # never taken for certain
            _, count = np.unique(other, return_counts=True)
            met = float((count.astype(float) * (count - 1)).sum()) / (len(other) * (len(other) - 1))
            found[scale, probes] = float(hit), max(met, 1e-6)
    return found


def choose_tables(rows: int, threshold: float, recall: float) -> tuple[int, int, float, int]:
    """(tables, lattices per table, scale, probes) of the least work that reaches ``recall`` at the threshold.

    A cell of several lattices is narrower: two vectors meet only if they do in each. More rows favour
    narrower cells and more tables; the recall stays.
    """
    best = None
    for (scale, probes), (hit, met) in _measured(threshold).items():
        for lattices in range(1, 9):
            cells, together = probes**lattices, hit**lattices
            if cells > MAX_CELLS or together <= 0:
                break
            tables = max(2, math.ceil(math.log(1 - recall) / math.log1p(-together)))
            work = tables * (cells * _SHIP_COST + rows * met**lattices)
            if best is None or work < best[0]:
                best = work, tables, lattices, scale, probes
    return best[1:]


# --- cells of vectors -----------------------------------------------------------

class CellHasher:
    """Hashes of all cells a vector is placed in: each table has its own projections and seed."""

    def __init__(self, tables: int, lattices: int, scale: float, probes: int, seed: int):
        self.tables, self.lattices, self.scale, self.probes, self.seed = tables, lattices, scale, probes, seed
        self.planes: dict[int, np.ndarray] = {}

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """(rows, cells) of unit vectors of one length; lengths never share a cell."""
        width = unit.shape[1]
        if width not in self.planes:
            rng = np.random.default_rng((self.seed, width))
            self.planes[width] = rng.standard_normal((self.tables * self.lattices, width, 8)) / self.scale
        out = []
        for table in range(self.tables):
            keys = np.full((len(unit), 1), mix64(np.array([table * 100_003 + width], np.uint64))[0])
            for i in range(table * self.lattices, (table + 1) * self.lattices):
                mine = cell_hashes(unit @ self.planes[width][i], self.probes, i + 1)
                keys = mix64(keys[:, :, None] + mine[:, None, :] * _STEP).reshape(len(unit), -1)
            out.append(keys)
        return np.concatenate(out, axis=1).view(np.int64)


def place_vectors(vectors: DataFrame, hasher: CellHasher) -> DataFrame:
    """Adds ``bands`` (cell hashes) and ``packed`` (the vector scaled to length 1, as bytes) to rows with ``v``."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(v, np.float64) for v in batch.column("v").to_pylist()]
            bands, packed = [None] * len(lists), [None] * len(lists)
            for width in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == width]
                unit = _unit(np.array([lists[i] for i in at]))
                for i, cells, u in zip(at, hasher(unit), unit):
                    bands[i], packed[i] = np.unique(cells), u.tobytes()
            kept = [c for c in batch.schema.names if c != "v"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                [*kept, "bands", "packed"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema if f.name != "v")
    return vectors.mapInArrow(placed, f"{schema}, bands array<long>, packed binary")


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


# --- verification ---------------------------------------------------------------

def verify_unit(group: int, left: list[dict], right: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(node, links, root) of the vectors with links in a unit: pairs of ``left``, or across to ``right``.

    A pair belongs to the group of its least common cell, so it is counted once. Only vectors with
    a cosine at the threshold are looked at further.
    """
    unit = [np.frombuffer(b"".join(d["packed"] for d in side), "<f8").reshape(len(side), -1) for side in (left, right) if side]
    near = unit[0] @ unit[-1].T >= threshold
    if not right:
        np.fill_diagonal(near, False)
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    left = [left[i] for i in rows]
    docs = left + [right[i] for i in columns] if right else left
    near = near[np.ix_(rows, columns)]
    k, n = len(left), len(docs)
    linked = np.zeros((k, n), bool)
    linked[:, k if right else 0:] = near
    cells = [(np.array([b["anchor"] for b in d["buckets"]], np.int64), np.array([b["bucket"] for b in d["buckets"]], np.int64))
             for d in docs]
    linked &= _shares_bucket([bucket[anchor == group] for anchor, bucket in cells], k)
    linked &= ~_shares_bucket([bucket[anchor < group] for anchor, bucket in cells], k)
    copies = np.array([d["copies"] for d in docs], np.int64)
    nodes = np.array([d["node"] for d in docs], np.int64)
    links = np.zeros(n, np.int64)
    links[:k] = linked @ copies
    if right:
        links += copies[:k] @ linked
    joined = np.zeros((n, n), bool)
    joined[:k] = linked
    roots = _least_nodes(joined | joined.T, nodes)
    return [(int(nodes[i]), int(links[i]), int(roots[i])) for i in np.flatnonzero(links)]


def verified_links(units: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) of every vector in every unit where it has links; a task holds one unit at a time."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def finish() -> list[tuple[int, int, int]]:
            if unit is None or len(held) < 2:
                return []
            group, low, high = unit
            left, right = [d for d in held if d["block"] == low], [d for d in held if d["block"] != low]
            if high != low and not (left and right):
                return []
            return verify_unit(group, left, right, threshold)

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                key = row["group"], row["low"], row["high"]
                if key != unit:
                    found += finish()
                    unit, held = key, []
                held.append(row)
            if found:
                yield _link_batch(found)
        if found := finish():
            yield _link_batch(found)

    dealt = units.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
    return dealt.mapInArrow(verify, "node long, links long, root long")


def _link_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])


# --- the operator ---------------------------------------------------------------

def embedding_duplicates(
    table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 17,
    block_vectors: int = BLOCK_VECTORS, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """One row per row of ``table``: (vec_id, n_links, component_id, kept).

    Vectors are projected at random to 8 dimensions a few times; each projection is decoded to the nearest point
    of the E8 lattice. A vector is placed in its own cell of every table and in the nearest neighbouring
    cells. Pairs that share a cell are compared by cosine in double precision and linked from ``threshold``.
    Number and width of the cells follow from the number of vectors, so that a pair at the threshold
    meets with probability ``recall`` (higher above it).

    ``n_links`` counts the other vectors linked directly, copies included; ``component_id`` is the least vec_id
    reachable by links; ``kept`` says whether it is the row's own. Equal vectors are folded first. The members of
    the cells with one least vector are one group; a large group is dealt into pairs of blocks, and only
    counts and one edge per vector leave a unit, never pairs. Counting every link of a large group of vectors that
    all differ takes work quadratic in its size, spread over units of bounded size.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    components of their own. Only vectors of equal length are compared. Rows sharing a vec_id are
    vectors of their own; a null vec_id is never a component_id unless the component has no other, and then
    ``kept`` is true. Labels and other columns are not read. An empty table gives an empty result.
    """
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_column).alias("vec_id"), v.alias("v")).withColumn(
        "v", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    # two 64-bit digests tell vectors apart; null where a vector takes no part
    digests = {name: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(name), "v")) for name in ("digest", "check_digest")}
    keyed = rows.withColumns(digests)
    members = materialize(keyed.select("vec_id", *digests), "lattice-rows")
    folded = materialize(
        keyed.where(F.col("v").isNotNull()).groupBy(*digests).agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("v").alias("v")),
        "lattice-vectors",
    )
    hasher = CellHasher(*choose_tables(folded.count(), threshold, recall), seed)
    reps = materialize(
        place_vectors(folded.withColumns({
            "node": F.monotonically_increasing_id(), "check": F.lit(0).cast("long"), "grams": F.size("v").cast("long"),
        }), hasher),
        "lattice-cells",
    )
    groups = materialize(candidate_groups(reps), "lattice-groups")
    units = deal_blocks(groups, block_vectors, BLOCK_VALUES).join(reps.select("node", "copies", "packed"), "node")
    verified = materialize(verified_links(units, threshold), "lattice-links")
    components = connected_components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("node", *digests, "copies", "least_id").join(counted, "node", "left").join(
        components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labelled = known.join(named, "component").select(
        *digests, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    linked = members.where(F.col("digest").isNotNull()).join(labelled, list(digests)).select("vec_id", "n_links", "component_id")
    alone = members.where(F.col("digest").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
