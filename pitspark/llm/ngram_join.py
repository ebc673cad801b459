"""Similarity join of documents on word n-gram sets: MinHash banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitspark.session import materialize

from .components import connected_components
from .shingles import MinHasher, WordHasher, choose_bands, ngram_set
from .text import packed_rows, row_key, unpacked

N = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK_DOCS = 512
BLOCK_GRAMS = 2_000_000
_COLUMNS = 8_192


# --- signatures ------------------------------------------------------------

def set_digest(grams: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit digests of a set, none for the empty set."""
    if not len(grams):
        return None, None
    return int(np.bitwise_xor.reduce(grams).view(np.int64)), int(grams.sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, doc_key, node, check, grams, bands) per row.

    ``node`` and ``check`` are two 64-bit digests of the n-gram set, null where a
    text has no gram. Band hashes differ between bands, so one column holds them all.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minhash = WordHasher(), MinHasher(bands, rows)
        for batch in batches:
            node, check, size, bound = [], [], [], []
            for text in batch.column("text"):
                grams = ngram_set(text.as_py(), n, hasher)
                digest = set_digest(grams)
                node.append(digest[0])
                check.append(digest[1])
                bound.append(minhash(grams) if len(grams) else None)
                size.append(len(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("doc_key"), pa.array(node, pa.int64()),
                 pa.array(check, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(bound, pa.list_(pa.int64()))],
                ["doc_id", "doc_key", "node", "check", "grams", "bands"],
            )

    rows_in = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), "text")
    id_type = rows_in.schema["doc_id"].dataType.simpleString()
    key_type = rows_in.schema["doc_key"].dataType.simpleString()
    return rows_in.mapInArrow(
        sign, f"doc_id {id_type}, doc_key {key_type}, node long, check long, grams long, bands array<long>",
    )


# --- candidate groups ------------------------------------------------------

def candidate_groups(reps: DataFrame) -> DataFrame:
    """(node, check, group, size, volume, buckets): the groups a representative is verified in.

    A bucket is a band hash that at least two representatives share; its anchor is
    its least node. A group gathers the members of all buckets with one anchor, so
    a document is shipped once per distinct anchor instead of once per band.
    ``buckets`` has (anchor, band hash) of every bucket of the representative.
    """
    placed = reps.select("node", "check", "grams", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(
        F.min("node").alias("anchor"), F.count("*").alias("members"),
    ).where(F.col("members") > 1).drop("members")
    members = placed.join(shared, "bucket")
    mine = members.groupBy("node", "check", "grams").agg(
        F.sort_array(F.collect_list(F.struct("anchor", "bucket"))).alias("buckets"),
    )
    mine = materialize(mine, "join-members")
    listed = mine.select(
        "node", "check", "grams", "buckets",
        F.explode(F.array_distinct(F.transform("buckets", lambda b: b["anchor"]))).alias("group"),
    )
    # a table of its own, so that Spark may split the members of a crowded group when they meet their sizes
    sizes = materialize(
        listed.groupBy("group").agg(F.count("*").alias("size"), F.sum("grams").alias("volume")), "join-sizes")
    return listed.join(sizes, "group")


def deal_blocks(groups: DataFrame, block_docs: int, block_grams: int) -> DataFrame:
    """Every pair of blocks of a group is a unit of work: adds (low, high, block).

    A group of at most ``block_docs`` documents and ``block_grams`` grams is one
    unit. A larger one is cut into blocks by node, and each document goes to the
    units that pair its block with every other, so a unit stays small whatever the
    size of the group, and units spread over the cluster.
    """
    cuts = F.greatest(
        F.lit(1), F.ceil(F.col("size") / F.lit(float(block_docs))),
        F.ceil(F.col("volume") / F.lit(float(block_grams))),
    ).cast("int")
    dealt = groups.withColumn("cuts", cuts).withColumn(
        "block", F.pmod(F.xxhash64("node", "check", "group"), F.col("cuts")).cast("int"),
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return dealt.select(
        "node", "check", "group", "buckets", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )


# --- verification ----------------------------------------------------------

def _overlaps(sets: list[np.ndarray], wanted: int) -> np.ndarray:
    """Matrix of common elements between the first ``wanted`` sets and all of them."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    used, code = np.unique(code, return_inverse=True)
    common = np.zeros((wanted, len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for first in range(0, len(used), _COLUMNS):
        a, b = np.searchsorted(code, (first, first + _COLUMNS))
        table = np.zeros((len(sets), min(_COLUMNS, len(used) - first)), np.float32)
        table[owner[a:b], code[a:b] - first] = 1
        common += table[:wanted] @ table.T
    return common


def _shares_bucket(buckets: list[np.ndarray], wanted: int) -> np.ndarray:
    if not any(len(b) for b in buckets):
        return np.zeros((wanted, len(buckets)), bool)
    return _overlaps(buckets, wanted) > 0


def _least_nodes(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node of each document's connected component in ``linked`` (symmetric)."""
    root = nodes.copy()
    left = linked.any(axis=1)
    while left.any():
        member = np.zeros(len(nodes), bool)
        reached = np.zeros(len(nodes), bool)
        reached[np.argmax(left)] = True
        while reached.any():
            member |= reached
            reached = linked[reached].any(axis=0) & ~member
        root[member] = nodes[member].min()
        left &= ~member
    return root


def verify_unit(
    group: int, left: list[tuple], right: list[tuple], threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) per document of a unit, left before right.

    A document is (node, copies, grams, anchors, buckets). Pairs are taken inside
    ``left`` when ``right`` is empty, else across. A pair belongs to this group if its
    least common bucket has this anchor, so it is counted in exactly one group.
    ``links`` counts linked documents with their copies; ``root`` is the least
    node of the documents that links of this unit connect with it, its own if none.
    """
    docs = left + right
    k = len(left)
    sizes = np.array([len(d[2]) for d in docs], np.float64)
    copies = np.array([d[1] for d in docs], np.float64)
    nodes = np.array([d[0] for d in docs], np.int64)
    common = _overlaps([d[2] for d in docs], k)
    linked = common >= threshold * (sizes[:k, None] + sizes[None, :] - common) - 1e-9
    linked &= _shares_bucket([d[4][d[3] == group] for d in docs], k)
    linked &= ~_shares_bucket([d[4][d[3] < group] for d in docs], k)
    if right:
        linked[:, :k] = False
    else:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(docs))
    links[:k] = linked @ copies
    if right:
        links += copies[:k] @ linked
    joined = np.zeros((len(docs), len(docs)), bool)
    joined[:k] = linked
    joined |= joined.T
    return links, _least_nodes(joined, nodes)


def verified_links(units: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, check, links, root) of every representative in every unit where it has links.

    ``units`` has (group, low, high, block, node, check, copies, buckets, text). Rows come
    sorted by unit, so a task holds one unit at a time. A text whose set is not the
    representative's (its row key collided) is passed over.
    """
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        unit, held = None, []

        def finish() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            group, low, high = unit
            left = [d for d in held if d[0] == low]
            right = [d for d in held if d[0] != low]
            if high != low and not (left and right):
                return None
            links, root = verify_unit(group, [d[2:] for d in left], [d[2:] for d in right], threshold)
            some = np.flatnonzero(links)
            if not len(some):
                return None
            docs = left + right
            return pa.RecordBatch.from_arrays(
                [pa.array([docs[i][2] for i in some], pa.int64()), pa.array([docs[i][1] for i in some], pa.int64()),
                 pa.array(links[some].astype(np.int64)), pa.array(root[some])],
                ["node", "check", "links", "root"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                key = row["group"], row["low"], row["high"]
                if key != unit:
                    if (out := finish()) is not None:
                        yield out
                    unit, held = key, []
                grams = ngram_set(row["text"], n, hasher)
                if set_digest(grams) != (row["node"], row["check"]):
                    continue
                held.append((
                    row["block"], row["check"], row["node"], row["copies"], grams,
                    np.array([b["anchor"] for b in row["buckets"]], np.int64),
                    np.array([b["bucket"] for b in row["buckets"]], np.int64),
                ))
        if (out := finish()) is not None:
            yield out

    dealt = units.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
    return dealt.mapInArrow(verify, "node long, check long, links long, root long")


# --- the join --------------------------------------------------------------

def near_duplicates(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
    block_docs: int = BLOCK_DOCS, block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per document: (doc_id, doc_key, class_id, n_links, copies, component).

    Two documents are linked if the Jaccard similarity of their whole n-gram sets is
    at least ``threshold``. ``n_links`` counts the other documents linked to this one,
    copies included; ``class_id`` is the least doc_id of its connected component;
    ``copies`` counts documents with the same set, itself included; ``component`` is the
    class as a node of the link graph, null where a text has no gram.

    Rows with the same set are folded first and only one representative is banded.
    Bands and rows are chosen so that a pair at the threshold is found with
    probability ``recall`` (higher above it). Every pair of different sets that meets
    in a band is verified on its full sets, once, in units of two blocks of a
    candidate group; only counts and one edge per document leave a unit, never pairs.
    Links within a large group of texts that all differ do take work quadratic in its
    size, because every such link counts; no unit, row count or memory does.

    A text of fewer than n words is one gram of them; a text without words is one gram
    of its characters; null and empty texts have no gram, no links and a class of their
    own. Repeated rows are copies; a null doc_id is kept and never chosen as class_id
    unless all ids of the class are null. An empty table gives an empty result. Columns
    beside doc_id and text are not read. Sets are told apart by 128-bit digests, nodes of
    the link graph by 64 bits.
    """
    docs = docs.select("doc_id", "text")
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(signatures(docs, n, bands, rows), "join-signatures")
    reps = materialize(
        signed.where(F.col("node").isNotNull()).groupBy("node", "check").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("least_id"),
            F.min("doc_key").alias("doc_key"), F.first("grams").alias("grams"), F.first("bands").alias("bands"),
        ),
        "join-reps",
    )
    groups = materialize(candidate_groups(reps), "join-groups")
    places = deal_blocks(groups, block_docs, block_grams).groupBy("node", "check").agg(
        F.collect_list(F.struct("group", "low", "high", "block")).alias("units"), F.first("buckets").alias("buckets"),
    ).join(reps.select("node", "check", "doc_key", "copies"), ["node", "check"])
    # a row landed many times is folded before its text travels
    texts = docs.groupBy(row_key(F.col("doc_id"), F.col("text")).alias("doc_key")).agg(F.first("text").alias("text"))
    units = texts.join(places, "doc_key").select("node", "check", "copies", "buckets", "text", F.explode("units").alias("unit")).select(
        "node", "check", "copies", "buckets", "text", "unit.*",
    )
    verified = materialize(verified_links(units, n, threshold), "join-links")
    components = connected_components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = verified.groupBy("node", "check").agg(F.sum("links").alias("links"))
    known = (
        reps.select("node", "check", "copies", "least_id")
        .join(counted, ["node", "check"], "left").join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = known.groupBy("component").agg(F.min("least_id").alias("class_id"))
    labelled = known.join(named, "component").select(
        "node", "check", "class_id", "component", "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    columns = ["doc_id", "doc_key", "class_id", "n_links", "copies", "component"]
    filled = signed.where(F.col("node").isNotNull()).drop("grams", "bands")
    empty = signed.where(F.col("node").isNull()).select(
        "doc_id", "doc_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("component"),
    )
    return filled.join(labelled, ["node", "check"]).select(columns).union(empty.select(columns))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the least doc_id, a null one last.

    Rows without text (null or empty) have no class and all stay. Of equal rows one stays.
    """
    judged = near_duplicates(docs, **options).where(F.col("component").isNotNull())
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("doc_key"))
    first = judged.groupBy("component").agg(F.min(order).alias("first"))
    keep = first.select(F.col("first.doc_key").alias("key"))
    no_text = F.coalesce(F.col("text"), F.lit("")) == ""
    rows = packed_rows(docs.where(~no_text), row_key(F.col("doc_id"), F.col("text")))
    return unpacked(rows.join(keep, "key", "left_semi"), docs.columns).union(docs.where(no_text))
