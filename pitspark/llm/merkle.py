"""Merkle manifest of a data set: hashed leaves, 16-ary trees per source, proofs and their check."""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from pitspark.session import materialize

FAN = 16
STEPS = 3  # levels of a superblock
_SHIFT = 12  # bits of an index inside a superblock: FAN ** STEPS == 1 << _SHIFT
_PATH = "array<array<string>>"


# --- leaves -------------------------------------------------------------------

def field_bytes(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of a row's fields, as lowercase hex; each field carries its length, so rows differ."""
    return F.sha2(F.concat(*[field_bytes(c) for c in columns]).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tampers(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the decimal id; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed) per row; ``changed`` is the leaf after tampering, else null."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    kept = [F.col(c) for c in fields]
    forged = [*kept[:-1], tampered_text(F.col("text"))]
    return docs.select(
        "doc_id", "source", leaf_digest(kept).alias("leaf"),
        F.when(tampers(F.col("doc_id")), leaf_digest(forged)).alias("changed"),
    )


# --- positions ----------------------------------------------------------------

def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``index``, their place in ``group`` by ``order`` (ascending, null first), and the groups.

    The second table has (group, first_place, count): ``first_place`` orders the groups themselves.
    Rows are sorted by range, so a hot group spreads over ranges; places follow
    from the counts of each (group, range), no task holds a group. Rows that are
    equal in ``order`` are told apart by where they were written.
    """
    placed = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [group, *order, "_tie"]
    ordered = placed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in keys])
    # the id counts rows within a range and ranges in order; written once, it never changes
    ordered = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()).drop("_tie"), f"{name}-order")
    spans = ordered.groupBy(group, F.shiftright("_place", 33).alias("_range")).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(
        spans.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")), f"{name}-spans")
    groups = starts.groupBy(group).agg(F.min("_first").alias("first_place"), F.sum("_rows").alias("count"))
    mine = starts.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), "_offset")
    indexed = ordered.join(
        mine, ordered[group].eqNullSafe(F.col("_group")) & (F.shiftright(ordered["_place"], 33) == F.col("_r")),
    ).withColumn("index", F.col("_place") + F.col("_offset"))
    return indexed.drop("_group", "_r", "_offset", "_place"), groups


# --- trees --------------------------------------------------------------------

def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def runs_of(level: list[str]) -> list[str]:
    return ["".join(level[i:i + FAN]) for i in range(0, len(level), FAN)]


def subtree(nodes: list[str], steps: int) -> list[list[str]]:
    """The levels of a superblock, its own nodes first; each of ``steps`` levels hashes runs of 16."""
    levels = [nodes]
    for _ in range(steps):
        levels.append([sha(run) for run in runs_of(levels[-1])])
    return levels


def siblings(level: list[str], at: int) -> list[str]:
    """The others of a node's run, left to right."""
    first = at - at % FAN
    return level[first:at] + level[at + 1:first + FAN]


def fold(digest: str, index: int, path: list[list[str]]) -> str:
    """The root that a node and its siblings give, level by level; ``index`` names its place in each run."""
    for others in path:
        at = index % FAN
        digest = sha("".join(others[:at]) + digest + "".join(others[at:]))
        index //= FAN
    return digest


def tree_height(count: Column) -> Column:
    """Levels until one node is left: the least h with 16 ** h >= count."""
    grown = [F.when(count > FAN**h, 1).otherwise(0) for h in range(15)]
    return sum(grown[1:], grown[0])


def _in_superblocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("index", _SHIFT))


def reduce_round(nodes: DataFrame, name: str) -> DataFrame:
    """(tree, index, digest, height): one node per superblock of (tree, index, digest, height) rows.

    ``height`` is what is left of the tree above the nodes; a superblock takes at most three levels of it.
    """
    def reduced(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        height = int(block["height"].iloc[0])
        steps = min(STEPS, height)
        top = subtree(block["digest"].tolist(), steps)[-1]
        return pd.DataFrame({
            "tree": block["tree"].iloc[:1], "index": block["block"].iloc[:1],
            "digest": top, "height": height - steps,
        })

    narrow = _in_superblocks(nodes).select("tree", "block", "index", "digest", "height")
    grown = narrow.groupBy("tree", "block").applyInPandas(reduced, "tree long, index long, digest string, height int")
    return materialize(grown, name)


def tree_rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes of every round, given ones first, until each tree is one node."""
    rounds = [nodes]
    while rounds[-1].agg(F.max("height")).first()[0]:
        rounds.append(reduce_round(rounds[-1], name))
    return rounds


def join_proofs(nodes: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """(tree, index, digest, path): the siblings of every node, level by level up to its tree's root.

    ``outer`` has the path of each superblock's top node. Both are cogrouped by superblock, so a task
    holds 4096 nodes and one outer path at a time.
    """
    def joined(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        if block.empty:
            return pd.DataFrame({"tree": [], "index": [], "digest": [], "path": []}).astype({"tree": "int64", "index": "int64"})
        levels = subtree(block["digest"].tolist(), min(STEPS, int(block["height"].iloc[0])))
        rest = _paths(above["path"].iloc[0])
        paths = [_own_path(levels, at) + rest for at in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "index": block["index"], "digest": block["digest"], "path": paths})

    left = _in_superblocks(nodes).select("tree", "block", "index", "digest", "height")
    right = outer.select("tree", F.col("index").alias("block"), "path")
    grouped = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block"))
    return materialize(grouped.applyInPandas(joined, f"tree long, index long, digest string, path {_PATH}"), name)


def _paths(path) -> list[list[str]]:
    return [list(level) for level in path]


def _own_path(levels: list[list[str]], at: int) -> list[list[str]]:
    path = []
    for level in levels[:-1]:
        path.append(siblings(level, at))
        at //= FAN
    return path


def tree_proofs(rounds: list[DataFrame], name: str) -> DataFrame:
    """(tree, index, digest, path) of the first round's nodes, from the last round down."""
    top = rounds[-1].select("tree", "index", "digest", F.array().cast(_PATH).alias("path"))
    for nodes in reversed(rounds[:-1]):
        top = join_proofs(nodes, top, name)
    return top


# --- the manifest -------------------------------------------------------------

def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    A row is a leaf, the SHA-256 of its doc_id, source, lang, n_chars and text. The leaves of a source,
    by doc_id, are hashed in runs of 16 until one is left, its subroot; the subroots by source (null first,
    bytewise) likewise give the root. ``proof_sha256`` digests the siblings up to the root.
    ``folded_root`` is the root that the siblings give with the row as it is after tampering
    (``tampers``), ``verified`` whether this is the root.

    Three levels form a superblock of at most 4096 leaves. Superblocks are reduced to their top nodes, these in
    turn to theirs, and the proofs come down the same way: the leaves of a superblock are cogrouped with the
    outer path of its top node, and one task finishes the local levels, joins the proof and folds
    it. A source of any size is many superblocks; the driver sees no node.

    Rows of one source with the same doc_id are ordered by leaf; equal rows are leaves of their own side by
    side and share leaf, but each has its own proof. A null doc_id comes first and is never tampered
    with; a null source is a tree of its own. Texts are hashed whole; an empty text differs from null. An
    empty table gives an empty result. Columns beside the five are not read.
    """
    leaves, sources = ranked(document_leaves(docs), "source", ["doc_id", "leaf"], "manifest")
    sources = sources.select("source", "first_place", "count", F.lit(0).cast("long").alias("tree"))
    numbered, _ = ranked(sources, "tree", ["first_place"], "manifest-sources")
    numbered = materialize(numbered.select("source", F.col("index").alias("number"), "count"), "manifest-trees")
    total = numbered.count()

    found = F.broadcast(numbered) if total <= 10_000 else numbered
    named = leaves.join(found.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    nodes = materialize(
        named.select(
            "doc_id", "changed", F.col("number").alias("tree"), "index", F.col("leaf").alias("digest"),
            tree_height(F.col("count")).alias("height"),
        ),
        "manifest-leaves",
    )
    rounds = tree_rounds(nodes, "manifest-nodes")
    subroots = rounds[-1].select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), "digest", tree_height(F.lit(total)).alias("height"))
    upper = tree_rounds(subroots, "manifest-tops")
    top = upper[-1].first()
    if top is None:
        return docs.sparkSession.createDataFrame([], _result_schema(docs))
    # the path of every subroot; its tree is the number of its source from here on
    roots = tree_proofs(upper, "manifest-top-proofs").select(
        F.col("index").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper"))
    tops = materialize(
        tree_proofs(rounds[1:] or rounds, "manifest-proofs").select("tree", F.col("index").alias("block"), "path")
        .join(roots, "tree"),
        "manifest-outer",
    )
    return fold_leaves(nodes, tops, top["digest"], _result_schema(docs))


def fold_leaves(nodes: DataFrame, tops: DataFrame, root: str, schema: StructType) -> DataFrame:
    """The manifest's rows: local reduction, proof and fold of every superblock of leaves in one step.

    ``tops`` has (tree, block, path, subroot, upper) of each superblock.
    """
    def folded(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        columns = {name: [] for name in schema.fieldNames()}
        if block.empty:
            return pd.DataFrame(columns)
        block = block.sort_values("index")
        levels = subtree(block["digest"].tolist(), min(STEPS, int(block["height"].iloc[0])))
        outer, upper = _paths(above["path"].iloc[0]), _paths(above["upper"].iloc[0])
        beyond = "".join(d for level in outer + upper for d in level)
        number, subroot = int(block["tree"].iloc[0]), above["subroot"].iloc[0]
        for at, (doc_id, index, leaf, changed) in enumerate(
            zip(block["doc_id"], block["index"], block["digest"], block["changed"])
        ):
            own = _own_path(levels, at)
            top = fold(changed or leaf, int(index), own + outer)
            found = fold(top, number, upper)
            proof = sha("".join(d for level in own for d in level) + beyond)
            for name, value in zip(columns, (doc_id, leaf, subroot, root, proof, found, found == root)):
                columns[name].append(value)
        return pd.DataFrame(columns)

    left = _in_superblocks(nodes).select(
        F.col("doc_id").cast("string").alias("doc_id"), "tree", "block", "index", "digest", "changed", "height")
    # ids travel as text: pandas would turn a nullable integer into a float
    typed = StructType([StructField("doc_id", StringType()), *schema.fields[1:]])
    grouped = left.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block"))
    return grouped.applyInPandas(folded, typed).withColumn("doc_id", F.col("doc_id").cast(schema["doc_id"].dataType))


def _result_schema(docs: DataFrame) -> StructType:
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType),
        *[StructField(n, StringType()) for n in names], StructField("verified", BooleanType()),
    ])
