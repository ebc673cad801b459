"""Quality classifier: boosted trees over statistics of whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import Trees, fit_trees

MAX_LABELS = 20_000

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "distinct_words", "top_word", "repeats_previous",
    "distinct_lines", "line_words", "upper", "digit", "white", "comma_stop", "exclamation", "symbol", "bar",
    "non_ascii", "compression", "marked_words", "short_words",
]

_UPPER = slice(ord("A"), ord("Z") + 1)
_DIGIT = slice(ord("0"), ord("9") + 1)
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]
_WHITE = [9, 10, 11, 12, 13, 32]
_PLAIN_END = b".,;:?!'\")"


def statistics(text: str | None) -> list[float]:
    """The numbers in ``STATISTICS`` for one whole text; null is read as empty."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [line for line in raw.split(b"\n") if line]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(c for w, c in seen.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in _PLAIN_END))
    short = sum(c for w, c in seen.items() if len(w) <= 3)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)),
        sum(len(w) * c for w, c in seen.items()) / m, len(seen) / m,
        max(seen.values(), default=0) / m, repeats / m,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
        counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_WHITE].sum() / n,
        (counts[44] + counts[46]) / n, counts[33] / n, counts[_SYMBOLS].sum() / n, counts[124] / n,
        counts[128:].sum() / n, len(zlib.compress(raw, 1)) / n, marked / m, short / m,
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py()) for t in texts]
    return np.array(rows, float).reshape(len(rows), len(STATISTICS))


def label_bucket(doc_id: Column, buckets: int) -> Column:
    """CRC-32 of the id as text, modulo ``buckets``: decides what is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % buckets


def training_labels(labels: DataFrame, column: str, buckets: int, held_out: int, limit: int = MAX_LABELS) -> DataFrame:
    """At most ``limit`` (doc_id, label) rows outside the held-out bucket, by least hash of the id.

    Nulls and ids with contradicting labels are left out; repeated labels count once.
    """
    usable = labels.where(
        F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)
        & (label_bucket(F.col("doc_id"), buckets) != held_out)
    )
    agreed = usable.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("most"))
    return (
        agreed.where(F.col("label") == F.col("most")).drop("most")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELS, **options) -> Trees:
    """Trees fitted on at most ``limit`` labelled documents outside bucket 1 of 3.

    The limit is the only bound: it keeps what the driver holds (``limit`` rows of
    statistics, no text) the same at every size. Statistics are taken where the texts are.
    """
    chosen = F.broadcast(training_labels(labels, "quality", 3, 1, limit))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    measured = rows.select("doc_id", F.col("label").cast("double").alias("label"), measure("text").alias("x"))
    # repeated documents of an id: the first by its statistics
    one = measured.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("row"))
    table = one.orderBy("doc_id").select("row.label", "row.x").toPandas()
    x = np.array(table["x"].tolist(), float).reshape(len(table), len(STATISTICS))
    return fit_trees(x, table["label"].to_numpy(float), **options)


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """Per row: (doc_id, held_out, score, predicted) from the whole text.

    Higher scores mean label 1 likelier. Null and empty texts are scored as empty; a
    null doc_id counts as bucket 0; repeated rows each get their row; an empty table
    gives an empty result; columns beside doc_id and text are not read.
    """
    scored = docs.select("doc_id", quality_score(model)("text").alias("score"))
    return scored.select(
        "doc_id", (label_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def quality_score(model: Trees):
    """A column function of a text: its score under ``model``."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(texts)))

    return score


def keep_quality(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept."""
    return docs.where(quality_score(model)("text") >= threshold)
