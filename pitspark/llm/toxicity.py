"""Toxicity: a chain model tags words, marginals make document scores and spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitspark.session import materialize

from .crf import LOWER, STEMS, WORD, Crf, fit_crf, split_words
from .quality import MAX_LABELS, label_bucket, training_labels
from .text import words

MAX_SEQUENCES = 1_500
MAX_TRAINING_BYTES = 32 << 20
DOCS_PER_STEP = 512


def toxic_lexicon(docs: DataFrame) -> frozenset[str]:
    """Words, and stems with a star, that stand in toxic documents far more than chance allows.

    ``docs`` has (text, label). A word or stem in n documents, a of them toxic, is taken
    if at least half are toxic and the chance of that many (Chernoff bound) is below a
    tenth of one in all tried. So each needs several documents of the labelled sample, which bounds how many there are.
    """
    share = docs.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < share < 1:
        return frozenset()
    distinct = F.array_distinct(words(F.col("text")))
    stems = [
        F.transform(F.filter(distinct, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
        for k in STEMS
    ]
    in_docs = docs.select("label", F.explode(F.array_distinct(F.concat(distinct, *stems))).alias("word"))
    counts = materialize(
        in_docs.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("a")).where(F.col("n") >= 3),
        "toxic-words",
    )
    tried = max(1, counts.count())
    p = F.col("a") / F.col("n")
    distance = p * F.log(p / F.lit(share)) + F.when(p < 1, (1 - p) * F.log((1 - p) / F.lit(1 - share))).otherwise(0.0)
    strength = F.when(p > share, F.col("n") * distance)
    found = (
        counts.where((p >= 0.5) & (strength >= float(np.log(10 * tried))))
        .select("word").collect()
    )
    return frozenset(r[0] for r in found)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_sequences: int = MAX_SEQUENCES,
    max_bytes: int = MAX_TRAINING_BYTES,
) -> Crf:
    """A chain model learnt from labelled documents outside bucket 2 of 4.

    Three documented bounds: the lexicon comes from at most ``max_labels`` labelled
    documents, counted where they are; the chain is fitted on the whole texts of at most
    ``max_sequences`` of them, together at most ``max_bytes`` long, which come to the driver. These are chosen by a hash of
    their id from the sizes alone; a text that no longer fits is passed over.
    """
    chosen = F.broadcast(training_labels(labels, "toxic", 4, 2, max_labels))
    known = materialize(
        docs.select("doc_id", "text").join(chosen, "doc_id")
        .select("doc_id", "text", F.col("label").cast("double").alias("label")),
        "toxic-training",
    )
    lexicon = toxic_lexicon(known)
    rows = sample_sequences(known, max_sequences, max_bytes)
    return fit_crf([r[0] for r in rows], np.array([r[1] for r in rows]), lexicon)


def sample_sequences(known: DataFrame, max_sequences: int, max_bytes: int) -> list[tuple[str | None, float]]:
    """(text, label) of whole documents of ``known`` (doc_id, text, label), bounded in number and bytes."""
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"), "label")
    sized = known.groupBy(place.alias("place")).agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    chosen, left = [], max_bytes
    for r in sized.orderBy("place").limit(max_sequences).collect():
        if r.bytes <= left:
            chosen.append((r.place.h, r.place.t))
            left -= r.bytes
    if not chosen:
        return []
    wanted = F.broadcast(known.sparkSession.createDataFrame(chosen, "h long, t long"))
    texts = known.withColumns({"h": F.xxhash64("doc_id"), "t": F.xxhash64("text")}).join(wanted, ["h", "t"])
    once = texts.groupBy("h", "t").agg(F.first("text").alias("text"), F.first("label").alias("label"), F.min("doc_id").alias("doc_id"))
    rows = once.orderBy("h", "doc_id", "t").select("text", "label").collect()
    return [(r.text, r.label) for r in rows]


def _spans(text: str, marginal: np.ndarray, threshold: float) -> list[dict]:
    """Runs of words at least ``threshold`` toxic, as code-point offsets into the text."""
    toxic = marginal >= threshold
    if not toxic.any():
        return []
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], toxic.astype(np.int8), [0]])))
    return [
        {"start": places[a][0], "end": places[b - 1][1], "score": float(marginal[a:b].max())}
        for a, b in zip(edge[::2], edge[1::2])
    ]


def toxicity_of(model: Crf, span_threshold: float = 0.5):
    """A column function of a text: struct of its score and its toxic spans."""
    @F.arrow_udf("struct<score: double, spans: array<struct<start: int, end: int, score: double>>>")
    def judge(texts: pa.Array) -> pa.Array:
        scores, spans = [], []
        for s in range(0, len(texts), DOCS_PER_STEP):
            part = texts.slice(s, DOCS_PER_STEP).to_pylist()
            marginals = model.tag([split_words(t) for t in part])
            scores += model.score(marginals).tolist() if part else []
            spans += [_spans(t or "", m, span_threshold) for t, m in zip(part, marginals)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], ["score", "spans"])

    return judge


def score_toxicity(docs: DataFrame, model: Crf, threshold: float = 0.3, span_threshold: float = 0.5) -> DataFrame:
    """Per row: (doc_id, held_out, score, predicted, spans) from the whole text.

    Spans are offending runs of words with their offsets in code points. Null, empty and
    wordless texts have no spans and the score of a text without toxic words. A null
    doc_id counts as bucket 0; repeated rows each get their row; an empty table gives an
    empty result; columns beside doc_id and text are not read.
    """
    judged = docs.select("doc_id", toxicity_of(model, span_threshold)("text").alias("judged"))
    return judged.select(
        "doc_id", (label_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("judged.score").alias("score"),
        (F.col("judged.score") >= threshold).cast("int").alias("predicted"), F.col("judged.spans").alias("spans"),
    )
