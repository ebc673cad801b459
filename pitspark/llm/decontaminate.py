"""Benchmark decontamination: a positional inverted index of the training documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitspark.session import materialize

from .text import text_key, unpacked, words

WINDOW = 10
PROBES = 2
TERMS_PER_PASS = 500_000
CHANGED = 1
SLOP = 2


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of ``window`` consecutive words: (item_id, phrase, length, terms).

    An item with fewer words, but not none, is one window. Windows with the same
    words are one row; ``item_ids`` lists the distinct items they stand in.
    ``terms`` holds the distinct words, each with its first offset.
    """
    tokens = items.select("item_id", words(F.col("text")).alias("words"))
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (window - 1)))
    sliced = (
        tokens.where(n > 0)
        .select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start"), window).alias("window_words"))
    )
    return (
        sliced.withColumn("phrase", F.array_join("window_words", " "))
        .select("item_id", "phrase", "window_words").distinct()
    )


def _window_terms(windows: DataFrame) -> DataFrame:
    """Distinct phrases with each distinct word's first offset: (phrase, length, term, offset)."""
    phrases = windows.select("phrase", "window_words").distinct()
    return (
        phrases.select("phrase", F.size("window_words").alias("length"), F.posexplode("window_words").alias("offset", "term"))
        .groupBy("phrase", "length", "term").agg(F.min("offset").alias("offset"))
    )


def _passes(terms: DataFrame, per_pass: int) -> list[DataFrame]:
    """The distinct terms in blocks of at most about ``per_pass``, each broadcast in its turn.

    The bound is checked by a count; more terms make more passes over the
    documents, never a larger broadcast.
    """
    count = terms.count()
    blocks = max(1, -(-count // per_pass))
    if blocks == 1:
        return [F.broadcast(terms)]
    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    return [F.broadcast(terms.where(block == b)) for b in range(blocks)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def term_counts(docs: DataFrame, terms: DataFrame, per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """How often each of ``terms`` (term) stands in all documents: (term, frequency)."""
    stream = docs.select(F.explode(words(F.col("text"))).alias("word"))
    return _union([
        stream.join(block, F.col("word") == F.col("term")).groupBy("term").agg(F.count("*").alias("frequency"))
        for block in _passes(terms, per_pass)
    ])


def probes(docs: DataFrame, windows: DataFrame, count: int = PROBES, per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """The rarest distinct terms of every window: (phrase, length, term, offset, slot, slots).

    A window with a term that stands in no document cannot occur and is left out.
    """
    terms = materialize(_window_terms(windows), "decon-terms")
    frequency = term_counts(docs, terms.select("term").distinct(), per_pass)
    known = terms.join(frequency, "term", "left")
    rarest = W.partitionBy("phrase").orderBy("frequency", "term")
    whole = W.partitionBy("phrase")
    return (
        known.withColumns({
            "slot": F.row_number().over(rarest),
            "slots": F.least(F.count("*").over(whole), F.lit(count)),
            "absent": F.max(F.col("frequency").isNull()).over(whole),
        })
        .where((F.col("slot") <= count) & ~F.col("absent"))
        .select("phrase", "length", "term", "offset", "slot", "slots")
    )


def build_postings(docs: DataFrame, terms: DataFrame, per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """The stored index: (term, doc_id, doc_key, position) for every occurrence of ``terms``.

    Positions count words from 1. ``doc_key`` is a digest of the text, so that
    rows sharing an id keep separate postings; rows equal in both are one.
    """
    stream = docs.select("doc_id", text_key(F.col("text")).alias("doc_key"), words(F.col("text")).alias("words")).select(
        "doc_id", "doc_key", F.posexplode("words").alias("at", "word"),
    )
    found = _union([
        stream.join(block, F.col("word") == F.col("term"))
        .select("term", "doc_id", "doc_key", (F.col("at") + 1).alias("position"))
        for block in _passes(terms.select("term").distinct(), per_pass)
    ])
    return materialize(found, "decon-postings")


def exact_matches(docs: DataFrame, postings: DataFrame, probe: DataFrame) -> DataFrame:
    """Occurrences of whole windows: (doc_id, doc_key, phrase, length, start).

    The lists of a window's rarest terms, each shifted by its offset, meet on
    (document, start). Starts on which all lists agree are then confirmed word by
    word on the document, so rare lists do the work and common words are never listed.
    """
    shifted = postings.join(probe, "term").select(
        "doc_id", "doc_key", "phrase", "length", "slots", (F.col("position") - F.col("offset")).alias("start"),
    ).where(F.col("start") >= 1)
    # a slot has one offset, so a slot gives a start at most once per distinct document row
    agreed = (
        shifted.groupBy("doc_id", "doc_key", "phrase", "length", "slots", "start")
        .agg(F.count("*").alias("lists"))
        .where(F.col("lists") >= F.col("slots"))
    )
    per_doc = agreed.groupBy(F.col("doc_id").alias("c_id"), F.col("doc_key").alias("c_key")).agg(
        F.collect_list(F.struct("phrase", "length", "start")).alias("starts")
    )
    rows = docs.select("doc_id", text_key(F.col("text")).alias("doc_key"), F.col("text"))
    met = rows.join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("doc_key") == F.col("c_key"))
    ).withColumn("words", words(F.col("text")))
    confirmed = F.filter(
        "starts",
        lambda s: F.array_join(F.slice("words", s["start"], s["length"]), " ") == s["phrase"],
    )
    return (
        met.select("doc_id", "doc_key", F.explode(confirmed).alias("hit"))
        .select("doc_id", "doc_key", "hit.phrase", "hit.length", "hit.start")
        .distinct()
    )


def near_probes(
    docs: DataFrame, windows: DataFrame, changed: int = CHANGED, per_pass: int = TERMS_PER_PASS,
) -> DataFrame:
    """The ``changed`` + 2 rarest occurring terms of every window, as ``probes`` has them.

    A term that stands in no document is one of the words that may differ; a window with more of them than
    ``changed``, or so short that too few terms are left, cannot occur nearly and is left out.
    """
    terms = materialize(_window_terms(windows), "decon-near-terms")
    known = terms.join(term_counts(docs, terms.select("term").distinct(), per_pass), "term", "left")
    rarest = W.partitionBy("phrase").orderBy(F.col("frequency").asc_nulls_last(), "term")
    whole = W.partitionBy("phrase")
    count = changed + 2
    return (
        known.withColumns({
            "slot": F.row_number().over(rarest), "present": F.count("frequency").over(whole), "distinct": F.count("*").over(whole),
        })
        .where((F.col("distinct") - F.col("present") <= changed) & (F.col("slot") <= F.least(F.lit(count), F.col("present"))))
        .where((F.col("present") > changed) & (F.col("length") > 2 * changed))
        .select("phrase", "length", "term", "offset", "slot", F.least(F.lit(count), F.col("present")).alias("slots"))
    )


def near_matches(
    docs: DataFrame, windows: DataFrame, changed: int = CHANGED, slop: int = SLOP, per_pass: int = TERMS_PER_PASS,
) -> DataFrame:
    """Places where a window occurs nearly: (doc_id, doc_key, phrase, length, start, shared).

    A window occurs nearly if a run of its length plus ``slop`` words holds all of its words, repeats included, but
    ``changed``. The lists of its rarest terms, shifted by their offsets, are walked once in order per document; where all
    but ``changed`` of them stand within ``slop`` of each other, the words around are compared with the
    window's. ``start`` is the place of the run, ``shared`` the number of words in common.
    """
    docs = docs.select("doc_id", "text")
    probe = materialize(near_probes(docs, windows, changed, per_pass), "decon-near-probes")
    shifted = build_postings(docs, probe, per_pass).distinct().join(probe, "term").withColumn("start", F.col("position") - F.col("offset"))
    so_far = (
        W.partitionBy("doc_id", "doc_key", "phrase").orderBy("start", "slot")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    last_seen = F.array(*[F.max(F.when(F.col("slot") == i, F.col("start"))).over(so_far) for i in range(1, changed + 3)])
    met = shifted.withColumn("seen", last_seen)
    together = F.size(F.filter("seen", lambda x: x >= F.col("start") - slop))
    places = met.where(together >= F.col("slots") - changed).groupBy(F.col("doc_id").alias("c_id"), F.col("doc_key").alias("c_key")).agg(
        F.collect_set(F.struct("phrase", "length", "start")).alias("places"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("doc_key"), words(F.col("text")).alias("words")).distinct()
    around = rows.join(places, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("doc_key") == F.col("c_key"))).select(
        "doc_id", "doc_key", "words", F.explode("places").alias("p"))
    # every run that covers the place: it begins up to ``slop`` words before it
    runs = around.withColumn("start", F.explode(F.sequence(
        F.greatest(F.lit(1), F.col("p.start") - slop), F.greatest(F.lit(1), F.col("p.start")))))
    run = F.slice("words", F.col("start"), F.col("p.length") + slop)
    window = F.split("p.phrase", " ")
    shared = F.aggregate(
        F.array_distinct(window), F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(window, lambda x: x == w)), F.size(F.filter(run, lambda x: x == w))))
    return (
        runs.withColumn("shared", shared).where(F.col("shared") >= F.col("p.length") - changed)
        .groupBy("doc_id", "doc_key", "p.phrase", "p.length", "start").agg(F.max("shared").alias("shared"))
    )


def near_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, doc_key, near_items): documents in which windows of ``items`` occur nearly, with the items' ids.

    Exact occurrences count as near ones, but for windows of at most twice as many words as may differ, which
    ``contamination`` finds. Nulls, repeats and empty tables as there; a document without such a place has no row.
    """
    windows = materialize(item_windows(items.select("item_id", "text"), window), "decon-near-windows")
    found = near_matches(docs, windows, **options)
    return document_items(found, windows).withColumnRenamed("item_ids", "near_items")


def covered_words(matches: DataFrame) -> DataFrame:
    """Words inside any occurrence: (doc_id, doc_key, n_hit), overlaps counted once."""
    end = F.col("start") + F.col("length")
    starts = matches.groupBy("doc_id", "doc_key", "start").agg(F.max(end).alias("end"))
    before = (
        W.partitionBy("doc_id", "doc_key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    )
    fresh = F.greatest(
        F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    )
    return (
        starts.withColumn("fresh", fresh).groupBy("doc_id", "doc_key")
        .agg(F.sum("fresh").cast("long").alias("n_hit"))
    )


def _digest(ids: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(ids), ","), 256)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, probe_count: int = PROBES,
    per_pass: int = TERMS_PER_PASS,
) -> DataFrame:
    """Per document: (doc_id, doc_key, n_words, n_hit, item_ids, n_items, contaminated).

    One row per input row, whole texts, every window of every item. A null or
    wordless text has no words and no hits; a null or wordless item has no
    window; a null item_id counts as an item and is written as an empty string;
    repeated items count once; repeated rows each get their row; an empty table
    on either side gives no hits. Columns beside doc_id, text and item_id are
    not read.
    """
    docs = docs.select("doc_id", "text")
    windows = materialize(
        item_windows(items.select("item_id", "text"), window), "decon-windows"
    )
    probe = materialize(probes(docs, windows, probe_count, per_pass), "decon-probes")
    postings = build_postings(docs, probe, per_pass)
    matches = materialize(exact_matches(docs, postings, probe), "decon-matches")
    items_of = document_items(matches, windows)
    hits = covered_words(matches).join(
        items_of.select(F.col("doc_id").alias("i_id"), F.col("doc_key").alias("i_key"), "item_ids"),
        F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("doc_key") == F.col("i_key")),
    ).select(F.col("doc_id").alias("h_id"), F.col("doc_key").alias("h_key"), "n_hit", "item_ids")
    rows = docs.select(
        "doc_id", text_key(F.col("text")).alias("doc_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    joined = rows.join(
        hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("doc_key") == F.col("h_key")), "left"
    )
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "doc_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"),
        _digest(ids).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def document_items(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, doc_key, item_ids): the sorted items with a window in a document.

    A phrase stands for its list of items, phrases with equal lists for one list; lists are joined
    once for each different set of them that some document meets, so a phrase of many items in many documents
    makes a row for each item or document, not for each pair.
    """
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    per_phrase = materialize(
        windows.groupBy("phrase").agg(F.sort_array(F.collect_set(item)).alias("items"))
        .withColumn("list", F.sha2(F.to_json("items"), 256)),
        "decon-lists",
    )
    lists = per_phrase.groupBy("list").agg(F.first("items").alias("items"))
    met = materialize(
        matches.select("doc_id", "doc_key", "phrase").distinct().join(per_phrase.select("phrase", "list"), "phrase")
        .groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_set("list")).alias("lists")),
        "decon-met",
    )
    sets = met.select("lists").distinct().select("lists", F.explode("lists").alias("list")).join(lists, "list").groupBy("lists").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    return met.join(sets, "lists").select("doc_id", "doc_key", "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without any occurrence of a window of ``items``."""
    found = contamination(docs, items, **options).where("contaminated")
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null "))
    bad = found.select(text_id.alias("id"), F.col("doc_key").alias("key")).distinct()
    # the columns travel in one struct, so no name clashes
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(text_id.alias("id"), text_key(F.col("text")).alias("key"), whole.alias("row"))
    return unpacked(rows.join(bad, ["id", "key"], "left_anti"), docs.columns)
