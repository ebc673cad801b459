"""Mix sources to target weights at an exact budget of words per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitspark.session import materialize

from .text import TOKEN_BREAK, packed_rows, repeated, token_count, two_digests, unpacked


def source_targets(
    sizes: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0,
) -> DataFrame:
    """Target of each source: ``share`` of all words dealt out by weight, none above
    ``max_epochs`` times its own words.

    ``sizes`` has a row per source: (source, source_size). Sources in code-point
    order, null last, take the weights in turn. With t = min(cap, level * weight)
    the shares of capped sources go to the others; sorted by cap / weight the
    capped ones are a prefix, so the level follows from running sums and no
    round of resharing is run. The windows hold a row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    cap = F.lit(float(max_epochs)) * F.col("source_size").cast("double")
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
        ),
    ).withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    by_ratio = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    leveled = ranked.withColumns({
        "capped_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all_words": F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
    }).withColumn(
        "level",
        (F.lit(float(share)) * F.col("all_words") - F.lit(float(max_epochs)) * F.col("capped_before"))
        / (F.col("all_weight") - F.col("weight_before")),
    )
    # the first source in this order that its level does not fill sets the level for all after it
    final = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    level = F.coalesce(final, F.lit(float("inf")))
    return leveled.withColumn("final_level", level).select(
        "source", "source_size",
        F.least(F.col("cap"), F.col("final_level") * F.col("weight")).alias("target"),
    )


def mix_sources(
    docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """How many words of every document the mix takes: (doc_id, source, size, source_size,
    target, taken, ranked_before, row).

    Every document gets a hash-random key. The rows are range-sorted by source and key, so a source of any size
    lies in many ranges, and so do rows that share a key (a null or repeated doc_id): ranges are cut by
    the row's size and digest too. The running sum of words is the sum of the ranges
    before plus the sum inside the range, so no task holds a source. The mix takes
    whole passes over a source while they fit its target; the last pass is cut at
    the exact word, inside the document that crosses it. Targets are rounded down.

    Equal rows (doc_id, source, text; ``row`` is their digest) are folded with a count first
    and unfolded at the end, so copies of a row never meet in one window. A null text has size 0;
    a null source is a source of its own, the last; a null doc_id is an id like any
    other. An empty table gives an empty result. Extra columns are not read. The
    same input always gives the same mix.
    """
    narrow = docs.select("doc_id", "source", token_count(F.col("text")).alias("size"), _row_digest().alias("row"))
    rows = materialize(
        narrow.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("copies")), "mix-rows",
    ).withColumn(
        "key",
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
    )
    words = F.col("size") * F.col("copies")
    order = ["key", "doc_id", "size", "row"]
    # written with the number of their range, which a second reading could draw otherwise
    sliced = materialize(
        rows.repartitionByRange("source", *order).withColumn("slice", F.spark_partition_id()), "mix-slices")
    ranges = sliced.groupBy("source", "slice").agg(F.sum(words).alias("range_words"))
    ranges = materialize(ranges, "mix-ranges")
    targets = source_targets(
        ranges.groupBy("source").agg(F.sum("range_words").alias("source_size")), weights, share, max_epochs)
    # a row for each range of a source
    earlier = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_words").over(earlier), F.lit(0)))
    plan = materialize(
        offsets.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select(
            F.col("source").alias("plan_source"), F.col("slice").alias("plan_slice"), "offset", "source_size", "target"),
        "mix-plan",
    )
    inside = W.partitionBy("source", "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ordered = sliced.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    placed = ordered.join(
        plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("slice") == F.col("plan_slice")),
    )
    copy = repeated(placed, F.col("copies"), "copy").withColumn(
        "ranked_before", F.col("offset") + F.col("inside") + (F.col("copy") - 1) * F.col("size"),
    )
    budget = F.floor(F.col("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ranked_before")))
    return copy.select(
        "doc_id", "source", "size", "source_size", "target",
        (passes * F.col("size") + last).cast("long").alias("taken"), "ranked_before", "row",
    )


def mixed_documents(
    docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """The rows of ``docs``, all columns, once for each time the mix takes them.

    Whole passes repeat a row; where the mix takes only the first words of a document (one in
    each source), its last copy is these words joined by spaces. Rows of size 0 have nothing to
    take and are left out.
    """
    taken = mix_sources(docs, weights, share, max_epochs, seed).groupBy(F.col("row").alias("key")).agg(
        F.sum("taken").alias("words"), F.first("size").alias("size"),
    ).where(F.col("words") > 0)
    # equal rows share their digest: one of them stands for all, as often as they are taken together
    met = packed_rows(docs, _row_digest()).join(taken, "key")
    copies = F.ceil(F.col("words") / F.col("size"))
    dealt = repeated(met, copies, "copy")
    rest = (F.col("words") % F.col("size")).cast("int")
    cut = (F.col("copy") == copies) & (rest > 0)
    whole = F.col("row.text")
    tokens = F.array_remove(F.split(whole, TOKEN_BREAK), "")
    text = F.when(cut, F.array_join(F.slice(tokens, 1, rest), " ")).otherwise(whole)
    return unpacked(dealt, docs.columns, text=text)


def _row_digest() -> Column:
    return two_digests(F.col("doc_id"), F.col("text"), F.col("source"))
