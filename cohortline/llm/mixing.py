"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected copies are its source's target over its
source's size; the whole part is taken for certain, and the fraction is the inclusion odds of one further
copy. Documents are ranked by their random odds divided by their inclusion odds, and the ranking is followed
until the words that are left to take are used up, so each source's sample has a fixed size in words. The
last document of the ranking that fits only in part gives way to the unchosen document whose size is nearest
to what is left, so a source misses its target by less than that document.

The ranking is never sorted as a whole. Ranks are cut into buckets with one grouping, a running sum over the
buckets of a source finds the bucket where the target is reached, and only that bucket is sorted. Rows with one
document id are one item of the ranking: they are taken or left together, up to the landing document.

Random odds come from a hash of the document id and the seed, so reruns and lost tasks agree.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is the last source; a null
document id is hashed as an empty string; ties in the ranking go to the smaller id; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import WORD, scratch

# Rows of the ranking that share a bucket, on average.
BUCKET_ROWS = 20_000


def sizes(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """One row per document: ``id``, ``source``, ``size`` in words."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``n``, ``target``.

    Weights repeat over the sources in code point order, null last. Targets share ``share`` of all words by weight,
    but none exceeds ``most`` times its source: with sources in order of size over weight, the first ones are
    capped, and the level at which the others share the rest is found with running sums.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighted = per_source.withColumn("weight", listed[F.pmod(place, F.lit(len(weights))).cast("int")])
    full = F.col("source_size") * F.lit(float(most))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum("full").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    found = weighted.withColumn("full", full).withColumn("level", level)
    found = found.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    # The first source in this order that the level at its place does not fill sets the level for all.
    open_level = F.when(F.col("level") * F.col("weight") < F.col("full"), F.struct("place", "level"))
    shared = found.withColumn("common", F.min(open_level).over(Window.partitionBy())["level"])
    portion = F.least(F.col("full"), F.col("common") * F.col("weight"))
    target = F.when(F.col("common").isNull(), F.col("full")).otherwise(portion)
    return shared.select("source", "source_size", "n", target.alias("target"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    sized = scratch(sizes(docs, id_col, source_col))
    # A handful of numbers per source; written, so that the choice below reads it and does not compute it again.
    targets = scratch(source_targets(sized, weights, share, most))
    shares = targets.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("whole"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).alias("buckets"),
    ).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    odds = F.col("left") / F.col("source_size")
    drawn = uniform(F.col("id"), seed)
    rank = (drawn / (1 - drawn)) / (odds / (1 - odds))
    ranked = sized.join(shares, sized["source"].eqNullSafe(F.col("s")), "inner").drop("s")
    ranked = ranked.withColumn("rank", F.when((F.col("left") > 0) & (F.col("size") > 0), rank))

    items = ranked.filter(F.col("rank").isNotNull()).groupBy("source", "id", "rank").agg(
        F.sum("size").alias("words"), F.first("left").alias("left"), F.first("buckets").alias("buckets")
    )
    # Ranks lie between 0 and infinity with median 1 / odds; this keeps their order and spreads them over the buckets.
    place = F.col("rank") / (1 + F.col("rank"))
    items = items.withColumn("bucket", F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1))
    filled = items.groupBy("source", "bucket").agg(F.sum("words").alias("in_bucket"), F.first("left").alias("left"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("taken_before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    crossing = filled.filter(
        (F.col("taken_before") <= F.col("left")) & (F.col("taken_before") + F.col("in_bucket") > F.col("left"))
    ).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "taken_before")

    cut = items.join(crossing, items["source"].eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "inner")
    upto = Window.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last())
    running = F.col("taken_before") + F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    at = F.struct("rank", F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    cut = cut.withColumn("upto", running).withColumn("at", at)
    # The first item that does not fit as a whole, and the words left before it.
    first_out = (
        cut.filter(F.col("upto") > F.col("left"))
        .groupBy("source")
        .agg(F.min_by(F.struct("at", (F.col("left") - (F.col("upto") - F.col("words"))).alias("rest")), "at").alias("stop"))
        .select(F.col("source").alias("s"), F.col("stop.at").alias("stop_at"), F.col("stop.rest").alias("rest"))
    )
    first_out = scratch(first_out)

    beyond = items.withColumn("at", at).join(first_out, items["source"].eqNullSafe(F.col("s")), "inner")
    beyond = beyond.filter(F.col("at") >= F.col("stop_at"))
    landing = beyond.groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("words") - F.col("rest")).alias("miss"), F.col("at").alias("at"), F.col("rest").alias("rest"))).alias("l")
    )
    # Taking the landing item must bring the source nearer to its target than leaving it.
    landing = landing.select(F.col("source").alias("s"), F.when(F.col("l.miss") < F.col("l.rest"), F.col("l.at")).alias("land_at"))
    stops = scratch(
        first_out.join(landing.withColumnRenamed("s", "ls"), F.col("s").eqNullSafe(F.col("ls")), "left").select("s", "stop_at", "land_at")
    )

    row_at = F.struct("rank", F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    out = ranked.join(stops, ranked["source"].eqNullSafe(F.col("s")), "left")
    inside = F.col("stop_at").isNull() | (row_at < F.col("stop_at")) | F.coalesce(row_at == F.col("land_at"), F.lit(False))
    extra = F.when(F.col("rank").isNotNull() & inside, 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("long")
    return out.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture itself: rows of ``docs`` as often as the mix takes them, in the columns of ``docs``.

    Copies are decided per document id; rows that share an id are taken as often as the first of them.
    """
    chosen = mix(docs, id_col=id_col, **options)
    copies = chosen.groupBy(F.col(id_col).alias("_mix_id")).agg(F.max("copies").cast("int").alias("_mix_copies"))
    joined = docs.join(copies.filter("_mix_copies > 0"), docs[id_col].eqNullSafe(F.col("_mix_id")), "inner")
    repeated = joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies"))))
    return repeated.select(*[docs[c] for c in docs.columns])
