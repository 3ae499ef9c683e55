"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source has a target number of words. A document's expected copies are its own weight times a level that
is the same for its source, and never more than the most copies allowed: what the heaviest documents cannot
take goes to the others, so that the expected words meet the target. Weights are to have few distinct values
(bands); without them all documents weigh the same. The whole part is certain; the rest is an inclusion probability p, and documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u a hash of the seed and the
document's id. The documents first in rank are taken until the source's remaining words are used up, so the
sample has a fixed size (in words) with unequal probabilities.

The cut is found without sorting a whole source: a histogram of the ranks gives the bucket in which the cut
lies, and only that bucket is sorted. Tables written on the way have a row per source or histogram bucket.

Null ids and null sources are values of their own; rows of one id are taken or left together.
Empty texts have size 0 and are taken 0 words. An empty table gives an empty result. Columns of the input
give way to results of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatrisk.plans.checkpoints import checkpointed
from chatrisk.plans.joins import lookup_join

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKETS = 1 << 16
SEED = "mix"


def text_words(column: str = "text") -> Column:
    """Number of words between ASCII white space; null counts as empty."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), "[ \\x09-\\x0D]+")
    empty_ends = (F.get(parts, F.lit(0)) == "").cast("int") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("int")
    return (F.size(parts) - empty_ends).cast("bigint")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets for sources (source, source_size): shares by weight, none above `most` times its size.

    Weights repeat over the sources by code point, null last. What a capped source cannot take goes to the
    others by weight: with the sources in order of cap over weight, the level (words per weight) is the largest
    that any number of capped sources leaves to the rest.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("_weight", weight.cast("double")).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    order = [(F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("_level", left / rest)
    # The level rises with every source that is rightly capped and falls with the first that is not.
    share = F.least(F.col("_cap"), F.max("_level").over(every) * F.col("_weight"))
    return levels.select("source", "source_size", share.alias("target"))


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED,
    weight: Column | None = None, size: Column | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """`docs` with size, source_size, target, copies and taken (words, repeats counted).

    `weight` (above 0, few distinct values; null: 1) is a document's share of copies next to others of its source,
    `size` replaces the count of its words.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in new]
    sized = docs.select(
        *own, (text_words() if size is None else size).alias("size"),
        (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))).alias("_own"),
        uniform(seed, F.col("doc_id")).alias("_u"),
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
    )
    key = ["_source", "_none"]
    classes = checkpointed(sized.groupBy(*key, "_own").agg(F.sum("size").alias("_size")), "mix-classes")
    sizes = classes.groupBy(*key).agg(F.sum("_size").alias("source_size"))
    named = checkpointed(sizes.withColumn("source", F.when(~F.col("_none"), F.col("_source"))), "mix-sizes")
    targets = with_targets(named, weights, most)
    share = (
        named.join(targets.drop("source_size"), named["source"].eqNullSafe(targets["source"]))
        .select(*key, "source_size", "target")
    )
    share = checkpointed(share.join(_levels(classes.join(share, key), key, most), key), "mix-targets")
    ranked = _ranked(lookup_join(sized, share, key, "inner"), most, buckets)

    # Words left per source after the certain copies, and the bucket of ranks in which they run out.
    histogram = checkpointed(
        ranked.groupBy(*key, "target", "_bucket").agg(
            F.sum("size").alias("_words"), F.sum(F.col("size") * F.col("_whole")).alias("_certain")
        ),
        "mix-ranks",
    )
    left = histogram.groupBy(*key, "target").agg(F.sum("_certain").alias("_certain")).select(
        *key, (F.col("target") - F.col("_certain")).alias("_left")
    )
    up_to = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = histogram.filter(F.col("_bucket").isNotNull()).select(
        *key, "_bucket", (F.sum("_words").over(up_to) - F.col("_words")).alias("_before")
    )
    cuts = (
        running.join(left, key).filter(F.col("_before") < F.col("_left")).groupBy(*key)
        .agg(F.max(F.struct("_bucket", "_before", "_left")).alias("_c"))
        .select(*key, F.col("_c._bucket").alias("_cut"), F.col("_c._before").alias("_before"), F.col("_c._left").alias("_left"))
    )
    cuts = checkpointed(cuts, "mix-cuts")
    inside = lookup_join(ranked, cuts, key, "inner").filter(F.col("_bucket") == F.col("_cut"))
    # Taken while half of it still fits, so that the sum ends at the nearest whole document.
    order = Window.partitionBy(*key).orderBy("_odds").rangeBetween(Window.unboundedPreceding, 0)
    taken = (
        inside.groupBy(*key, "_odds", "_before", "_left").agg(F.sum("size").alias("_words"))
        .withColumn("_run", F.sum("_words").over(order))
        .filter(F.col("_before") + F.col("_run") - F.col("_words") / 2 <= F.col("_left"))
        .groupBy(*key).agg(F.max("_odds").alias("_last"))
    )
    limits = checkpointed(cuts.select(*key, "_cut").join(taken, key, "left"), "mix-limits")
    extra = F.coalesce((F.col("_bucket") < F.col("_cut")) | (F.col("_odds") <= F.col("_last")), F.lit(False)).cast("bigint")
    copies = F.col("_whole") + extra
    return lookup_join(ranked, limits, key).select(
        *own, "size", "source_size", "target", copies.cast("int").alias("copies"),
        (F.col("size") * copies).cast("bigint").alias("taken"),
    )


def _levels(classes: DataFrame, key: list[str], most: int) -> DataFrame:
    """Copies per weight for every source, from its sizes by weight: the heaviest classes that reach `most` copies are
    full, and the level is the largest that any number of full ones leaves to the rest."""
    mass = F.col("_own") * F.col("_size")
    before = Window.partitionBy(*key).orderBy(F.desc("_own")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("_size").over(before), F.lit(0))
    rest = F.sum(mass).over(Window.partitionBy(*key)) - F.coalesce(F.sum(mass).over(before), F.lit(0.0))
    found = classes.withColumn("_level", F.when(rest > 0, left / F.nullif(rest, F.lit(0.0))))
    return found.groupBy(*key).agg(F.max("_level").alias("_level"))


def _ranked(joined: DataFrame, most: int, buckets: int) -> DataFrame:
    """Certain copies (_whole), rank (_odds) and its bucket; no rank where nothing is left to chance."""
    expected = F.coalesce(F.col("_level") * F.col("_own"), F.lit(0.0))
    chance = F.col("_p") > 0
    return (
        joined.withColumn("_expected", F.least(expected, F.lit(float(most))))
        .withColumn("_whole", F.floor("_expected"))
        .withColumn("_p", F.col("_expected") - F.col("_whole"))
        .withColumn("_odds", F.when(chance, (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))))
        .withColumn("_bucket", F.floor(F.col("_odds") / (1 + F.col("_odds")) * buckets).cast("int"))
    )


def materialised(mix: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with copy_no from 0."""
    return mix.filter(F.col("copies") > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
