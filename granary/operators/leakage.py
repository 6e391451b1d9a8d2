"""Leak audit: tiers of copy pairs, decisions, exclusions and what is left across splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tier rule: distances up to STRONG are copies, up to WEAK are to be verified.
STRONG, WEAK = 4, 8
LEAST_INLIERS, LEAST_COVERAGE = 30, 0.5


def tier(dist: Column, verified: Column, backdrop: Column) -> Column:
    """A, B or C; a null distance passes no threshold."""
    seen = F.coalesce(verified, F.lit(False))
    behind = F.coalesce(backdrop, F.lit(False))
    return F.when(dist <= STRONG, "A").when(seen & ~behind, "A").when((dist > STRONG) & (dist <= WEAK), "B").when(seen & behind, "B").otherwise("C")


def reason(dist: Column, verified: Column, backdrop: Column) -> Column:
    """Why a pair has its tier."""
    seen, behind = F.coalesce(verified, F.lit(False)), F.coalesce(backdrop, F.lit(False))
    return F.when(dist <= STRONG, "near hash").when(seen & ~behind, "verified").when((dist > STRONG) & (dist <= WEAK), "middle hash").when(seen & behind, "backdrop").otherwise("far")


def decision(tier_of: Column, cross: Column) -> Column:
    """What is done with a pair."""
    return F.when((tier_of == "A") & cross, "merge").when(tier_of == "A", "merge_within").when((tier_of == "B") & cross, "verify").otherwise("reject")


def accepted(inliers: Column, coverage: Column) -> Column:
    """Whether a verification passes; nulls don't."""
    return F.coalesce((inliers >= LEAST_INLIERS) & (coverage >= LEAST_COVERAGE), F.lit(False))


def after_verification(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """pairs with `verify` decided by (a, b, inliers, coverage); pairs without a result are rejected."""
    joined = pairs.join(results, ["a", "b"], "left")
    return joined.withColumn("decision", F.when(F.col("decision") == "verify", F.when(accepted(F.col("inliers"), F.col("coverage")), "merge").otherwise("reject")).otherwise(F.col("decision")))


def exclusions(pairs: DataFrame, item: str = "item", test: str = "test") -> DataFrame:
    """(item, has_train_copy, has_val_copy) of test items in a merged pair across splits; if both ends are test, a counts."""
    cross = pairs.filter(F.col("split_a") != F.col("split_b"))
    a = cross.filter(F.col("split_a") == test).select(F.col("a").alias(item), F.col("split_b").alias("other"))
    b = cross.filter((F.col("split_b") == test) & (F.col("split_a") != test)).select(F.col("b").alias(item), F.col("split_a").alias("other"))
    return a.unionByName(b).groupBy(item).agg(F.bool_or(F.col("other") == "train").alias("has_train_copy"), F.bool_or(F.col("other") == "val").alias("has_val_copy"))


def without(items: DataFrame, excluded: DataFrame, item: str) -> DataFrame:
    """Items that are not excluded."""
    return items.join(excluded, item, "left_anti")


def residual(pairs: DataFrame, splits: DataFrame, item: str, split: str) -> DataFrame:
    """(split_pair, n): pairs whose ends are in different splits under an assignment."""
    side = lambda end: splits.select(F.col(item).alias(end), F.col(split).alias(f"s_{end}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("s_a <> s_b")
    return joined.groupBy(F.concat_ws("|", F.least("s_a", "s_b"), F.greatest("s_a", "s_b")).alias("split_pair")).agg(F.count("*").alias("n"))


def split_pair_counts(pairs: DataFrame) -> DataFrame:
    """(split_pair, n) over unordered pairs of splits."""
    return pairs.groupBy(F.concat_ws("|", F.least("split_a", "split_b"), F.greatest("split_a", "split_b")).alias("split_pair")).agg(F.count("*").alias("n"))


def ends_by_source(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(source, n): each pair counts once for each of its ends."""
    return pairs.select(F.explode(F.array(a, b)).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def twins(pairs: DataFrame, value: str, thresholds: Sequence[float], measures: DataFrame, item: str, measure: str) -> DataFrame:
    """(threshold, items, total): test items with a train twin within a threshold, and their measure, once an item."""
    marked = pairs.select(F.col("b").alias(item), value, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")).filter(F.col(value) <= F.col("threshold"))
    once = marked.select("threshold", item).distinct().join(measures, item)
    return once.groupBy("threshold").agg(F.count("*").alias("items"), F.sum(measure).alias("total"))


def cross_block(pairs: DataFrame, prefix_a: Column, number_a: Column, prefix_b: Column, number_b: Column, size: int) -> DataFrame:
    """Pairs whose ends are in different blocks."""
    at = lambda p, n: F.struct(p, F.floor(n / size))
    return pairs.filter(at(prefix_a, number_a) != at(prefix_b, number_b))
