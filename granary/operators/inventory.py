"""Inventories: counts per item, pivots, totals, duplicates, balance and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def class_counts(items: DataFrame, boxes: DataFrame, key: str, cls: str, classes: Sequence[str]) -> DataFrame:
    """Boxes of each class, their total and is_background for every item, also those without boxes."""
    counts = boxes.groupBy(key).agg(*[F.count_if(F.col(cls) == c).alias(f"n_{c}") for c in classes], F.count("*").alias("total"))
    names = [f"n_{c}" for c in classes] + ["total"]
    joined = items.join(counts, key, "left").withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in names})
    return joined.withColumn("is_background", F.col("total") == 0)


def background(items: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Items without a box."""
    return items.join(boxes, key, "left_anti")


def pivot(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows by column value, one output column a value."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def with_totals(df: DataFrame, key: str, label: str = "TOTAL") -> DataFrame:
    """Rows by key and a row for all."""
    rolled = df.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, label).otherwise(F.col(key)).alias(key), "n")


def evidence_sets(df: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values of each key, sorted and comma-joined."""
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias("evidence"))


def duplicate_groups(df: DataFrame, content: Column, item: str) -> DataFrame:
    """(digest, n, first_item) of contents that more than one item has."""
    hashed = df.select(F.sha2(content, 256).alias("digest"), F.col(item).alias("item"))
    return hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min("item").alias("first_item")).filter("n > 1")


def duplicates_across(df: DataFrame, content: Column, split: str) -> DataFrame:
    """(digest, n, n_splits) of contents found in more than one split."""
    hashed = df.select(F.sha2(content, 256).alias("digest"), F.col(split).alias("split"))
    return hashed.groupBy("digest").agg(F.count("*").alias("n"), F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def drop_copies(df: DataFrame, content: Column, split: str, item: str) -> DataFrame:
    """Items to drop: copies outside train of a content that train has; else all but the first of a content."""
    w = Window.partitionBy("digest")
    seen = df.select(F.sha2(content, 256).alias("digest"), F.col(split).alias("split"), F.col(item).alias("item"))
    seen = seen.withColumns({"in_train": F.bool_or(F.col("split") == "train").over(w), "first": F.min("item").over(w)})
    return seen.filter((F.col("in_train") & (F.col("split") != "train")) | (~F.col("in_train") & (F.col("item") != F.col("first")))).select("item", "split")


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def size_stats(df: DataFrame, key: str) -> DataFrame:
    """min, quartiles, mean and max of group sizes."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    q = lambda p: F.percentile("size", F.lit(p))
    return sizes.agg(F.count("*").alias("groups"), F.min("size").alias("least"), q(0.25).alias("p25"), q(0.5).alias("p50"), F.round(F.avg("size"), 6).alias("mean"), q(0.75).alias("p75"), F.max("size").alias("most"))


def balance(df: DataFrame, split: str, measures: dict[str, Column]) -> DataFrame:
    """Each split's share of every measure's total, in percent."""
    sums = df.groupBy(split).agg(*[F.sum(m.cast("double")).alias(k) for k, m in measures.items()])
    every = Window.partitionBy()
    return sums.select(split, *[F.round(F.try_divide(100.0 * F.col(k), F.sum(k).over(every)), 6).alias(k) for k in measures])


def recount(table: DataFrame, files: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two tables, or that one lacks."""
    a, b = table.select(key, F.col(value).alias("in_table")), files.select(key, F.col(value).alias("in_files"))
    return a.join(b, key, "full").filter(~F.col("in_table").eqNullSafe(F.col("in_files")))


def list_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key) of rows that only one list has."""
    only = lambda x, y, side: x.select(key).distinct().join(y, key, "left_anti").select(F.lit(side).alias("side"), key)
    return only(a, b, "missing").unionByName(only(b, a, "extra"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unique_by_name(df: DataFrame, name: str) -> DataFrame:
    """One row for each name whatever its case: the one with the least name."""
    w = Window.partitionBy(F.lower(name)).orderBy(name)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_existing(df: DataFrame, stem: str, path: str, extensions: Sequence[str]) -> DataFrame:
    """For each stem the path whose extension comes first in the list."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), ext)
    return df.filter(rank > 0).groupBy(stem).agg(F.min_by(path, F.struct(rank, F.col(path))).alias("path"))
