"""Split construction: stratified, majority, randomised group search, rebalancing and the feasibility gate."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import running
from ..functions.scalars import draw
from ..functions.storage import ship

#: The splits, and the shares that searches aim at and that rebalancing keeps.
SPLITS = ("train", "val", "test")
TARGETS, KEPT = (0.7, 0.15, 0.15), (0.681, 0.165, 0.154)
#: Groups that a search may have; each of its tasks holds the table of groups.
MOST_GROUPS = 200_000


def stratified(items: DataFrame, item: str, stratum: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """items with split: per stratum max(1, round(share * n)) to test, as many to val, the rest to train, in draw order.

    Rounding is half to even.
    """
    w = Window.partitionBy(stratum)
    ordered = w.orderBy(draw(seed, F.col(item)), item)
    n = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * F.lit(share), 0).cast("bigint"))
    placed = items.withColumns({"_n": n, "_r": F.row_number().over(ordered)})
    split = F.when(F.col("_r") <= F.col("_n"), "test").when(F.col("_r") <= 2 * F.col("_n"), "val").otherwise("train")
    return placed.withColumn("split", split).drop("_n", "_r")


def majority(members: DataFrame, component: str, split: str) -> DataFrame:
    """(component, split): the split most members are in; ties go to train, then val, then test."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col(split))
    counts = members.groupBy(component, split).agg(F.count("*").alias("n"))
    w = Window.partitionBy(component).orderBy(F.desc("n"), rank)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(component, split)


def group_stats(items: DataFrame, group: str, measures: Mapping[str, Column], forced: Column | None = None) -> DataFrame:
    """(group, measures.., forced): what a search assigns."""
    flag = F.bool_or(forced if forced is not None else F.lit(False))
    return items.groupBy(group).agg(*[F.sum(m.cast("double")).alias(k) for k, m in measures.items()], flag.alias("forced"))


def assign(order: np.ndarray, sizes: np.ndarray, forced: np.ndarray, targets: np.ndarray, lead: int = 0) -> np.ndarray:
    """Split numbers of groups taken in an order: each goes to the split with the largest deficit of the lead measure."""
    goal = targets * sizes[:, lead].sum()
    held = np.zeros(len(targets))
    out = np.zeros(len(sizes), int)
    held[0] = sizes[forced, lead].sum()
    for g in order:
        if not forced[g]:
            out[g] = int(np.argmax(goal - held))
            held[out[g]] += sizes[g, lead]
    return out


def fill(order: np.ndarray, sizes: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Split numbers of groups taken in an order: val is filled up to its target first, then test; the rest is train."""
    n = sizes[order, 0]
    begun = np.cumsum(n) - n
    val = begun < targets[1] * n.sum()
    test = ~val & (np.cumsum(np.where(val, 0, n)) - n < targets[2] * n.sum())
    out = np.zeros(len(sizes), int)
    out[order[val]], out[order[test]] = 1, 2
    return out


def deviation(split: np.ndarray, sizes: np.ndarray, targets: np.ndarray) -> float:
    """Largest distance between the share of a measure that val or test has and its target."""
    totals = np.where(sizes.sum(0) > 0, sizes.sum(0), 1)
    return max(float(np.abs(sizes[split == k].sum(0) / totals - targets[k]).max()) for k in (1, 2))


def search_groups(stats: DataFrame, group: str, measures: Sequence[str], rounds: int = 20_000, targets: Sequence[float] = TARGETS, seed: int = 42, by_size: bool = False, tasks: int = 16, val_first: bool = False, least_train: float = 0.0, tolerance: float | None = None) -> DataFrame:
    """(group, split, deviation, valid) of the best of many random greedy assignments; every round has a seed of its own.

    by_size: every third round takes groups by decreasing size. val_first: val and then test are filled to their targets
    instead of the split with the largest deficit; groups can't be forced then. Rounds that leave train less than the
    share least_train count only if all do. valid: train has that share, and no measure is further from its target than
    tolerance. The table of groups is checked against MOST_GROUPS
    before it is handed to the tasks; rounds run apart from each other and only their bests come together.
    """
    ship(stats.sparkSession)
    table = stats.orderBy(group).limit(MOST_GROUPS + 1).toPandas()
    if len(table) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups")
    sizes, forced, goal = table[list(measures)].to_numpy(float), table["forced"].to_numpy(bool), np.asarray(targets, float)

    def one(r: int) -> np.ndarray:
        order = np.random.default_rng([seed, r]).permutation(len(sizes))
        if by_size and r % 3 == 0:
            order = order[np.argsort(-sizes[order, 0], kind="stable")]
        return fill(order, sizes, goal) if val_first else assign(order, sizes, forced, goal)

    def score(split: np.ndarray) -> tuple[bool, float]:
        return bool(sizes[split == 0, 0].sum() < least_train * sizes[:, 0].sum()), deviation(split, sizes, goal)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(*score(one(int(r))), int(r)) for r in f["id"]]
            if found:
                yield pd.DataFrame([min(found)], columns=["short", "deviation", "round"])

    if not len(table):
        return stats.sparkSession.createDataFrame([], f"`{group}` string, split string, deviation double, valid boolean")
    best = stats.sparkSession.range(0, rounds, 1, tasks).mapInPandas(run, "short boolean, deviation double, round bigint").orderBy("short", "deviation", "round").first()
    valid = not best["short"] and (tolerance is None or best["deviation"] <= tolerance)
    out = pd.DataFrame({group: table[group], "split": [SPLITS[k] for k in one(best["round"])], "deviation": round(best["deviation"], 9), "valid": valid})
    return stats.sparkSession.createDataFrame(out)


def class_deviation(items: DataFrame, split: str, measures: Mapping[str, Column], targets: Sequence[float] = TARGETS, tolerance: float = 0.03) -> DataFrame:
    """(measure, train, val, test, deviation, achievable): the share of each measure that each split has, and the largest
    distance to the targets; a measure without any instance has shares of zero and is achievable."""
    sums = items.groupBy(F.col(split).alias("_split")).agg(*[F.sum(m.cast("double")).alias(k) for k, m in measures.items()])
    long = sums.select("_split", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in measures])))
    wide = long.groupBy("measure").agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col("_split") == s, F.col("n")).otherwise(0.0)).alias(f"_{s}") for s in SPLITS])
    share = lambda s: F.coalesce(F.try_divide(f"_{s}", "_all"), F.lit(0.0))
    far = F.when(F.coalesce(F.col("_all"), F.lit(0.0)) == 0, 0.0).otherwise(F.greatest(*[F.abs(share(s) - t) for s, t in zip(SPLITS, targets, strict=True)]))
    return wide.select("measure", *[share(s).alias(s) for s in SPLITS], far.alias("deviation"), (far <= tolerance).alias("achievable"))


def choose_block(spark: SparkSession, attempts: Mapping[int, DataFrame], most_deviation: float = 0.03, most_share: float = 0.1) -> int | None:
    """The largest block size whose (deviation, largest_share) row qualifies."""
    for size in sorted(attempts, reverse=True):
        row = attempts[size].first()
        if row["deviation"] <= most_deviation and row["largest_share"] <= most_share:
            return size
    return None


def rebalance(components: DataFrame, component: str, split: str, size: str, movable: str, targets: Sequence[float] = KEPT, tolerance: float = 0.02, passes: int = 2) -> DataFrame:
    """components with new_split and moved: while a share is out of tolerance, movable components go, smallest first,
    from the split with most over its target to the one with most under it, if that brings all closer.

    Sequential by definition, so it works on the table of components, checked against MOST_GROUPS.
    """
    table = components.orderBy(component).limit(MOST_GROUPS + 1).toPandas()
    if len(table) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} components")
    at = np.array([SPLITS.index(s) for s in table[split]], int)
    n, can, goal = table[size].to_numpy(float), table[movable].to_numpy(bool), np.asarray(targets, float)
    whole = max(n.sum(), 1.0)
    shares = np.array([n[at == k].sum() for k in range(3)]) / whole
    old = at.copy()
    for _ in range(passes):
        for g in np.lexsort((np.arange(len(n)), n)):
            gap = shares - goal
            if np.abs(gap).max() <= tolerance:
                break
            src, dst = at[g], int(np.argmin(gap))
            step = n[g] / whole
            if can[g] and src == int(np.argmax(gap)) and src != dst and abs(gap[src] - step) + abs(gap[dst] + step) < abs(gap[src]) + abs(gap[dst]):
                at[g] = dst
                shares[src] -= step
                shares[dst] += step
    table["new_split"] = [SPLITS[k] for k in at]
    table["moved"] = at != old
    return components.sparkSession.createDataFrame(table)


def moved(assignments: DataFrame, old: str, new: str) -> DataFrame:
    """(n, moved): rows, and rows whose split changed."""
    return assignments.agg(F.count("*").alias("n"), F.count_if(F.col(old) != F.col(new)).alias("moved"))


def gate(facts: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row of named conditions, the list of those that fail, and the path taken: A if all hold, else B."""
    failing = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items()]))
    return facts.select(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in conditions.items()], F.array_join(failing, ",").alias("failing"), F.when(F.size(failing) == 0, "A").otherwise("B").alias("path"))


def place_unassigned(items: DataFrame, assigned: DataFrame, item: str, first_group: int) -> DataFrame:
    """(item, split, group_id) of items without an assignment: train, each in a fresh group."""
    rest = running(items.select(item).join(assigned, item, "left_anti"), item)
    return rest.select(F.col(item), F.lit("train").alias("split"), (F.col("upto") + first_group - 1).cast("bigint").alias("group_id"))


def sample_by_draw(items: DataFrame, item: str, k: int, seed: int = 42) -> DataFrame:
    """k items by draw order."""
    return items.orderBy(draw(seed, F.col(item)), item).limit(k)


def sample_pairs_weighted(groups: DataFrame, group: str, size: str, k: int, seed: int = 42) -> DataFrame:
    """(i, group, first, second): k draws of a group with weight n(n-1)/2, and of two different places in it.

    Places are found in the running sum of weights, so groups with one member are never drawn.
    """
    w = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    weight = (F.col(size) * (F.col(size) - 1) / 2).cast("bigint")
    runs = groups.withColumn("_w", weight).filter("_w > 0").withColumn("_to", F.sum("_w").over(w)).withColumn("_from", F.col("_to") - F.col("_w"))
    total = runs.agg(F.max("_to").alias("_total"))
    draws = groups.sparkSession.range(k).select(F.col("id").alias("i")).join(F.broadcast(total)).filter("_total > 0")
    draws = draws.withColumn("_at", draw(seed, F.col("i"), F.lit("group")) % F.col("_total"))
    met = draws.join(runs, (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    first = draw(seed, F.col("i"), F.lit("first")) % F.col(size)
    step = 1 + draw(seed, F.col("i"), F.lit("second")) % (F.col(size) - 1)
    return met.select("i", F.col(group), first.alias("first"), ((first + step) % F.col(size)).alias("second"))
