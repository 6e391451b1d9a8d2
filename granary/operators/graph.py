"""Groups: edge rules, connected components, and what is asked of components."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import discard, stored

#: Parts into which the rows of an item with many edges are dealt.
SALTS = 16


def block_edges(items: DataFrame, item: str, prefix: str, number: Column, size: int) -> DataFrame:
    """(a, b): every item tied to the least item of its block (prefix, number // size)."""
    w = Window.partitionBy(prefix, "_block")
    tied = items.withColumn("_block", F.floor(number / size)).select(F.min(item).over(w).alias("a"), F.col(item).alias("b"))
    return tied.filter("a <> b")


def crop_parent_edges(crops: DataFrame, crop: str, parent: str) -> DataFrame:
    """(a, b): every crop tied to its parent; a crop without one gives no edge."""
    return crops.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("a"), F.col(crop).alias("b")).filter("a <> b").distinct()


def orphan_edges(items: DataFrame, orphans: DataFrame, item: str, prefix: str, number: Column, size: int) -> DataFrame:
    """(a, b): crops without a parent tied to the least crop without one of their block; other items tie nothing."""
    named = orphans.select(F.col(item).alias("_orphan")).distinct()
    return block_edges(items.join(named, F.col(item) == F.col("_orphan"), "left_semi"), item, prefix, number, size)


def group_edges(items: DataFrame, item: str, group: str) -> DataFrame:
    """(a, b): every member of a group tied to the group's least member."""
    least = items.groupBy(F.col(group).alias("_group")).agg(F.min(item).alias("a"))
    return items.join(least, F.col(group) == F.col("_group")).select("a", F.col(item).alias("b")).filter("a <> b")


def merge_groups(items: DataFrame, item: str, group: str, pairs: DataFrame) -> DataFrame:
    """items with component: groups that pairs (a, b) of their members tie are one."""
    return with_components(items, item, group_edges(items, item, group).unionByName(pairs.select("a", "b")))


def prefix_components(pairs: DataFrame, items: DataFrame, item: str, prefix: str) -> DataFrame:
    """(prefix, component) of all prefixes; those that any item pair ties are one component, named by the least."""
    edges = supergraph(pairs, items, item, prefix).select(F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b"))
    known = items.select(F.col(prefix).alias("prefix")).filter("prefix IS NOT NULL").distinct()
    return with_components(known, "prefix", edges)


def crossing_edges(pairs: DataFrame, members: DataFrame, item: str, component: str, split: str) -> DataFrame:
    """(component, edges, crossing): pairs within each component, and those whose ends are in different splits."""
    side = lambda end: members.select(F.col(item).alias(end), F.col(component).alias(f"c_{end}"), F.col(split).alias(f"s_{end}"))
    within = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("c_a = c_b")
    return within.groupBy(F.col("c_a").alias("component")).agg(F.count("*").alias("edges"), F.count_if(F.col("s_a") != F.col("s_b")).alias("crossing"))


def hash_edges(pairs: DataFrame, distance: str, most: int) -> DataFrame:
    """(a, b) of pairs at most so far apart; a null distance never matches."""
    return pairs.filter(F.col(distance) <= most).select("a", "b")


def _star(edges: DataFrame, by: str) -> DataFrame:
    """edges (hi, lo) with m: the least neighbour of column by, of all its neighbours for lo, of its lower ones for hi."""
    if by == "lo":
        seen = edges.select(F.col("lo").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        spread = "hi"
    else:
        seen, spread = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")), "lo"
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("_s", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    salted = edges.withColumn("_t", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(least.hint("merge"), (F.col(by) == F.col("u")) & (F.col("_t") == F.col("_s"))).select("hi", "lo", "m")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(item, component) of the ends of edges (a, b); component is the least item that can be reached.

    Edges from an item to itself tie nothing and are left out, as are rows with a null end. Alternating star rounds:
    every item is tied to the least of its neighbours, first from the lower end, then from the upper one, until the
    edges stay as they are. A hub's rows are dealt by a salt, so none lands in one task whole. A round's edges are a
    table in the shared folder, which the next one replaces; counts and checksums reach the driver.
    Rounds grow with the logarithm of the items.
    """

    def ordered(a: str, b: str, df: DataFrame) -> DataFrame:
        return df.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df stored, with its rows and their checksum, which are taken as it is written."""
        seen = Observation()
        table = stored(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum")), "edges")
        return table, (seen.get["n"], seen.get["sum"])

    now, before = kept(ordered("a", "b", edges))
    for _ in range(most_rounds if before[0] else 0):
        large = ordered("hi", "m", _star(now, "lo"))
        small = _star(large, "hi")
        new, after = kept(ordered("x", "m", small.select(F.explode(F.array("hi", "lo")).alias("x"), "m")))
        discard(now)
        now = new
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("lo").alias("item")).distinct()
    return now.select(F.col("hi").alias("item"), F.col("lo").alias("component")).unionByName(roots.select("item", F.col("item").alias("component")))


def with_components(items: DataFrame, item: str, edges: DataFrame) -> DataFrame:
    """items with component; an item without an edge is its own."""
    found = connected_components(edges).withColumnRenamed("item", "_item")
    return items.join(found, F.col(item) == F.col("_item"), "left").withColumn("component", F.coalesce("component", item)).drop("_item")


def ablation(items: DataFrame, item: str, rules: Mapping[str, DataFrame]) -> DataFrame:
    """(rules, components, largest) as edge rules are added one by one."""
    out, edges, names = None, None, []
    for name, rule in rules.items():
        names.append(name)
        edges = rule if edges is None else edges.unionByName(rule)
        sizes = with_components(items.select(item), item, edges).groupBy("component").agg(F.count("*").alias("n"))
        row = sizes.agg(F.lit("+".join(names)).alias("rules"), F.count("*").alias("components"), F.max("n").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def supergraph(pairs: DataFrame, items: DataFrame, item: str, prefix: str) -> DataFrame:
    """(prefix_a, prefix_b, n): distinct edges between prefixes that item pairs make, with how many make each."""
    side = lambda end: items.select(F.col(item).alias(end), F.col(prefix).alias(f"p_{end}"))
    named = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("p_a <> p_b")
    return named.groupBy(F.least("p_a", "p_b").alias("prefix_a"), F.greatest("p_a", "p_b").alias("prefix_b")).agg(F.count("*").alias("n"))


def anatomy(members: DataFrame, component: str, split: str, prefix: str) -> DataFrame:
    """Members, splits and prefixes of each component."""
    return members.groupBy(component).agg(F.count("*").alias("members"), F.count_distinct(split).alias("splits"), F.count_distinct(prefix).alias("prefixes"))


def spanning(members: DataFrame, component: str, split: str) -> DataFrame:
    """Components whose members are in more than one split."""
    return members.groupBy(component).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("members")).filter("splits > 1")


def rebuild_without(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Components of the edges that did not fail."""
    key = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return connected_components(key(edges).join(key(failed), ["a", "b"], "left_anti"))


def effective_edges(n_items: Column, n_components: Column) -> Column:
    """How many edges joined two components."""
    return n_items - n_components


def dominating(members: DataFrame, component: str, measures: Mapping[str, Column], most: float = 0.15) -> DataFrame:
    """(component, measure, share) of components with over a share of a measure's total."""
    sums = members.groupBy(component).agg(*[F.sum(m.cast("double")).alias(k) for k, m in measures.items()])
    totals = members.agg(*[F.sum(m.cast("double")).alias(f"_t_{k}") for k, m in measures.items()])
    shares = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.try_divide(F.col(k), F.col(f"_t_{k}")).alias("share")) for k in measures]))
    return sums.join(F.broadcast(totals)).select(component, shares.alias("x")).select(component, "x.measure", F.round("x.share", 6).alias("share")).filter(F.col("share") > most)


def fragments(members: DataFrame, component: str, split: str, count: str, name: str = "test") -> DataFrame:
    """Components that hold instances of a class in a split."""
    return members.filter(F.col(split) == name).groupBy(component).agg(F.sum(count).alias("instances")).filter("instances > 0")
