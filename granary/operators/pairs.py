"""Similarity pairs: Hamming joins, nearest neighbours by cosine, unions of candidates and crop parents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hamming, unit
from ..functions.ranking import running
from ..functions.storage import ship


def _blocks(known: DataFrame, values: Sequence[str], n: int, block: int) -> DataFrame:
    """Every unordered pair of blocks of about block rows, a block with itself too: (q, c) and each column of both
    blocks as arrays, _x of block q and _y of block c.

    known has item and the values, without nulls. A block is one row, so n * n / block values go through the shuffle.
    """
    blocks = max(1, -(-n // block))
    dealt = known.withColumn("own", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("own").agg(*[F.collect_list(v).alias(v) for v in ("item", *values)])
    left = packed.select(F.col("own").alias("q"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("c"), *[F.col(v).alias(f"{v}_x") for v in ("item", *values)])
    right = packed.select(F.col("own").alias("_c"), *[F.col(v).alias(f"{v}_y") for v in ("item", *values)])
    # A block's row is far larger than the estimate of its table, so it is not to be broadcast.
    return left.join(right.hint("merge"), F.col("c") == F.col("_c")).drop("_c")


def _numbers(lists: pa.ListArray, k: int) -> np.ndarray:
    """Element k of a column of (nested) lists of numbers as one array with a row an entry."""
    found = lists.slice(k, 1).flatten()
    if not pa.types.is_list(found.type):
        return found.to_numpy(zero_copy_only=False)
    flat = found.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(found), -1)


def _near_blocked(known: DataFrame, most: int, n: int, block: int) -> DataFrame:
    """(a, b, dist) of known (item, h), h an array of variant codes, by comparing every pair of blocks once."""
    ship(known.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for row in range(batch.num_rows):
                x, y, hx, hy = (batch.column(names.index(c)) for c in ("item_x", "item_y", "h_x", "h_y"))
                same = batch.column(names.index("q"))[row].as_py() == batch.column(names.index("c"))[row].as_py()
                ix, iy = x.slice(row, 1).flatten(), y.slice(row, 1).flatten()
                one, two = (_numbers(h, row).astype(np.int64).view(np.uint64) for h in (hx, hy))
                for at in range(0, len(ix), 256):
                    part = one[at : at + 256]
                    least = np.full((len(part), len(two)), 65, np.uint8)
                    for k in range(two.shape[1]):
                        np.minimum(least, np.bitwise_count(part[:, 0, None] ^ two[None, :, k]), out=least)
                        if k:
                            np.minimum(least, np.bitwise_count(part[:, k, None] ^ two[None, :, 0]), out=least)
                    i, j = np.nonzero(least <= most)
                    found = pa.RecordBatch.from_arrays([ix.take(pa.array(i + at)), iy.take(pa.array(j)), pa.array(least[i, j].astype(np.int32))], names=["x", "y", "dist"])
                    # The two lists of a block are collected apart, each in an order of its own: only items tell its halves.
                    yield found.filter(pc.less(found.column("x"), found.column("y"))) if same else found

    kind = known.schema["item"].dataType.simpleString()
    met = _blocks(known, ["h"], n, block).mapInArrow(compare, f"x {kind}, y {kind}, dist int")
    return met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")


#: Seconds that one row of a shuffle, one meeting in a join and one comparison within blocks take, roughly: what weighs
#: the two forms of a Hamming join against each other.
ROW_COST, MEETING_COST, COMPARISON_COST = 1e-6, 1e-7, 3e-9


def _volume(size: int, radius: int) -> int:
    return sum(comb(size, r) for r in range(radius + 1))


def _sizes(chunks: int) -> list[int]:
    return [64 // chunks + (k < 64 % chunks) for k in range(chunks)]


def best_chunks(n: int, most: int, variants: int = 1) -> int | None:
    """Into how many chunks n codes are best cut for a join within most bits; None where comparing all in blocks is
    cheaper. Meetings are those of evenly spread codes."""
    cost: dict[int | None, float] = {None: COMPARISON_COST * n * n / 2 * (2 * variants - 1)}
    for chunks in range(1, min(most + 1, 32) + 1):
        sizes, radius = _sizes(chunks), most // chunks
        balls = [_volume(s, radius) for s in sizes]
        if max(balls) <= 4096:
            meetings = n * n * variants * sum(v / 2**s for v, s in zip(balls, sizes, strict=True))
            cost[chunks] = MEETING_COST * meetings + ROW_COST * n * (variants * chunks + sum(balls))
    return min(cost, key=lambda c: cost[c])


def _ball(chunk: int, value: Column, flips: Sequence[int]) -> Column:
    """A chunk's value with each of the flips, as (chunk, value)."""
    return F.transform(F.array(*[F.lit(f).cast("bigint") for f in flips]), lambda f: F.struct(F.lit(chunk).alias("chunk"), value.bitwiseXOR(f).alias("value")))


def _near_joined(left: DataFrame, right: DataFrame, most: int, chunks: int) -> DataFrame:
    """(a, b, code_a, code_b) of left (a, code_a) and right (b, code_b) whose codes are at most so far apart.

    In one of the chunks two such codes differ in at most most // chunks bits. The left emits its chunks, the right the
    balls of that radius around its own; the whole codes verify a meeting. A pair is kept where it meets first.
    """
    sizes, radius, at, parts, balls = _sizes(chunks), most // chunks, 0, [], []
    part = lambda c, at, size: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1).cast("bigint"))
    for k, size in enumerate(sizes):
        parts.append(F.struct(F.lit(k).alias("chunk"), part(F.col("code_a"), at, size).alias("value")))
        flips = sorted(sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(size), r))
        balls.append(_ball(k, part(F.col("code_b"), at, size), [f - (1 << 64) if f >> 63 else f for f in flips]))
        at += size
    one = left.select("a", "code_a", F.explode(F.array(*parts)).alias("p")).select("a", "code_a", "p.chunk", "p.value")
    two = right.select("b", "code_b", F.explode(F.concat(*balls)).alias("p")).select("b", "code_b", "p.chunk", "p.value")
    # Sizes are estimated before rows are exploded, so the balls could be taken for small: the hint forbids a broadcast.
    met = one.join(two.hint("merge"), ["chunk", "value"]).filter(hamming(F.col("code_a"), F.col("code_b")) <= most)
    earlier, at = F.lit(False), 0
    for k, size in enumerate(sizes):
        within = F.bit_count(part(F.col("code_a").bitwiseXOR(F.col("code_b")), at, size)) <= radius
        earlier = earlier | ((F.col("chunk") > k) & within)
        at += size
    return met.filter(~earlier).select("a", "b", "code_a", "code_b")


def hamming_pairs(items: DataFrame, item: str, code: str, most: int, chunks: int | None = None, block: int = 8192) -> DataFrame:
    """(a, b, dist) with a < b of 64-bit codes at most so far apart.

    For selective radii this is an equi-join on chunks of the code, see _near_joined; where balls around chunks cover
    so much of their space that the join would meet more pairs than there are, each pair of blocks of codes is compared
    once (see best_chunks; chunks forces the join). Null codes and items never match. At a radius at which chance pairs
    are frequent the result itself grows with the square of the items.
    """
    known = items.filter(F.col(code).isNotNull() & F.col(item).isNotNull())
    if chunks is None:
        n = known.count()
        chunks = best_chunks(n, most)
        if chunks is None:
            return _near_blocked(known.select(F.col(item).alias("item"), F.array(code).alias("h")), most, n, block)
    sides = (known.select(F.col(item).alias(end), F.col(code).alias(f"code_{end}")) for end in ("a", "b"))
    return _near_joined(*sides, most, chunks).filter("a < b").select("a", "b", hamming(F.col("code_a"), F.col("code_b")).alias("dist"))


def dihedral_pairs(items: DataFrame, item: str, variants: str, most: int, chunks: int | None = None, block: int = 4096) -> DataFrame:
    """(a, b, dist) with a < b of all items whose variant codes are at most so far apart.

    dist is the least distance of the first variant of one to any of the other, both ways. variants: an array of as many
    codes for every item; null arrays never match. Selective radii are joined by chunks, the first variants of one side
    with the balls around all variants of the other; else each pair of blocks is compared once, as in hamming_pairs.
    """
    known = items.filter(F.col(variants).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(variants).alias("h"))
    if chunks is None:
        size = known.agg(F.count("*").alias("n"), F.max(F.size("h")).alias("v")).first()
        chunks = best_chunks(size["n"], most, size["v"] or 1)
        if chunks is None:
            return _near_blocked(known, most, size["n"], block)
    first = known.select(F.col("item").alias("b"), F.get("h", F.lit(0)).alias("code_b"))
    every = known.select(F.col("item").alias("a"), F.explode("h").alias("code_a"))
    met = _near_joined(every, first, most, chunks).filter("a <> b")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(hamming(F.col("code_a"), F.col("code_b"))).alias("dist"))


def across(pairs: DataFrame, items: DataFrame, item: str, split: str) -> DataFrame:
    """pairs with split_a, split_b and cross_split."""
    side = lambda end: items.select(F.col(item).alias(end), F.col(split).alias(f"split_{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cross_split", F.col("split_a") != F.col("split_b"))


def threshold_grid(pairs: DataFrame, value: str, thresholds: Sequence[float], at_most: bool = True) -> DataFrame:
    """(threshold, n) of pairs within each threshold; nulls count in none."""
    test = lambda t: F.col(value) <= t if at_most else F.col(value) >= t
    counts = pairs.agg(*[F.count_if(test(t)).alias(f"c{k}") for k, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{k}").alias("n")) for k, t in enumerate(thresholds)])
    return counts.select(F.inline(rows))


def nearest(items: DataFrame, item: str, vector: str, group: str, k: int = 5, block: int = 2048, n: int | None = None) -> DataFrame:
    """(query, candidate, cosine, rank): the k nearest items of other groups, by cosine, ties by item.

    Exact: items are dealt to blocks of about block rows and every unordered pair of blocks is one matrix product that
    serves both blocks, so a task holds two blocks; the best of all blocks are ranked at the end. Items, vectors and
    groups that are null take no part; a zero vector has no direction and fails the query.
    """
    ship(items.sparkSession)
    base = items.filter(F.col(item).isNotNull() & F.col(vector).isNotNull() & F.col(group).isNotNull())
    n = base.count() if n is None else n
    base = base.select(F.col(item).alias("item"), unit(F.col(vector)).alias("vector"), F.col(group).alias("grp"))

    def tops(sims: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of each row's k best, ties by name."""
        rows, columns = [], []
        for i, row in enumerate(sims):
            edge = np.partition(row, max(len(row) - k, 0))[max(len(row) - k, 0)]
            keep = np.flatnonzero((row >= edge) & np.isfinite(row))
            keep = keep[np.lexsort((names[keep], -row[keep]))][:k]
            rows.append(np.full(len(keep), i))
            columns.append(keep)
        return np.concatenate(rows), np.concatenate(columns)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            for row in range(batch.num_rows):
                x, y = _numbers(col["vector_x"], row), _numbers(col["vector_y"], row)
                ix, iy = col["item_x"].slice(row, 1).flatten(), col["item_y"].slice(row, 1).flatten()
                nx, ny = (v.to_numpy(zero_copy_only=False) for v in (ix, iy))
                gx, gy = _numbers(col["grp_x"], row), _numbers(col["grp_y"], row)
                sims = np.round(x @ y.T, 9)
                sims[gx[:, None] == gy[None, :]] = -np.inf
                i, j = tops(sims, ny)
                yield pa.RecordBatch.from_arrays([ix.take(pa.array(i)), iy.take(pa.array(j)), pa.array(sims[i, j])], names=["query", "candidate", "cosine"])
                if col["q"][row] != col["c"][row]:
                    j, i = tops(sims.T, nx)
                    yield pa.RecordBatch.from_arrays([iy.take(pa.array(j)), ix.take(pa.array(i)), pa.array(sims[i, j])], names=["query", "candidate", "cosine"])

    kind = items.schema[item].dataType.simpleString()
    found = _blocks(base, ["vector", "grp"], n, block).mapInArrow(best, f"query {kind}, candidate {kind}, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "candidate")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def percentiles(df: DataFrame, value: str, ps: Sequence[float]) -> DataFrame:
    """(p, value): exact percentiles by linear interpolation."""
    found = df.agg(F.percentile(value, F.array(*[F.lit(p) for p in ps])).alias("v"))
    return found.select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*[F.lit(p) for p in ps]), F.col("i")).alias("p"), "value")


def percentile_lower(df: DataFrame, value: str, p: float) -> DataFrame:
    """(value): the entry at floor(p * (n - 1)) of the sorted values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    at = int(p * (n - 1)) + 1
    found = running(counts, value, "_n").filter((F.col("upto") >= at) & (F.col("upto") - F.col("_n") < at))
    return found.select(value)


def union_candidates(hashed: DataFrame, embedded: DataFrame) -> DataFrame:
    """(a, b, dist, cosine) over unordered pairs that either source has; the missing side is null."""
    key = lambda d, v, how: d.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(how(v).alias(v))
    return key(hashed, "dist", F.min).join(key(embedded, "cosine", F.max), ["a", "b"], "full")


def add_absent(base: DataFrame, more: DataFrame) -> DataFrame:
    """base and those rows of more whose pair base lacks."""
    missing = more.join(base, ["a", "b"], "left_anti")
    return base.unionByName(missing, allowMissingColumns=True)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shared, only_a, only_b): how two sets of pairs meet."""
    x, y = (d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() for d in (a, b))
    both = x.withColumn("in_a", F.lit(1)).join(y.withColumn("in_b", F.lit(1)), ["a", "b"], "full")
    return both.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def best_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def heads(df: DataFrame, score: str, bands: Sequence[tuple[str, float | None, float | None, int]], *ties: str) -> DataFrame:
    """(band, rank, columns) of the best rows of each band (name, least, most, n), by falling score; bounds are inclusive,
    None for none. Rows of one score are taken in the order of ties, which must be total."""
    out = None
    for name, least, most, n in bands:
        kept = df.filter(F.col(score).isNotNull())
        kept = kept if least is None else kept.filter(F.col(score) >= least)
        kept = kept if most is None else kept.filter(F.col(score) <= most)
        top = kept.orderBy(F.desc(score), *ties).limit(n)
        # At most n rows a band are ranked here.
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *ties))).select(F.lit(name).alias("band"), "rank", *df.columns)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def offset_pick(df: DataFrame, key: str, n: int, skip: int, *order: Column) -> DataFrame:
    """n rows of each key in a total order, without the first skip; a key with too few for that gives its first n."""
    w = Window.partitionBy(key)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    after = F.when(F.col("_n") >= skip + n, skip).otherwise(0)
    return ranked.filter((F.col("_r") > after) & (F.col("_r") <= after + n)).withColumnRenamed("_r", "rank").drop("_n")


def parents_two_phase(crops: DataFrame, others: DataFrame, family: str, score: Column, least: float, near: tuple[str, int] | None = None) -> DataFrame:
    """Best parent of each crop: within its family first, and among all others where the family has none.

    crops and others have item, family and the columns score needs (suffix _c and _o). A score is one of these columns,
    not of the items, and ties go to the lowest item: so only the lowest of the others with equal columns can be a
    parent, and crops with equal columns share theirs. near = (column, most): scores of at least least need that whole
    number within most of the crop's, which makes the second phase an equi-join; without it that is a theta join.
    """
    keys = [x for x in crops.columns if x != "item"]
    kinds = crops.select(*[F.col(x).alias(f"{x}_c") for x in keys]).distinct().withColumn("kind", F.struct(*[f"{x}_c" for x in keys]))
    o = others.groupBy(*keys).agg(F.min("item").alias("item")).select(*[F.col(x).alias(f"{x}_o") for x in [*keys, "item"]])
    scored = lambda d, phase: d.withColumn("score", score).filter(F.col("score") >= least).withColumn("phase", F.lit(phase))
    best = lambda d: best_per(d, "kind", F.desc("score"), F.col("item_o")).select("kind", "item_o", "score", "phase")
    first = best(scored(kinds.join(o, F.col(f"{family}_c") == F.col(f"{family}_o")), "family"))
    left, on = kinds.join(first.select("kind"), "kind", "left_anti"), F.col(f"{family}_c") != F.col(f"{family}_o")
    if near:
        column, most = near
        left, on = left.withColumn("_at", F.explode(F.sequence(F.col(f"{column}_c") - most, F.col(f"{column}_c") + most))), on & (F.col("_at") == F.col(f"{column}_o"))
    second = best(scored(left.join(o, on), "all"))
    found = crops.select(F.col("item").alias("crop"), F.struct(*[F.col(x).alias(f"{x}_c") for x in keys]).alias("kind"))
    return found.join(first.unionByName(second), "kind").select("crop", F.col("item_o").alias("parent"), "score", "phase")


def dispositions(pairs: DataFrame, eligible: DataFrame, item: str) -> DataFrame:
    """pairs with disposition: whether both, one or none of the ends is eligible."""
    known = lambda end: eligible.select(F.col(item).alias(end), F.lit(1).alias(f"_{end}")).distinct()
    joined = pairs.join(known("a"), "a", "left").join(known("b"), "b", "left")
    n = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    return joined.withColumn("disposition", F.when(n == 2, "both").when(n == 1, "one").otherwise("none")).drop("_a", "_b")


def verify_pairs(pairs: DataFrame, kernel, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows of a kernel over pairs: any function from a frame of pairs to a frame, such as a geometric check."""

    ship(pairs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(kernel, frames)

    return pairs.mapInPandas(run, schema)
