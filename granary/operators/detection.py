"""Detection metrics as windows: matching, average precision, confusion, slices and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import iou
from ..functions.ranking import running
from ..functions.scalars import draw
from ..functions.storage import discard, ship, stored

#: The ten overlaps of the averaged metric.
OVERLAPS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: Clusters whose draws are made together, and rows that are weighed together: what a core's cache holds.
DRAWN_AT_ONCE, WEIGHED_AT_ONCE = 1 << 16, 1 << 16
#: Rows of a file that tasks read whole, replicates that a task takes at most, and bytes of weights that it holds at most.
FILE_ROWS, TASK_REPLICATES, TASK_BYTES = 1 << 20, 16, 1 << 28


def candidates(det: DataFrame, gt: DataFrame, least: float, same_class: bool = True) -> DataFrame:
    """(image, det, gt, cls, conf, iou) of detections and true boxes of an image that overlap enough.

    det: (image, det, cls, conf, box), gt: (image, gt, cls, box). Boxes of an image meet by an equi-join.
    """
    right = gt.select(F.col("image").alias("_image"), "gt", F.col("cls").alias("gt_cls"), F.col("box").alias("gt_box"))
    on = F.col("image") == F.col("_image")
    if same_class:
        on = on & (F.col("cls") == F.col("gt_cls"))
    met = det.join(right, on).withColumn("iou", iou(F.col("box"), F.col("gt_box")))
    return met.filter(F.col("iou") >= least).select("image", "det", "gt", "cls", "gt_cls", "conf", "iou")


def claims(det: DataFrame, gt: DataFrame, least: float, same_class: bool = True) -> DataFrame:
    """(image, det, gt, cls, gt_cls, conf, iou, taken): the true box that each detection claims.

    A detection claims the true box it overlaps most, ties to the lower one; of its claimants a box takes the most
    confident, ties to the lower one. A detection whose box is taken does not try another. Which box is claimed is the
    same at every overlap; taken is the best overlap among the claimants before, so a claim is won at all overlaps
    over taken and up to iou, whatever overlaps are asked for.
    """
    claim = Window.partitionBy("image", "det").orderBy(F.desc("iou"), "gt")
    before = Window.partitionBy("image", "gt").orderBy(F.desc("conf"), "det").rowsBetween(Window.unboundedPreceding, -1)
    made = candidates(det, gt, least, same_class).withColumn("_c", F.row_number().over(claim)).filter("_c = 1").drop("_c")
    return made.withColumn("taken", F.coalesce(F.max("iou").over(before), F.lit(0.0)))


def matches(det: DataFrame, gt: DataFrame, overlaps: Sequence[float] = OVERLAPS, same_class: bool = True) -> DataFrame:
    """(overlap, image, det, gt, cls, gt_cls, conf, iou) of true positives."""
    won = F.filter(F.array(*[F.lit(t) for t in overlaps]), lambda t: (t > F.col("taken")) & (t <= F.col("iou")))
    return claims(det, gt, min(overlaps), same_class).select(F.explode(won).alias("overlap"), "image", "det", "gt", "cls", "gt_cls", "conf", "iou")


def flag(k: int) -> str:
    """The column that says whether a detection is a true positive at the k-th overlap."""
    return f"tp{k}"


def outcomes(det: DataFrame, gt: DataFrame, overlaps: Sequence[float]) -> DataFrame:
    """det with a column tp0, tp1, .. of zero or one for each overlap: one row a detection."""
    own = claims(det, gt, min(overlaps)).select(F.col("det").alias("_det"), "iou", "taken")
    met = det.join(own, F.col("det") == F.col("_det"), "left")
    won = lambda t: F.when((F.col("taken") < t) & (F.col("iou") >= t), 1).otherwise(0)
    return met.withColumns({flag(k): won(t) for k, t in enumerate(overlaps)}).drop("_det", "iou", "taken")


def dealt_by_confidence(scored: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """scored, stored, with _p: the range of (keys, falling confidence, det) that a row is in; ranges are about even.

    A class may hold any part of all detections, so it is no unit of work; ranges are, and what crosses them is the sums
    and maxima of whole ranges.
    """
    parts = parts or max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(scored.repartitionByRange(parts, *keys, F.desc("conf"), F.col("det")).withColumn("_p", F.spark_partition_id()), "by-confidence")


def precision_curve(scored: DataFrame, truths: DataFrame, keys: Sequence[str], flags: Sequence[str] = ("tp0",)) -> DataFrame:
    """Every detection with precision, recall and envelope along falling confidence, an array of each with an entry a flag.

    scored: keys, det, conf and the flags. truths: keys, n_gt. The envelope is the best precision from there on.
    Running sums and maxima are taken within ranges and carried over by those of the ranges before and behind.
    """
    dealt = dealt_by_confidence(scored.select(*keys, "det", "conf", *flags), keys)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    # One row a range and class that meet, of which there are at most as many as ranges and classes.
    sums = dealt.groupBy("_p", *keys).agg(F.count("*").alias("_n"), *[F.sum(f).alias(f"_s_{f}") for f in flags])
    sums = sums.select("_p", *keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", *[f"_s_{f}" for f in flags])])
    run = Window.partitionBy("_p", *keys).orderBy(F.desc("conf"), "det").rowsBetween(Window.unboundedPreceding, 0)
    # The rows from here on, read from the other end: a frame that begins with the first row is kept up row by row.
    rest = Window.partitionBy("_p", *keys).orderBy(F.asc("conf"), F.desc("det")).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(sums), ["_p", *keys])
    placed = placed.withColumns({"_all": F.count("*").over(run) + F.col("_n"), **{f"_c_{f}": F.sum(f).over(run) + F.col(f"_s_{f}") for f in flags}})
    placed = placed.withColumns({f"_p_{f}": F.col(f"_c_{f}") / F.col("_all").cast("double") for f in flags})
    tops = placed.groupBy("_p", *keys).agg(*[F.max(f"_p_{f}").alias(f"_m_{f}") for f in flags])
    tops = tops.select("_p", *keys, *[F.max(f"_m_{f}").over(behind).alias(f"_m_{f}") for f in flags])
    best = placed.join(F.broadcast(tops), ["_p", *keys])
    best = best.withColumns({f"_e_{f}": F.greatest(F.max(f"_p_{f}").over(rest), F.col(f"_m_{f}")) for f in flags})
    curve = best.join(F.broadcast(truths), list(keys), "left")
    listed = lambda c: F.array(*[c(f) for f in flags])
    recall = listed(lambda f: F.try_divide(F.col(f"_c_{f}").cast("double"), F.col("n_gt").cast("double")))
    return curve.select(*keys, "det", "conf", *flags, listed(lambda f: F.col(f"_p_{f}")).alias("precision"), listed(lambda f: F.col(f"_e_{f}")).alias("envelope"), recall.alias("recall"))


def average_precision(scored: DataFrame, truths: DataFrame, keys: Sequence[str], overlaps: Sequence[float]) -> DataFrame:
    """(overlap, keys, ap): the area under the envelope; zero for a class without a detection or a true box."""
    flags = [flag(k) for k in range(len(overlaps))]
    curve = precision_curve(scored, truths, keys, flags)
    areas = curve.groupBy(*keys).agg(*[F.sum(F.get("envelope", F.lit(k)) * F.col(f)).alias(f"_a_{f}") for k, f in enumerate(flags)])
    ap = lambda f: F.coalesce(F.try_divide(F.col(f"_a_{f}"), F.col("n_gt").cast("double")), F.lit(0.0))
    rows = F.inline(F.array(*[F.struct(F.lit(t).alias("overlap"), ap(f).alias("ap")) for t, f in zip(overlaps, flags, strict=True)]))
    return truths.join(areas, list(keys), "left").select(*keys, rows).select("overlap", *keys, "ap")


def truth_counts(gt: DataFrame) -> DataFrame:
    """(cls, n_gt)."""
    return gt.groupBy("cls").agg(F.count("*").alias("n_gt"))


def ap_by_class(det: DataFrame, gt: DataFrame, overlaps: Sequence[float] = OVERLAPS) -> DataFrame:
    """(overlap, cls, ap)."""
    scored = outcomes(det, gt, overlaps)
    return average_precision(scored, truth_counts(gt), ["cls"], overlaps)


def map_summary(ap: DataFrame, absent: str = "zero") -> DataFrame:
    """(map50, map50_95): means over classes; absent classes count as zero or, with absent = skip, not at all."""
    used = ap if absent == "zero" else ap.filter("ap > 0")
    return used.agg(F.avg(F.when(F.col("overlap") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))


def precision_recall(det: DataFrame, gt: DataFrame, least_conf: float, overlap: float = 0.5, extra: Sequence[str] = ()) -> DataFrame:
    """(cls, tp, fp, fn, precision, recall, f1) of confident detections, with a row `all` over all classes.

    Claims are settled among all detections; confidence is asked afterwards. extra: image columns to slice by.
    """
    hit = matches(det, gt, [overlap]).select("det", F.lit(1).alias("tp"))
    sure = det.filter(F.col("conf") >= least_conf).join(hit, "det", "left").select("cls", *extra, F.coalesce("tp", F.lit(0)).alias("tp"), F.lit(1).alias("n"), F.lit(0).alias("gt"))
    true = gt.select("cls", *extra, F.lit(0).alias("tp"), F.lit(0).alias("n"), F.lit(1).alias("gt"))
    keys = ["cls", *extra]
    both = sure.unionByName(true)
    if extra:
        sums = both.groupBy(*keys)
    else:
        sums = both.rollup("cls")
    out = sums.agg(F.sum("tp").alias("tp"), F.sum(F.col("n") - F.col("tp")).alias("fp"), F.sum(F.col("gt") - F.col("tp")).alias("fn"))
    out = out.withColumn("cls", F.coalesce("cls", F.lit("all")))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion(det: DataFrame, gt: DataFrame, least_conf: float, overlap: float = 0.5, same_class: bool = True) -> DataFrame:
    """(pred, truth, n): matched classes, and `background` for a detection or a true box without a match."""
    sure = det.filter(F.col("conf") >= least_conf)
    hit = matches(sure, gt, [overlap], same_class).select("det", "gt", "cls", "gt_cls")
    pairs = hit.select(F.col("cls").alias("pred"), F.col("gt_cls").alias("truth"))
    false = sure.join(hit.select("det"), "det", "left_anti").select(F.col("cls").alias("pred"), F.lit("background").alias("truth"))
    missed = gt.join(hit.select("gt"), "gt", "left_anti").select(F.lit("background").alias("pred"), F.col("cls").alias("truth"))
    return pairs.unionByName(false).unionByName(missed).groupBy("pred", "truth").agg(F.count("*").alias("n"))


def normalised(matrix: DataFrame, by: str) -> DataFrame:
    """matrix with share: n over the sum of its row (by = pred) or column (by = truth)."""
    return matrix.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(by))))


def columns_hold(matrix: DataFrame, gt: DataFrame) -> DataFrame:
    """(truth, n, n_gt, ok): whether a column's sum is the number of true boxes of its class."""
    sums = matrix.filter("truth <> 'background'").groupBy("truth").agg(F.sum("n").alias("n"))
    counts = gt.groupBy(F.col("cls").alias("truth")).agg(F.count("*").alias("n_gt"))
    return sums.join(counts, "truth", "full").withColumn("ok", F.col("n").eqNullSafe(F.col("n_gt")))


def recall_by(det: DataFrame, gt: DataFrame, bucket: Column, least_conf: float = 0.5, overlap: float = 0.5, any_in_image: bool = False) -> DataFrame:
    """(cls, bucket, n_gt, matched, recall). any_in_image: a box counts if its image has any true positive of its class."""
    sure = det.filter(F.col("conf") >= least_conf)
    hit = matches(sure, gt, [overlap])
    keys = ["image", "cls"] if any_in_image else ["gt"]
    marked = gt.withColumn("bucket", bucket).join(hit.select(*keys, F.lit(1).alias("m")).distinct(), keys, "left")
    out = marked.groupBy("cls", "bucket").agg(F.count("*").alias("n_gt"), F.count("m").alias("matched"))
    return out.withColumn("recall", F.col("matched") / F.col("n_gt"))


def false_positives_on(background: DataFrame, det: DataFrame, confs: Sequence[float], classes: Sequence[str]) -> DataFrame:
    """(conf, image, n_det, n_<class>..) of detections on background images, images without one too."""
    every = background.select("image", F.explode(F.array(*[F.lit(c) for c in confs])).alias("min_conf"))
    met = every.join(det.select("image", "cls", "conf"), "image", "left").withColumn("hit", F.col("conf") >= F.col("min_conf"))
    return met.groupBy("min_conf", "image").agg(F.count_if("hit").alias("n_det"), *[F.count_if(F.col("hit") & (F.col("cls") == c)).alias(f"n_{c}") for c in classes])


def alarm_rate(fp: DataFrame) -> DataFrame:
    """(min_conf, images, alarms, rate)."""
    return fp.groupBy("min_conf").agg(F.count("*").alias("images"), F.count_if(F.col("n_det") > 0).alias("alarms"), F.avg((F.col("n_det") > 0).cast("double")).alias("rate"))


def cluster_shares(gt: DataFrame, cluster: str, most: float = 0.5) -> DataFrame:
    """(cls, clusters, total, largest, share, valid): how far one cluster dominates a class."""
    counts = gt.groupBy("cls", cluster).agg(F.count("*").alias("n"))
    out = counts.groupBy("cls").agg(F.count("*").alias("clusters"), F.sum("n").alias("total"), F.max("n").alias("largest"))
    return out.withColumn("share", F.col("largest") / F.col("total")).withColumn("valid", F.col("share") <= most)


def replicate_weights(clusters: DataFrame, cluster: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, cluster, weight): how often each cluster is drawn when as many as there are are drawn with replacement.

    Draws are numbers from md5; the i-th draw takes the cluster at that place in the order of clusters.
    """
    w = Window.orderBy(cluster)
    placed = clusters.select(cluster).distinct().withColumn("_at", F.row_number().over(w) - 1)
    n = clusters.select(cluster).distinct().agg(F.count("*").alias("_n"))
    reps = clusters.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    draws = reps.join(F.broadcast(n)).filter("_n > 0").select("replicate", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("i"))
    drawn = draws.withColumn("_at", draw(seed, F.col("replicate"), F.col("i")) % F.col("_n"))
    # Sizes are estimated before draws are exploded, so they could be taken for small: the hint forbids a broadcast.
    return drawn.groupBy("replicate", "_at").agg(F.count("*").alias("weight")).join(placed.hint("merge"), "_at").select("replicate", cluster, "weight")


def weights_of_draws(drawn: DataFrame, cluster: str, replicates: int) -> DataFrame:
    """(cluster, w) of rows (replicate, cluster, weight): a byte a replicate."""
    ship(drawn.sparkSession)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(replicates, np.int64)
        w[rows["replicate"]] = rows["weight"]
        return pd.DataFrame({cluster: rows[cluster][:1], "w": [as_bytes(w)]})

    kind = drawn.schema[cluster].dataType.simpleString()
    return drawn.groupBy(cluster).applyInPandas(pack, f"`{cluster}` {kind}, w binary")


def as_bytes(weights: np.ndarray) -> bytes:
    """Weights as bytes; a cluster that is drawn over 255 times is an error, as no fair draw does that."""
    if weights.size and weights.max() > 255:
        raise ValueError("a cluster is drawn over 255 times")
    return weights.astype(np.uint8).tobytes()


def block_draws(upto: np.ndarray, b: int, replicates: int, seed: int) -> np.ndarray:
    """How many of a replicate's draws fall to block b, where upto holds the running sum of blocks' sizes from zero on.

    The draws are halved again and again, each time by a binomial that is seeded by the halves' ends: so every task that
    asks for a block gets the same numbers, all blocks' numbers add up, and no task makes those of all blocks.
    """
    low, high, k = 0, len(upto) - 1, np.full(replicates, upto[-1])
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(k, (upto[middle] - upto[low]) / max(upto[high] - upto[low], 1))
        low, high, k = (low, middle, left) if b < middle else (middle, high, k - left)
    return k


def resampled_weights(clusters: DataFrame, cluster: str, replicates: int, seed: int = 42, block: int = 2048) -> DataFrame:
    """(cluster, w): how often each cluster is drawn, a byte a replicate; as many are drawn as there are, with replacement.

    For any number of clusters: they are dealt to blocks, a block learns how many draws fall to it and deals them out.
    """
    ship(clusters.sparkSession)
    known = clusters.select(cluster).filter(F.col(cluster).isNotNull()).distinct()
    blocks = max(1, -(-known.count() // block))
    dealt = stored(known.withColumn("_b", F.pmod(F.xxhash64(cluster), F.lit(blocks)).cast("int")), "clusters")
    sizes = np.zeros(blocks, np.int64)
    for r in dealt.groupBy("_b").agg(F.count("*").alias("n")).collect():
        sizes[r["_b"]] = r["n"]
    upto = np.concatenate([[0], np.cumsum(sizes)])

    def draw_block(rows: pd.DataFrame) -> pd.DataFrame:
        b, m = int(rows["_b"].iloc[0]), len(rows)
        k = block_draws(upto, b, replicates, seed)
        spots = np.random.default_rng([seed, b, blocks, 1]).integers(0, m, int(k.sum()))
        w = np.bincount(spots * replicates + np.repeat(np.arange(replicates), k), minlength=m * replicates).reshape(m, replicates)
        return pd.DataFrame({cluster: np.sort(rows[cluster].to_numpy()), "w": [as_bytes(x) for x in w]})

    kind = clusters.schema[cluster].dataType.simpleString()
    return dealt.groupBy("_b").applyInPandas(draw_block, f"`{cluster}` {kind}, w binary")


def _curve(block: dict, tp0: np.ndarray, all0: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """(precision, gain) at a block's true positives for some replicates, given the sums of all rows before the block.

    The rows between carry no gain, and precision only falls along them, so their weights are added up.
    """
    ends = np.flatnonzero(block["tp"])
    if not len(ends):
        return np.zeros((1, at.stop - at.start)), np.zeros((1, at.stop - at.start))
    own = block["w"][:, at][block["row"][: ends[-1] + 1]]
    whole = np.cumsum(np.add.reduceat(own, np.concatenate([[0], ends[:-1] + 1]), axis=0, dtype=np.int64), axis=0) + all0[at]
    gain = own[ends].astype(np.float64)
    return np.divide(np.cumsum(gain, axis=0) + tp0[at], whole, out=np.zeros(gain.shape), where=whole > 0), gain


def bootstrap_ap(scored: DataFrame, gt: DataFrame, cluster: str, weights: DataFrame, replicates: int, rows: int = 8192) -> DataFrame:
    """(replicate, cls, ap) with clusters drawn anew for each replicate.

    scored: (cls, det, conf, tp0, cluster), weights: (cluster, w) of the clusters of gt. A replicate gives its clusters'
    rows a weight instead of repeating them. Detections are dealt to blocks of about so many rows along falling
    confidence; a block holds its rows and its clusters' weights, and numpy takes all replicates at once. Three passes
    over the blocks: sums, then best precisions, then areas; between them go a number a block and replicate.
    """
    spark = scored.sparkSession
    ship(spark)
    parts = max(1, -(-scored.count() // rows))
    dealt = dealt_by_confidence(scored.select("cls", "det", "conf", "tp0", F.col(cluster).alias("cluster")), ["cls"], parts)
    weights = stored(weights.select(F.col(cluster).alias("cluster"), "w"), "weights")
    # Names of its own: of columns that both sides of a cogroup share the planner can't tell which is meant.
    needed = dealt.select(F.col("_p").alias("_q"), F.col("cls").alias("of"), "cluster").distinct().join(weights.hint("merge"), "cluster")
    needed = needed.select("_q", "of", F.col("cluster").alias("name"), "w")
    chunks = [slice(at, min(at + 64, replicates)) for at in range(0, replicates, 64)]

    def pack(mine: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        mine = mine[mine["cluster"].isin(drawn["name"])]
        if mine.empty:
            return pd.DataFrame({"cls": [], "_p": [], "tp": [], "row": [], "w": [], "sums": []})
        mine = mine.sort_values(["conf", "det"], ascending=[False, True], kind="stable")
        place = pd.Series(np.arange(len(drawn)), index=drawn["name"])
        row, tp = place.loc[mine["cluster"]].to_numpy(np.int32), mine["tp0"].to_numpy(np.uint8)
        w = np.frombuffer(b"".join(drawn["w"]), np.uint8).reshape(len(drawn), replicates)
        each, hits = np.bincount(row, minlength=len(drawn)), np.bincount(row, weights=tp, minlength=len(drawn))
        sums = np.stack([hits @ w, each @ w]).astype(np.int64)
        return pd.DataFrame({"cls": mine["cls"][:1], "_p": mine["_p"][:1], "tp": [tp.tobytes()], "row": [row.tobytes()], "w": [w.tobytes()], "sums": [sums.tolist()]})

    kind = dealt.schema["cls"].dataType.simpleString()
    blocks = dealt.groupBy("_p", "cls").cogroup(needed.groupBy("_q", "of")).applyInPandas(pack, f"cls {kind}, _p int, tp binary, row binary, w binary, sums array<array<bigint>>")
    blocks = stored(blocks, "blocks")
    each = blocks.select("cls", "_p", F.posexplode(F.arrays_zip(F.get("sums", F.lit(0)).alias("tp"), F.get("sums", F.lit(1)).alias("n"))).alias("r", "s"))
    before = Window.partitionBy("cls", "r").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    begun = each.select("cls", "_p", "r", *[F.coalesce(F.sum(F.col("s")[c]).over(before), F.lit(0)).alias(n) for c, n in (("tp", "tp0"), ("n", "all0"))])
    gathered = lambda df, *names: df.groupBy("cls", "_p").agg(F.sort_array(F.collect_list(F.struct("r", *names))).alias("x")).select("cls", "_p", *[F.col("x")[n].alias(n) for n in names])
    begun = stored(blocks.select("cls", "_p", "tp", "row", "w").join(gathered(begun, "tp0", "all0").hint("merge"), ["cls", "_p"]), "begun")

    def parsed(f: pd.DataFrame) -> Iterator[tuple]:
        for x in f.itertuples(index=False):
            yield x, {"tp": np.frombuffer(x.tp, np.uint8), "row": np.frombuffer(x.row, np.int32), "w": np.frombuffer(x.w, np.uint8).reshape(-1, replicates)}, np.asarray(x.tp0), np.asarray(x.all0)

    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            places = f["_p"].to_list()
            for k, (x, block, tp0, all0) in enumerate(parsed(f)):
                m = np.concatenate([_curve(block, tp0, all0, at)[0].max(axis=0) for at in chunks])
                yield pd.DataFrame({"cls": [x.cls], "_p": [places[k]], "m": [m.tolist()]})

    def areas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            later = f["later"].to_list()
            for k, (x, block, tp0, all0) in enumerate(parsed(f)):
                out = []
                for at in chunks:
                    precision, gain = _curve(block, tp0, all0, at)
                    envelope = np.maximum(np.maximum.accumulate(precision[::-1], axis=0)[::-1], np.asarray(later[k])[at])
                    out.append((envelope * gain).sum(axis=0))
                yield pd.DataFrame({"cls": [x.cls], "area": [np.concatenate(out).tolist()]})

    highest = begun.mapInPandas(tops, f"cls {kind}, _p int, m array<double>").select("cls", "_p", F.posexplode("m").alias("r", "m"))
    behind = Window.partitionBy("cls", "r").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    highest = highest.select("cls", "_p", "r", F.coalesce(F.max("m").over(behind), F.lit(0.0)).alias("later"))
    ended = begun.join(gathered(highest, "later").hint("merge"), ["cls", "_p"]).mapInPandas(areas, f"cls {kind}, area array<double>")
    area = ended.select("cls", F.posexplode("area").alias("replicate", "area")).groupBy("cls", "replicate").agg(F.sum("area").alias("area"))

    def truths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cls, part in f.groupby("cls"):
                w = np.frombuffer(b"".join(part["w"]), np.uint8).reshape(len(part), replicates)
                yield pd.DataFrame({"cls": [cls], "n": [(part["n"].to_numpy(np.int64) @ w).tolist()]})

    counts = gt.groupBy("cls", F.col(cluster).alias("cluster")).agg(F.count("*").alias("n")).join(weights.hint("merge"), "cluster")
    n_gt = counts.select("cls", "n", "w").mapInPandas(truths, f"cls {kind}, n array<bigint>").select("cls", F.posexplode("n").alias("replicate", "n")).groupBy("cls", "replicate").agg(F.sum("n").alias("n_gt"))
    ap = F.coalesce(F.try_divide(F.col("area"), F.col("n_gt").cast("double")), F.lit(0.0))
    return n_gt.join(area, ["cls", "replicate"], "left").select(F.col("replicate").cast("bigint").alias("replicate"), "cls", ap.alias("ap"))


def _drawn(n: int, replicate: int, seed: int) -> Iterator[np.ndarray]:
    """How often each of n places is drawn when n are drawn with replacement, DRAWN_AT_ONCE places at a time."""
    rng = np.random.default_rng([seed, replicate])
    sizes = np.diff(np.append(np.arange(0, n, DRAWN_AT_ONCE), n))
    for m, k in zip(sizes, rng.multinomial(n, sizes / n), strict=True):
        yield np.frombuffer(as_bytes(np.bincount(rng.integers(0, m, k, dtype=np.int32), minlength=m)), np.uint8)


def place_weights(n: int, replicates: Sequence[int], seed: int) -> np.ndarray:
    """A row a place with its weight in each of the replicates, a byte each; the same in any task."""
    out, at = np.empty((n, len(replicates)), np.uint8), 0
    for parts in zip(*(_drawn(n, r, seed) for r in replicates), strict=True):
        out[at : at + len(parts[0])] = np.stack(parts, axis=1)
        at += len(parts[0])
    return out


def _runs(files: Sequence[str], backwards: bool = False) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(class, places, flags) of runs of rows of one class along the files, each of at most WEIGHED_AT_ONCE rows."""
    step = -1 if backwards else 1
    for uri in files[::step]:
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            rows = pq.read_table(f, use_threads=False)
        if not rows.num_rows:
            continue
        coded = rows["cls"].combine_chunks().dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        places, flags = (rows[c].to_numpy() for c in ("place", "tp0"))
        cuts = np.union1d(np.flatnonzero(np.diff(code)) + 1, np.arange(0, len(code), WEIGHED_AT_ONCE))
        for low, high in list(zip(cuts, np.append(cuts[1:], len(code)), strict=True))[::step]:
            if code[low] >= 0:
                yield coded.dictionary[int(code[low])].as_py(), places[low:high].astype(np.intp), np.flatnonzero(flags[low:high])


def replicated_ap(truths: Sequence[str], files: Sequence[str], weights: np.ndarray) -> dict[object, np.ndarray]:
    """The ap of each class of the truths' files for each column of weights, which has a row a place.

    files hold detections along falling confidence within classes. They are read twice: for the sums of whole classes,
    and then from the end, where the sums up to a row are those of its class less what is behind it.
    """
    n = weights.shape[1]
    # A place's weights are one piece of memory, so a row costs one access whatever the replicates.
    sums = lambda at: np.take(weights, at, axis=0).sum(axis=0, dtype=np.int64)
    n_gt, whole, hits, area, best = {}, {}, {}, {}, {}
    for cls, places, _ in _runs(truths):
        n_gt[cls] = n_gt.get(cls, 0) + sums(places)
    for cls, places, ends in _runs(files):
        whole[cls], hits[cls] = whole.get(cls, 0) + sums(places), hits.get(cls, 0) + sums(places[ends])
    for cls, places, ends in _runs(files, backwards=True):
        own, top = area.setdefault(cls, np.zeros(n)), best.setdefault(cls, np.zeros(n))
        for k, w in enumerate(np.ascontiguousarray(np.take(weights, places, axis=0).T)):
            # Bytes of at most WEIGHED_AT_ONCE rows add up to far less than 2^31.
            upto = np.cumsum(w, dtype=np.int32)
            whole[cls][k] -= upto[-1]
            if len(ends):
                gain = w[ends].astype(np.float64)
                found = np.cumsum(gain)
                hits[cls][k] -= int(found[-1])
                every = upto[ends] + whole[cls][k]
                precision = np.divide(found + hits[cls][k], every, out=np.zeros(len(ends)), where=every > 0)
                envelope = np.maximum(np.maximum.accumulate(precision[::-1])[::-1], top[k])
                own[k] += float(envelope @ gain)
                top[k] = envelope[0]
    return {cls: np.divide(area.get(cls, np.zeros(n)), m, out=np.zeros(n), where=m > 0) for cls, m in n_gt.items()}


def bootstrap_ap_drawn(scored: DataFrame, gt: DataFrame, cluster: str, replicates: int, seed: int = 42, file_rows: int | None = None, task_replicates: int | None = None) -> DataFrame:
    """(replicate, cls, ap) with as many clusters as gt has drawn anew for each replicate, with replacement.

    For many clusters: no weight is stored or shuffled. Clusters get places in their order, detections are stored along
    falling confidence with their cluster's place, and a task makes the weights of some replicates, a byte a place, and
    reads all rows for them. More clusters than TASK_BYTES take bootstrap_ap, whose tasks hold blocks of the clusters.
    """
    spark = scored.sparkSession
    ship(spark)
    known = gt.select(F.col(cluster).alias("cluster")).filter("cluster IS NOT NULL").distinct()
    places = stored(running(known, "cluster").select("cluster", (F.col("upto") - 1).cast("int").alias("place")), "places")
    n = places.count()
    if n > TASK_BYTES:
        return bootstrap_ap(scored, gt, cluster, resampled_weights(gt, cluster, replicates, seed), replicates)
    # Sizes of what is joined can be estimated too low: the hint forbids a broadcast.
    placed = lambda d, *columns: d.select(*columns, F.col(cluster).alias("cluster")).join(places.hint("merge"), "cluster").drop("cluster")
    truths = stored(placed(gt, "cls", F.lit(0).cast("byte").alias("tp0")).sortWithinPartitions("cls", "place"), "truths")
    rows = stored(placed(scored, "cls", "det", "conf", F.col("tp0").cast("byte").alias("tp0")), "placed")
    parts = max(1, -(-rows.count() // (file_rows or FILE_ROWS)))
    order = ["cls", F.desc("conf"), F.col("det")]
    dealt = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("cls", "place", "tp0"), "by-confidence")
    discard(rows, places)
    # Files are named by the number of their partition.
    named = lambda d: sorted(d.inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])
    truth_files, files = named(truths), named(dealt)
    each = max(1, min(task_replicates or TASK_REPLICATES, TASK_BYTES // max(n, 1)))
    kind = gt.schema["cls"].dataType

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                mine = range(first, min(first + each, replicates))
                for cls, ap in replicated_ap(truth_files, files, place_weights(n, mine, seed)).items():
                    yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array([cls] * len(mine)), pa.array(ap)], names=["replicate", "cls", "ap"])

    firsts = spark.range(0, replicates, each, max(1, -(-replicates // each)))
    return firsts.mapInArrow(compute, f"replicate long, cls {kind.simpleString()}, ap double")


def interval(replicated: DataFrame, level: float = 0.95) -> DataFrame:
    """(cls, low, high, zero_share): percentile interval and the share of replicates at zero."""
    tail = (1 - level) / 2
    q = F.percentile("ap", F.array(F.lit(tail), F.lit(1 - tail)))
    return replicated.groupBy("cls").agg(q.alias("_q"), F.avg((F.col("ap") == 0).cast("double")).alias("zero_share")).select("cls", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"), "zero_share")


def deltas(base: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base, new, delta_pp): differences in percentage points."""
    a, b = base.select(key, F.col(value).alias("base")), new.select(key, F.col(value).alias("new"))
    return a.join(b, key, "full").withColumn("delta_pp", 100 * (F.col("new") - F.col("base")))
