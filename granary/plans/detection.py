"""Queries on boxes, matching, precision, confusion, slices and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import detection as ops
from ..sources.readers import table
from . import fixtures as fx

QUERIES, ORACLE_SQL = {}, {}
HALF = "0.5"
TEN = ", ".join(map(str, ops.OVERLAPS))
#: Fixed value: how many replicates an interval rests on.
REPLICATES = 2000


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def sides(spark, sf_dir):
    return fx.boxes(spark, sf_dir, True), fx.boxes(spark, sf_dir, False)


@query(f"WITH {fx.BOXES} SELECT image, det, gt, round(iou, 6) AS iou FROM met WHERE iou >= 0.5")
def iou_pairs(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    return ops.candidates(det, gt, 0.5).select("image", "det", "gt", F.round("iou", 6).alias("iou"))


@query(f"WITH {fx.BOXES}, {fx.matched_sql(TEN)} SELECT overlap, image, det, gt FROM matched")
def greedy_matches(spark, sf_dir):
    return ops.matches(*sides(spark, sf_dir)).select("overlap", "image", "det", "gt")


AP = f"""WITH {fx.BOXES}, {fx.matched_sql(TEN)}, truths AS (SELECT o.overlap, g.cls, count(*) AS n_gt FROM gt g, cuts o GROUP BY ALL),
scored AS (SELECT o.overlap, d.cls, d.det, d.conf, (m.det IS NOT NULL)::int AS tp FROM det d CROSS JOIN cuts o LEFT JOIN matched m ON m.det = d.det AND m.overlap = o.overlap),
run AS (SELECT *, sum(tp) OVER w::double / count(*) OVER w AS precision FROM scored WINDOW w AS (PARTITION BY overlap, cls ORDER BY conf DESC, det ROWS UNBOUNDED PRECEDING)),
env AS (SELECT *, max(precision) OVER (PARTITION BY overlap, cls ORDER BY conf DESC, det ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM run),
ap AS (SELECT t.overlap, t.cls, coalesce(sum(e.envelope * e.tp) / any_value(t.n_gt), 0.0::double) AS ap FROM truths t LEFT JOIN env e ON t.overlap = e.overlap AND t.cls = e.cls GROUP BY t.overlap, t.cls)"""


@query(f"{AP} SELECT overlap, cls, round(ap, 6) AS ap FROM ap")
def ap_by_class(spark, sf_dir):
    return ops.ap_by_class(*sides(spark, sf_dir)).withColumn("ap", F.round("ap", 6))


@query(f"{AP} SELECT round(avg(ap) FILTER (overlap = 0.5), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM ap")
def map_summary(spark, sf_dir):
    return ops.map_summary(ops.ap_by_class(*sides(spark, sf_dir))).select(F.round("map50", 6).alias("map50"), F.round("map50_95", 6).alias("map50_95"))


@query(f"""{AP.replace(TEN, HALF)} SELECT e.cls, e.det, round(sum(e.tp) OVER w / t.n_gt::double, 6) AS recall, round(e.precision, 6) AS precision FROM env e JOIN truths t ON e.cls = t.cls
WINDOW w AS (PARTITION BY e.cls ORDER BY e.conf DESC, e.det ROWS UNBOUNDED PRECEDING)""")
def pr_curve(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    scored = ops.outcomes(det, gt, [0.5])
    curve = ops.precision_curve(scored, ops.truth_counts(gt), ["cls"])
    return curve.select("cls", "det", *[F.round(F.get(c, F.lit(0)), 6).alias(c) for c in ("recall", "precision")])


PRF = f"""WITH {fx.BOXES}, {fx.matched_sql(HALF)}, o AS (SELECT d.cls, (m.det IS NOT NULL)::int AS tp, 1 AS n, 0 AS g FROM det d LEFT JOIN matched m USING (det) WHERE d.conf >= 0.5 UNION ALL SELECT cls, 0, 0, 1 FROM gt),
s AS (SELECT coalesce(cls, 'all') AS cls, sum(tp)::bigint AS tp, sum(n - tp)::bigint AS fp, sum(g - tp)::bigint AS fn FROM o GROUP BY ROLLUP (cls)),
r AS (SELECT *, coalesce(tp::double / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::double / nullif(tp + fn, 0), 0) AS recall FROM s)"""


@query(f"{PRF} SELECT cls, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r")
def prf_at_conf(spark, sf_dir):
    out = ops.precision_recall(*sides(spark, sf_dir), 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {fx.BOXES}, {fx.matched_sql(HALF)}, o AS (SELECT d.cls, d.image % 4 AS slice, (m.det IS NOT NULL)::int AS tp, 1 AS n, 0 AS g FROM det d LEFT JOIN matched m USING (det) WHERE d.conf >= 0.5 UNION ALL SELECT cls, image % 4, 0, 0, 1 FROM gt),
s AS (SELECT cls, slice, sum(tp)::bigint AS tp, sum(n - tp)::bigint AS fp, sum(g - tp)::bigint AS fn FROM o GROUP BY ALL)
SELECT cls, slice, tp, fp, fn, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) AS recall, tp + fn < 50 AS few FROM s""")
def pr_by_source(spark, sf_dir):
    det, gt = (d.withColumn("slice", F.col("image") % 4) for d in sides(spark, sf_dir))
    out = ops.precision_recall(det, gt, 0.5, extra=["slice"])
    return out.select("cls", "slice", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), (F.col("tp") + F.col("fn") < 50).alias("few"))


CONFUSION = f"""WITH {fx.BOXES}, sure AS (SELECT * FROM met WHERE conf >= 0.5), {fx.matched_sql(HALF, "sure")},
matrix AS (SELECT pred, truth, count(*) AS n FROM (SELECT cls AS pred, cls AS truth FROM matched UNION ALL SELECT cls, 'background' FROM det WHERE conf >= 0.5 AND det NOT IN (SELECT det FROM matched) UNION ALL SELECT 'background', cls FROM gt WHERE gt NOT IN (SELECT gt FROM matched)) GROUP BY ALL)"""


@query(f"{CONFUSION} SELECT pred, truth, n FROM matrix")
def confusion(spark, sf_dir):
    return ops.confusion(*sides(spark, sf_dir), 0.5)


@query(f"{CONFUSION} SELECT pred, truth, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM matrix")
def confusion_norm(spark, sf_dir):
    return ops.normalised(ops.confusion(*sides(spark, sf_dir), 0.5), "truth").withColumn("share", F.round("share", 6))


@query(f"{CONFUSION} SELECT pred, truth, n, round(n / sum(n) OVER (PARTITION BY pred), 6) AS share FROM matrix")
def confusion_row_norm(spark, sf_dir):
    return ops.normalised(ops.confusion(*sides(spark, sf_dir), 0.5), "pred").withColumn("share", F.round("share", 6))


@query(f"{CONFUSION}, s AS (SELECT truth, sum(n)::bigint AS n FROM matrix WHERE truth <> 'background' GROUP BY 1), g AS (SELECT cls AS truth, count(*) AS n_gt FROM gt GROUP BY 1) SELECT truth, n, n_gt, n = n_gt AS ok FROM s JOIN g USING (truth)")
def confusion_columns_hold(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    return ops.columns_hold(ops.confusion(det, gt, 0.5), gt)


@query(f"""WITH {fx.BOXES}, sure AS (SELECT image, det, gt, cls, gt_cls, conf, ix * iy / (ad + ag - ix * iy) AS iou FROM (SELECT d.image, d.det, g.gt, d.cls, g.cls AS gt_cls, d.conf, greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0.0::double) AS ix, greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0.0::double) AS iy,
    (d.x2 - d.x1) * (d.y2 - d.y1) AS ad, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag FROM det d JOIN gt g ON d.image = g.image WHERE d.conf >= 0.5)), {fx.matched_sql(HALF, "sure")}
SELECT pred, truth, count(*) AS n FROM (SELECT cls AS pred, gt_cls AS truth FROM matched UNION ALL SELECT cls, 'background' FROM det WHERE conf >= 0.5 AND det NOT IN (SELECT det FROM matched) UNION ALL SELECT 'background', cls FROM gt WHERE gt NOT IN (SELECT gt FROM matched)) GROUP BY ALL""")
def confusion_any_class(spark, sf_dir):
    return ops.confusion(*sides(spark, sf_dir), 0.5, same_class=False)


SIZE = "CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END"


@query(f"""WITH {fx.BOXES}, sure AS (SELECT * FROM met WHERE conf >= 0.5), {fx.matched_sql(HALF, "sure")}
SELECT g.cls, {SIZE.replace("x", "g.x").replace("y", "g.y")} AS bucket, count(*) AS n_gt, count(m.gt) AS matched, round(count(m.gt) / count(*), 6) AS recall FROM gt g LEFT JOIN matched m ON g.gt = m.gt GROUP BY ALL""")
def recall_by_size(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    return ops.recall_by(det, gt, geometry.size_bucket(geometry.area(F.col("box")))).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {fx.BOXES}, sure AS (SELECT * FROM met WHERE conf >= 0.5), {fx.matched_sql(HALF, "sure")}, k AS (SELECT DISTINCT image, cls FROM matched)
SELECT g.cls, {SIZE.replace("x", "g.x").replace("y", "g.y")} AS bucket, count(*) AS n_gt, count(k.cls) AS matched, round(count(k.cls) / count(*), 6) AS recall FROM gt g LEFT JOIN k ON g.image = k.image AND g.cls = k.cls GROUP BY ALL""")
def recall_by_size_any_in_image(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    return ops.recall_by(det, gt, geometry.size_bucket(geometry.area(F.col("box"))), any_in_image=True).withColumn("recall", F.round("recall", 6))


def fp_table(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    # Every fifth order's true boxes are set aside, else no image without one has a detection.
    det = det.withColumn("image", F.when(F.col("image") % 5 == 0, -F.col("image")).otherwise(F.col("image")))
    images = det.filter("image < 0").select("image").distinct().unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")).join(gt, "image", "left_anti"))
    return ops.false_positives_on(images, det, [0.25, 0.5], fx.CLASSES)


FP = f"""WITH {fx.BOXES}, moved AS (SELECT CASE WHEN image % 5 = 0 THEN -image ELSE image END AS image, cls, conf FROM det),
empty AS (SELECT DISTINCT image FROM moved WHERE image < 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT image FROM gt)), c AS (SELECT unnest([0.25, 0.5]::double[]) AS min_conf),
fp AS (SELECT c.min_conf, e.image, count(*) FILTER (d.conf >= c.min_conf) AS n_det, count(*) FILTER (d.conf >= c.min_conf AND d.cls = 'A') AS "n_A", count(*) FILTER (d.conf >= c.min_conf AND d.cls = 'N') AS "n_N", count(*) FILTER (d.conf >= c.min_conf AND d.cls = 'R') AS "n_R" FROM empty e CROSS JOIN c LEFT JOIN moved d ON e.image = d.image GROUP BY c.min_conf, e.image)"""


@query(f"{FP} SELECT * FROM fp")
def background_fp_table(spark, sf_dir):
    return fp_table(spark, sf_dir)


@query(f"{FP} SELECT min_conf, count(*) AS images, count(*) FILTER (n_det > 0) AS alarms, round(avg((n_det > 0)::int), 6) AS rate FROM fp GROUP BY 1")
def background_alarm_rate(spark, sf_dir):
    return ops.alarm_rate(fp_table(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"""{AP}, part AS (SELECT overlap, cls, ap FROM ap), half AS (SELECT cls, ap AS base FROM part WHERE overlap = 0.5), strict AS (SELECT cls, ap AS new FROM part WHERE overlap = 0.75)
SELECT cls, round(base, 6) AS base, round(new, 6) AS new, round(100 * (new - base), 6) AS delta_pp FROM half JOIN strict USING (cls)""")
def metric_delta(spark, sf_dir):
    ap = ops.ap_by_class(*sides(spark, sf_dir), [0.5, 0.75])
    out = ops.deltas(ap.filter("overlap = 0.5"), ap.filter("overlap = 0.75"), "cls", "ap")
    return out.withColumns({c: F.round(c, 6) for c in ("base", "new", "delta_pp")})


@query(f"""WITH {fx.BOXES}, c AS (SELECT cls, image % 20 AS cluster, count(*) AS n FROM gt GROUP BY ALL)
SELECT cls, count(*) AS clusters, sum(n)::bigint AS total, max(n) AS largest, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) <= 0.5 AS valid FROM c GROUP BY 1""")
def cluster_validity(spark, sf_dir):
    gt = fx.boxes(spark, sf_dir, False).withColumn("cluster", F.col("image") % 20)
    return ops.cluster_shares(gt, "cluster").withColumn("share", F.round("share", 6))


def bootstrap_sql(cluster: str, replicates: int = REPLICATES) -> str:
    return f"""WITH {fx.BOXES}, {fx.matched_sql(HALF)},
scored AS (SELECT d.cls, d.det, d.conf, (m.det IS NOT NULL)::int AS tp, {cluster.replace("image", "d.image")} AS cluster FROM det d LEFT JOIN matched m USING (det)),
places AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS p FROM (SELECT DISTINCT {cluster} AS cluster FROM gt)), n AS (SELECT count(*) AS n FROM places),
draws AS (SELECT r.range AS replicate, {fx.draw_sql(42, "r.range", "i.range")} % n.n AS p FROM range({replicates}) r, n, range((SELECT n FROM n)) i),
weights AS (SELECT replicate, cluster, count(*) AS weight FROM draws JOIN places USING (p) GROUP BY ALL),
truths AS (SELECT replicate, cls, sum(c * weight)::bigint AS n_gt FROM (SELECT cls, {cluster} AS cluster, count(*) AS c FROM gt GROUP BY ALL) JOIN weights USING (cluster) GROUP BY ALL),
every AS (SELECT r.range AS replicate, c.cls, coalesce(t.n_gt, 0) AS n_gt FROM range({replicates}) r CROSS JOIN (SELECT DISTINCT cls FROM gt) c LEFT JOIN truths t ON t.replicate = r.range AND t.cls = c.cls),
rows_ AS (SELECT w.replicate, s.cls, s.det, s.conf, s.tp, w.weight FROM scored s JOIN weights w USING (cluster)),
run AS (SELECT *, sum(tp * weight) OVER w::double / sum(weight) OVER w::double AS precision FROM rows_ WINDOW w AS (PARTITION BY replicate, cls ORDER BY conf DESC, det ROWS UNBOUNDED PRECEDING)),
env AS (SELECT *, max(precision) OVER (PARTITION BY replicate, cls ORDER BY conf DESC, det ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM run),
ap AS (SELECT e.replicate, e.cls, coalesce(sum(x.envelope * x.tp * x.weight) / nullif(any_value(e.n_gt), 0)::double, 0.0::double) AS ap FROM every e LEFT JOIN env x ON e.replicate = x.replicate AND e.cls = x.cls GROUP BY e.replicate, e.cls)
SELECT cls, round(quantile_cont(ap, 0.025), 6) AS low, round(quantile_cont(ap, 0.975), 6) AS high, avg((ap = 0)::int) AS zero_share FROM ap GROUP BY 1"""


def bootstrap(spark, sf_dir, cluster, replicated):
    det, gt = sides(spark, sf_dir)
    gt = gt.withColumn("cluster", cluster)
    scored = ops.outcomes(det, gt, [0.5]).withColumn("cluster", cluster)
    out = ops.interval(replicated(scored, gt))
    return out.select("cls", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "zero_share")


@query(bootstrap_sql("image % 20"))
def bootstrap_ci_cluster(spark, sf_dir):
    weights = lambda gt: ops.weights_of_draws(ops.replicate_weights(gt, "cluster", REPLICATES), "cluster", REPLICATES)
    return bootstrap(spark, sf_dir, F.col("image") % 20, lambda scored, gt: ops.bootstrap_ap(scored, gt, "cluster", weights(gt), REPLICATES))


@query()
def bootstrap_ci_item(spark, sf_dir):
    """Each image is a cluster. Its draws come from seeded generators, which SQL has not; brute force is in the tests."""
    return bootstrap(spark, sf_dir, F.col("image"), lambda scored, gt: ops.bootstrap_ap_drawn(scored, gt, "cluster", REPLICATES))


@query(f"""WITH {fx.BOXES}, {fx.matched_sql(HALF)} SELECT d.det, d.conf, round((x2 - x1) * (y2 - y1), 6) AS pixels, round(least(x1, y1, 640 - x2, 640 - y2), 6) AS edge FROM det d WHERE d.det NOT IN (SELECT det FROM matched) ORDER BY d.conf DESC, d.det LIMIT 12""")
def error_gallery(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    wrong = det.join(ops.matches(det, gt, [0.5]).select("det"), "det", "left_anti")
    edge = geometry.edge_distance(F.col("box.x1"), F.col("box.y1"), F.col("box.x2"), F.col("box.y2"), F.lit(640.0), F.lit(640.0))
    return wrong.select("det", "conf", F.round(geometry.area(F.col("box")), 6).alias("pixels"), F.round(edge, 6).alias("edge")).orderBy(F.desc("conf"), "det").limit(12)


@query(f"""WITH {fx.BOXES}, {fx.matched_sql(HALF)} SELECT gt, cls, round((x2 - x1) * (y2 - y1), 6) AS pixels FROM gt WHERE gt NOT IN (SELECT gt FROM matched) ORDER BY (x2 - x1) * (y2 - y1), gt LIMIT 12""")
def smallest_missed(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    missed = gt.join(ops.matches(det, gt, [0.5]).select("gt"), "gt", "left_anti").withColumn("pixels", geometry.area(F.col("box")))
    return missed.orderBy("pixels", "gt").limit(12).select("gt", "cls", F.round("pixels", 6).alias("pixels"))


@query(f"""WITH {fx.BOXES} SELECT gt, greatest(least(x1, 200.0), 0.0)::int AS x1, greatest(least(y1, 200.0), 0.0)::int AS y1, greatest(least(x2, 200.0), 0.0)::int AS x2, greatest(least(y2, 200.0), 0.0)::int AS y2 FROM (SELECT gt, trunc(x1) AS x1, trunc(y1) AS y1, trunc(x2) AS x2, trunc(y2) AS y2 FROM gt)""")
def crop_rectangles(spark, sf_dir):
    gt = fx.boxes(spark, sf_dir, False)
    return gt.select("gt", *geometry.crop_rectangle(F.col("box.x1"), F.col("box.y1"), F.col("box.x2"), F.col("box.y2"), F.lit(200.0), F.lit(200.0)))


def filtered_sql() -> str:
    return AP.replace("FROM lineitem)", "FROM lineitem WHERE l_orderkey % 7 <> 0)")


@query(f"""SELECT scope, round(map50, 6) AS map50, round(map50_95, 6) AS map50_95 FROM (SELECT 'full' AS scope, * FROM ({AP} SELECT avg(ap) FILTER (overlap = 0.5) AS map50, avg(ap) AS map50_95 FROM ap)
UNION ALL SELECT 'filtered', * FROM ({filtered_sql()} SELECT avg(ap) FILTER (overlap = 0.5), avg(ap) FROM ap))""")
def full_vs_filtered(spark, sf_dir):
    det, gt = sides(spark, sf_dir)
    kept = F.col("image") % 7 != 0
    out = None
    for scope, d, g in (("full", det, gt), ("filtered", det.filter(kept), gt.filter(kept))):
        row = ops.map_summary(ops.ap_by_class(d, g)).select(F.lit(scope).alias("scope"), F.round("map50", 6).alias("map50"), F.round("map50_95", 6).alias("map50_95"))
        out = row if out is None else out.unionByName(row)
    return out
