"""Inputs of the registered queries, derived alike from the driver's tables in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scalars
from ..operators import pairs as pair_ops
from ..sources.readers import table

#: Fixed parameters of the fixtures.
TRAIN, VAL = 70, 85
HASH_RADIUS = 18
CLASSES = ("A", "N", "R")


def split_column(item: Column) -> Column:
    """train, val or test by a hash of the item, 70 : 15 : 15."""
    bucket = F.conv(F.substring(F.md5(item.cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < TRAIN, "train").when(bucket < VAL, "val").otherwise("test")


def split_sql(item: str) -> str:
    bucket = f"(('0x' || substr(md5({item}::varchar), 1, 8))::bigint % 100)"
    return f"CASE WHEN {bucket} < {TRAIN} THEN 'train' WHEN {bucket} < {VAL} THEN 'val' ELSE 'test' END"


def draw_sql(seed: int, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'{k}::varchar' for k in keys)})), 1, 8))::bigint"


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as items: stem, number, prefix, split, labels."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, folder, "labels")
    out = docs.join(labels, "doc_id", "left").withColumn("stem", F.concat_ws("_", "source", "doc_id")).withColumn("split", split_column(F.col("doc_id")))
    return out.withColumns({"prefix": scalars.stem_prefix(F.col("stem")), "number": scalars.stem_number(F.col("stem"))})


ITEMS = f"""items AS (SELECT d.doc_id, d.source, d.lang, d.text, l.quality, l.toxic, d.source || '_' || d.doc_id::varchar AS stem,
  {split_sql("d.doc_id")} AS split, d.source AS prefix, d.doc_id AS number
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def codes(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with their sign bits, group and split."""
    vectors = table(spark, folder, "embeddings")
    return vectors.select("vec_id", "label", "embedding", hashing.sign_bits(F.col("embedding")).alias("code"), split_column(F.col("vec_id")).alias("split"))


CODES = f"""bits AS (SELECT vec_id, label, embedding, {split_sql("vec_id")} AS split,
  list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::hugeint << i ELSE 0::hugeint END FOR i IN range(64)])::hugeint AS u FROM embeddings),
codes AS (SELECT vec_id, label, embedding, split, CASE WHEN u >= 9223372036854775808 THEN (u - 18446744073709551616)::bigint ELSE u::bigint END AS code FROM bits)"""


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors whose codes are near, with splits and cross_split."""
    known = codes(spark, folder)
    return pair_ops.across(pair_ops.hamming_pairs(known, "vec_id", "code", HASH_RADIUS), known, "vec_id", "split")


PAIRS = f"""{CODES},
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.code, b.code))::int AS dist, a.split AS split_a, b.split AS split_b, a.split <> b.split AS cross_split
  FROM codes a JOIN codes b ON a.vec_id < b.vec_id AND bit_count(xor(a.code, b.code)) <= {HASH_RADIUS})"""


def audited(spark: SparkSession, folder: str) -> DataFrame:
    """pairs with the columns of a copy audit: dist on the copy scale, verified and backdrop flags."""
    p = pairs(spark, folder)
    return p.select("a", "b", "split_a", "split_b", "cross_split", F.when(F.col("dist") > 9, F.col("dist") - 10).alias("dist"), ((F.col("a") + F.col("b")) % 5 == 0).alias("verified"), ((F.col("a") + F.col("b")) % 10 == 0).alias("backdrop"))


AUDITED = f"""{PAIRS},
audited AS (SELECT a, b, split_a, split_b, cross_split, CASE WHEN dist > 9 THEN dist - 10 END AS dist, (a + b) % 5 = 0 AS verified, (a + b) % 10 = 0 AS backdrop FROM pairs)"""

TIER = """CASE WHEN dist <= 4 THEN 'A' WHEN verified AND NOT backdrop THEN 'A' WHEN dist > 4 AND dist <= 8 THEN 'B' WHEN verified AND backdrop THEN 'B' ELSE 'C' END"""


def boxes(spark: SparkSession, folder: str, predicted: bool) -> DataFrame:
    """Boxes of orders: odd lines are true, even lines are detections."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    x = (F.col("l_orderkey") * 7 % 200 + F.col("l_suppkey") % 12).cast("double")
    y = (F.col("l_orderkey") * 13 % 200 + F.col("l_partkey") % 10).cast("double")
    w, h = 24.0 + 3 * (F.col("l_orderkey") % 30) + F.col("l_quantity") % 8, 30.0 + 2 * F.col("l_linenumber")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")).alias("box")
    key = (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("det" if predicted else "gt")
    image, cls = F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("cls")
    if predicted:
        conf = ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_orderkey")) % 1000 / 1000.0).alias("conf")
        return lines.filter("l_linenumber % 2 = 0").select(image, key, cls, conf, box)
    return lines.filter("l_linenumber % 2 = 1").select(image, key, cls, box)


BOXES = """lines AS (SELECT l_orderkey AS image, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_linenumber % 2 = 0 AS predicted, l_returnflag AS cls,
  ((l_partkey * 31 + l_suppkey * 17 + l_orderkey) % 1000)::double / 1000.0::double AS conf,
  (l_orderkey * 7 % 200 + l_suppkey % 12)::double AS x1, (l_orderkey * 13 % 200 + l_partkey % 10)::double AS y1,
  24.0::double + 3 * (l_orderkey % 30) + l_quantity % 8 AS w, 30.0::double + 2 * l_linenumber AS h FROM lineitem),
det AS (SELECT image, id AS det, cls, conf, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM lines WHERE predicted),
gt AS (SELECT image, id AS gt, cls, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM lines WHERE NOT predicted),
met AS (SELECT *, (ix * iy) / (ad + ag - ix * iy) AS iou FROM (SELECT d.image, d.det, g.gt, d.cls, d.conf,
    greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0.0::double) AS ix, greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0.0::double) AS iy,
    (d.x2 - d.x1) * (d.y2 - d.y1) AS ad, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag FROM det d JOIN gt g ON d.image = g.image AND d.cls = g.cls))"""


def matched_sql(overlaps: str, pool: str = "met") -> str:
    return f"""cuts AS (SELECT unnest([{overlaps}]::double[]) AS overlap),
claims AS (SELECT o.overlap, m.*, row_number() OVER (PARTITION BY o.overlap, image, det ORDER BY iou DESC, gt) AS c FROM {pool} m JOIN cuts o ON m.iou >= o.overlap),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY overlap, image, gt ORDER BY conf DESC, det) AS t FROM claims WHERE c = 1) WHERE t = 1)"""
