"""Queries on counts, duplicates, names and balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import inventory as ops
from ..sources.readers import table
from . import fixtures as fx

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_item FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return ops.duplicate_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query(f"WITH {fx.ITEMS} SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT split) AS n_splits FROM items GROUP BY 1 HAVING count(DISTINCT split) > 1")
def exact_dup_cross_split(spark, sf_dir):
    return ops.duplicates_across(fx.items(spark, sf_dir), F.col("text"), "split")


@query(f"""WITH {fx.ITEMS}, seen AS (SELECT doc_id, split, bool_or(split = 'train') OVER w AS in_train, min(doc_id) OVER w AS f FROM items WINDOW w AS (PARTITION BY sha256(text)))
SELECT doc_id AS item, split FROM seen WHERE (in_train AND split <> 'train') OR (NOT in_train AND doc_id <> f)""")
def duplicate_drops(spark, sf_dir):
    return ops.drop_copies(fx.items(spark, sf_dir), F.col("text"), "split", "doc_id")


@query(f"WITH {fx.ITEMS} SELECT prefix, split, count(*) AS n FROM items GROUP BY ALL")
def inventory_counts(spark, sf_dir):
    return ops.count_by(fx.items(spark, sf_dir), "prefix", "split")


@query("""WITH c AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_A, count(*) FILTER (l_returnflag = 'N') AS n_N, count(*) FILTER (l_returnflag = 'R') AS n_R, count(*) AS total FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, coalesce(n_A, 0) AS "n_A", coalesce(n_N, 0) AS "n_N", coalesce(n_R, 0) AS "n_R", coalesce(total, 0) AS total, total IS NULL AS is_background FROM orders o LEFT JOIN c USING (o_orderkey)""")
def class_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return ops.class_counts(orders, lines, "o_orderkey", "l_returnflag", fx.CLASSES)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def background_items(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ops.background(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("SELECT source, count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'es') AS n_es, count(*) FILTER (lang = 'fr') AS n_fr, count(*) AS total FROM documents GROUP BY 1")
def class_pivot(spark, sf_dir):
    return ops.pivot(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def totals_rollup(spark, sf_dir):
    return ops.with_totals(table(spark, sf_dir, "documents"), "source")


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS evidence FROM documents GROUP BY 1")
def evidence_sets(spark, sf_dir):
    return ops.evidence_sets(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def size_histogram(spark, sf_dir):
    return ops.size_histogram(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT count(*) AS groups, min(size) AS least, quantile_cont(size, 0.25) AS p25, quantile_cont(size, 0.5) AS p50, round(avg(size), 6) AS mean, quantile_cont(size, 0.75) AS p75, max(size) AS most
FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey)""")
def group_stats(spark, sf_dir):
    return ops.size_stats(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(f"""WITH {fx.ITEMS}, s AS (SELECT split, count(*)::double AS items, sum(coalesce(quality, 0))::double AS quality, sum(coalesce(toxic, 0))::double AS toxic, sum((quality IS NULL)::int)::double AS background FROM items GROUP BY 1)
SELECT split, round(100.0 * items / sum(items) OVER (), 6) AS items, round(100.0 * quality / sum(quality) OVER (), 6) AS quality, round(100.0 * toxic / sum(toxic) OVER (), 6) AS toxic, round(100.0 * background / sum(background) OVER (), 6) AS background FROM s""")
def balance_table(spark, sf_dir):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    measures = {"items": F.lit(1), "quality": zero("quality"), "toxic": zero("toxic"), "background": F.col("quality").isNull().cast("int")}
    return ops.balance(fx.items(spark, sf_dir), "split", measures)


@query("""WITH c AS (SELECT l_orderkey AS k, count(*) AS in_files FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS k, 4::bigint AS in_table FROM orders)
SELECT k, in_table, in_files FROM t FULL JOIN c USING (k) WHERE in_table IS DISTINCT FROM in_files""")
def recount_mismatch(spark, sf_dir):
    told = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("bigint").alias("v"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("v"))
    return ops.recount(told, found, "k", "v")


@query("""SELECT 'missing' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'extra', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def list_mismatch(spark, sf_dir):
    return ops.list_mismatch(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT text AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_items(spark, sf_dir):
    return ops.repeated(table(spark, sf_dir, "documents").select(F.col("text").alias("k")), "k")


@query("SELECT min(p_brand) AS p_brand FROM part GROUP BY lower(p_brand)")
def names_ignoring_case(spark, sf_dir):
    return ops.unique_by_name(table(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand")


@query("""WITH f AS (SELECT p_partkey % 500 AS stem, p_partkey::varchar || CASE p_partkey % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.gif' END AS path FROM part),
r AS (SELECT stem, path, list_position(['jpg', 'png'], lower(regexp_extract(path, '\\.([^.]+)$', 1))) AS k FROM f)
SELECT stem, path FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY k, path) AS n FROM r WHERE k > 0) WHERE n = 1""")
def first_existing(spark, sf_dir):
    key = F.col("p_partkey")
    named = table(spark, sf_dir, "part").select((key % 500).alias("stem"), F.concat(key.cast("string"), F.when(key % 3 == 0, ".JPG").when(key % 3 == 1, ".png").otherwise(".gif")).alias("path"))
    return ops.first_existing(named, "stem", "path", ["jpg", "png"])


@query(f"""WITH {fx.ITEMS} SELECT doc_id, regexp_extract(stem, '^(.+?)_(\\d+)$', 1) AS prefix, regexp_extract(stem, '^(.+?)_(\\d+)$', 2)::bigint AS number,
rtrim(regexp_extract(stem, '^([A-Za-z_]+)', 1), '_') AS letters, coalesce(nullif(regexp_extract(stem, '^([^_0-9]*)', 1), ''), substr(stem, 1, 4)) AS coarse, split_part(stem, '_', 1) AS one, stem AS two, number // 20 AS block FROM items""")
def prefix_variants(spark, sf_dir):
    stem = F.col("stem")
    return fx.items(spark, sf_dir).select("doc_id", scalars.stem_prefix(stem).alias("prefix"), scalars.stem_number(stem).alias("number"), scalars.prefix_letters(stem).alias("letters"), scalars.prefix_coarse(stem).alias("coarse"), scalars.prefix_tokens(stem, 1).alias("one"), scalars.prefix_tokens(stem, 2).alias("two"), scalars.block_of(F.col("number"), 20).alias("block"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 2 ELSE (p_partkey % 4)::int END AS cls FROM part")
def label_remap(spark, sf_dir):
    old = (F.col("p_partkey") % 4).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.remap(old, {0: 0, 1: 1, 3: 2}, [2]).alias("cls"))


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 'own' WHEN 'src1' THEN 'external' ELSE 'unknown' END AS origin, CASE WHEN source = 'src2' THEN 'weak' ELSE lang END AS lang FROM documents WHERE source <> 'src3'")
def source_override(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("source <> 'src3'")
    return docs.select("doc_id", scalars.override(F.col("source"), {"src0": "own", "src1": "external"}, F.lit("unknown")).alias("origin"), F.when(F.col("source") == "src2", "weak").otherwise(F.col("lang")).alias("lang"))


@query(f"""WITH p AS (SELECT doc_id, '/data/images/' || {fx.split_sql("doc_id")} || '/' || source || '.jpg' AS path FROM documents)
SELECT doc_id, replace(replace(path, '/images/', '/labels/'), '.jpg', '.txt') AS label_path, split_part(path, '/', 4) AS split FROM p""")
def paths(spark, sf_dir):
    path = F.concat(F.lit("/data/images/"), fx.split_column(F.col("doc_id")), F.lit("/"), F.col("source"), F.lit(".jpg"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.label_path(path).alias("label_path"), scalars.split_of_path(path).alias("split"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS original, CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS fallback FROM events),
p AS (SELECT event_id, try_strptime(original, '%Y:%m:%d %H:%M:%S') AS o, try_strptime(fallback, '%Y:%m:%d %H:%M:%S') AS f FROM t)
SELECT event_id, coalesce(o, f)::timestamp AS used, CASE WHEN o IS NOT NULL THEN 'original' WHEN f IS NOT NULL THEN 'fallback' ELSE 'none' END AS time_source FROM p""")
def camera_times(spark, sf_dir):
    shown = F.date_format("ts", scalars.DATE_FORMAT)
    o = scalars.camera_time(F.when(F.col("event_id") % 7 == 0, "bad").otherwise(shown))
    f = scalars.camera_time(F.when(F.col("event_id") % 3 == 0, "").otherwise(shown))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(o, f).alias("used"), scalars.time_source(o, f).alias("time_source"))


@query("""SELECT p_partkey, round(100.0 * p_size / nullif(p_partkey % 5, 0), 6) AS pct, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'both' WHEN p_size > 25 THEN 'containment' WHEN p_partkey % 2 = 0 THEN 'resolution' ELSE 'none' END AS evidence,
round(greatest(p_size, 20)::double / least(p_size, 20), 6) AS ratio, round(coalesce(2.0 * p_size * 10 / nullif(p_size + 10, 0), 0.0), 6) AS f1, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END), ''), p_type, 'UNKNOWN') AS named FROM part""")
def scalar_mix(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    blank = F.when(key % 3 == 0, " ").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.percent(size, key % 5), 6).alias("pct"), scalars.evidence(size > 25, key % 2 == 0).alias("evidence"), F.round(scalars.area_ratio(size, F.lit(20)), 6).alias("ratio"), F.round(scalars.f1(size, F.lit(10)), 6).alias("f1"), scalars.first_non_empty(blank, F.col("p_type")).alias("named"))
