"""Queries through sources and sinks: files are written to the shared folder from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, hashing, scalars
from ..functions.storage import new_path
from ..operators import checks, pairs as pair_ops
from ..sources import readers, writers
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


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def csv_round_trip(spark, sf_dir):
    """Some columns of a table as CSV with a header, read under a schema."""
    path = new_path(spark, "csv")
    writers.csv_out(table(spark, sf_dir, "orders"), path, ["o_orderkey", "o_orderpriority", "o_totalprice"])
    return readers.csv_table(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")


@query("SELECT n_nationkey AS epoch, n_regionkey + 0.5::double AS loss, n_regionkey > 1 AS better FROM nation")
def padded_log(spark, sf_dir):
    """A training log with padded names and values; the column of the loss is found by a part of its name."""
    path = new_path(spark, "log")
    nations = table(spark, sf_dir, "nation")
    line = F.format_string("  %d,   %d.5 ,  %s", "n_nationkey", "n_regionkey", F.when(F.col("n_regionkey") > 1, "True").otherwise("False"))
    head = spark.range(1).select(F.lit(-1).alias("at"), F.lit("  epoch,   train/loss ,  better").alias("value"))
    lines = head.unionByName(nations.select(F.col("n_nationkey").alias("at"), line.alias("value")))
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    log = readers.padded_csv(spark, path)
    loss = readers.find_column(log, "val/loss", "loss")
    return log.select(F.col("epoch").cast("int").alias("epoch"), F.col(f"`{loss}`").cast("double").alias("loss"), readers.truth(F.col("better")).alias("better"))


def _labels(spark, sf_dir) -> str:
    """A folder a nation with a line for each of its suppliers; every fourth line lacks its last number."""
    path = new_path(spark, "labels")
    key = F.col("s_suppkey")
    full = F.concat_ws(" ", key % 3, *[F.format_string("0.%d", key % m) for m in (7, 6, 5)])
    lines = F.when(key % 4 == 0, full).otherwise(F.concat_ws("  ", full, F.lit("0.25")))
    blank = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stem"), F.lit("  ").alias("value"))
    table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("stem"), lines.alias("value")).unionByName(blank).write.partitionBy("stem").text(path)
    return path


LABELS = "SELECT s_nationkey::varchar AS stem, (s_suppkey % 3)::int AS cls, ('0.' || (s_suppkey % 7))::double AS cx, ('0.' || (s_suppkey % 6))::double AS cy, ('0.' || (s_suppkey % 5))::double AS w, CASE WHEN s_suppkey % 4 <> 0 THEN 0.25::double END AS h FROM supplier"
STEM_OF_FOLDER = r"stem=([^/]+)/"


@query(f"{LABELS} WHERE s_suppkey % 4 <> 0")
def labels_strict(spark, sf_dir):
    """Label lines of just five tokens, their classes checked against those that are known."""
    lines = readers.label_lines(spark, _labels(spark, sf_dir), STEM_OF_FOLDER)
    return readers.known_classes(readers.label_boxes(lines), [0, 1, 2])


@query(LABELS)
def labels_loose(spark, sf_dir):
    """All label lines that are not blank; numbers that lack are null."""
    return readers.label_boxes(readers.label_lines(spark, _labels(spark, sf_dir), STEM_OF_FOLDER), strict=False)


@query("SELECT n_regionkey::varchar AS folder, count(*) AS files, sum(strlen(n_name) + 1)::bigint AS bytes FROM nation GROUP BY 1 UNION ALL SELECT 'all but 0', count(*), sum(strlen(n_name) + 1)::bigint FROM nation WHERE n_regionkey <> 0")
def listed_files(spark, sf_dir):
    """A file a nation in a folder a region: listed, counted and measured, and once more without a subtree."""
    path = new_path(spark, "tree")
    table(spark, sf_dir, "nation").repartition("n_nationkey").select("n_regionkey", "n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey", "n_nationkey").text(path)
    listed = readers.files(spark, path, "*.txt")
    by = listed.groupBy(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return by.unionByName(readers.folder_size(listed, "n_regionkey=0/").select(F.lit("all but 0").alias("folder"), "files", "bytes"))


@query("SELECT n.range AS nation, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n = 0 THEN 'empty' ELSE 'there' END AS state FROM range(30) n LEFT JOIN (SELECT n_nationkey, (n_regionkey <> 1)::int AS n FROM nation) c ON n.range = c.n_nationkey")
def missing_and_empty_files(spark, sf_dir):
    """Files that are expected: there, without a byte, or missing."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.when(F.col("n_regionkey") != 1, F.octet_length("n_name")).otherwise(0).alias("length"))
    expected = spark.range(30).select(F.col("id").alias("nation"))
    missing = readers.missing_files(expected, nations, "nation").select("nation", F.lit("missing").alias("state"))
    empty = readers.empty_files(nations).select("nation", F.lit("empty").alias("state"))
    there = nations.filter("length > 0").select("nation", F.lit("there").alias("state"))
    return missing.unionByName(empty).unionByName(there)


@query(f"SELECT {fx.split_sql('doc_id')} AS split, source || '/' || doc_id::varchar AS line FROM documents")
def split_lists(spark, sf_dir):
    """A list of paths for each split, written and read again."""
    path = new_path(spark, "lists")
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), fx.split_column(F.col("doc_id")).alias("split"))
    writers.split_lists(docs, path, "path", "split")
    out = None
    for split in ("train", "val", "test"):
        part = readers.line_list(spark, f"{path}/split={split}").select(F.lit(split).alias("split"), "line")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'corrected' ELSE c_mktsegment END AS segment FROM customer")
def manifest_version(spark, sf_dir):
    """A manifest, and its next version with corrections beside it; the last one is read."""
    path = new_path(spark, "manifest")
    first = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    old = spark.read.parquet(writers.next_version(first, path, 1))
    corrected = old.withColumn("segment", F.when(F.col("c_custkey") % 10 == 0, "corrected").otherwise(F.col("segment")))
    return spark.read.parquet(writers.next_version(corrected, path, 2))


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS balance FROM supplier")
def json_round_trip(spark, sf_dir):
    """Rows as JSON texts, a file of them read under a schema."""
    path = new_path(spark, "json")
    writers.json_column(table(spark, sf_dir, "supplier"), "value").write.text(path)
    rows = spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").json(path)
    return rows.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("balance"))


@query("""SELECT 'region[' || (row_number() OVER (ORDER BY r_regionkey) - 1) || '].name' AS path, '"' || r_name || '"' AS value FROM region UNION ALL SELECT 'size', count(*)::varchar FROM region""")
def json_sections(spark, sf_dir):
    """A nested JSON file, made section by section, as the paths and values of its leaves."""
    path = f"{new_path(spark, 'tree')}/result.json"
    regions = [{"name": r["r_name"]} for r in table(spark, sf_dir, "region").orderBy("r_regionkey").limit(1000).collect()]
    writers.merge_section(spark, path, "region", "to be replaced")
    writers.merge_section(spark, path, "size", len(regions))
    writers.merge_section(spark, path, "region", regions)
    return readers.json_leaves(spark, path)


@query("SELECT CASE WHEN n_regionkey = 0 THEN 'archived' ELSE 'active' END AS state, count(*) AS n FROM nation WHERE contains(n_name, 'A') GROUP BY 1")
def configs_with_part(spark, sf_dir):
    """Configuration files that hold a part, active or in an archive."""
    path = new_path(spark, "configs")
    folder = F.when(F.col("n_regionkey") == 0, "archive").otherwise("live")
    table(spark, sf_dir, "nation").repartition("n_nationkey").select(folder.alias("folder"), "n_nationkey", F.concat(F.lit("path: "), F.col("n_name")).alias("value")).write.partitionBy("folder", "n_nationkey").text(path)
    return readers.configs_with(spark, path, "*.txt", "A").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT max_by(event_type || '/' || event_id::varchar, (ts, event_type || '/' || event_id::varchar)) AS path FROM events")
def latest_file(spark, sf_dir):
    """The most recent of a listing, ties to the last name."""
    listed = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", "event_id").alias("path"), F.col("ts").alias("modified"))
    return readers.latest(listed)


@query("SELECT p_partkey::varchar AS path, p_size AS width, (p_partkey % 900 + 1)::int AS height FROM part")
def image_sizes(spark, sf_dir):
    """Sizes read from the headers of PNG images."""
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(head, number(F.col("p_size")), number(F.col("p_partkey") % 900 + 1)).alias("content"))
    return readers.image_sizes(images)


@query("SELECT url AS path, 'copy/' || substr(url, 9) AS target, strlen(html) AS bytes FROM pages WHERE starts_with(url, 'https://')")
def copy_plan(spark, sf_dir):
    """What to copy where; paths are relative to a prefix and files are small enough, or the query fails."""
    pages = table(spark, sf_dir, "pages").filter(F.startswith("url", F.lit("https://")))
    target = F.concat(F.lit("copy/"), writers.relative(F.col("url"), "https://"))
    return writers.copy_plan(pages, F.col("url"), target, F.octet_length("html").cast("bigint"))


@query("SELECT vec_id, len(embedding) AS n, round(embedding[1]::double, 6) AS first, round(embedding[64]::double, 6) AS last FROM embeddings")
def npy_round_trip(spark, sf_dir):
    """Vectors in NPY form, read again."""
    found = readers.npy_values(writers.npy_bytes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "content")
    at = lambda k: F.round(F.get("values", F.lit(k)), 6)
    return found.select("vec_id", F.get("shape", F.lit(0)).cast("bigint").alias("n"), at(0).alias("first"), at(63).alias("last"))


@query("SELECT p_partkey, round((0.5::double - p_size / 200.0::double) * 640, 6) AS x1, round((0.25::double - p_size / 400.0::double) * 480, 6) AS y1, round((0.5::double + p_size / 200.0::double) * 640, 6) AS x2, round((0.25::double + p_size / 400.0::double) * 480, 6) AS y2 FROM part")
def box_corners(spark, sf_dir):
    """Pixel corners of normalised centre boxes."""
    w, h = F.col("p_size") / 100.0, F.col("p_size") / 200.0
    corners = geometry.to_corners(F.lit(0.5), F.lit(0.25), w, h, F.lit(640.0), F.lit(480.0))
    return table(spark, sf_dir, "part").select("p_partkey", *corners).withColumns({c: F.round(c, 6) for c in ("x1", "y1", "x2", "y2")})


@query(f"WITH {fx.PAIRS} SELECT a, b, least(dist, bit_count(xor(x.code, xor(y.code, 255))))::int AS dist FROM pairs JOIN codes x ON a = x.vec_id JOIN codes y ON b = y.vec_id")
def flip_distances(spark, sf_dir):
    """The smaller of a pair's distances to an image and to its mirror image, whose code differs in eight bits here."""
    known = fx.codes(spark, sf_dir)
    side = lambda end: known.select(F.col("vec_id").alias(end), F.col("code").alias(f"code_{end}"))
    met = fx.pairs(spark, sf_dir).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", hashing.min_flip(F.col("code_a"), F.col("code_b"), F.col("code_b").bitwiseXOR(F.lit(255).cast("bigint"))).alias("dist"))


@query("SELECT c_custkey, 1.0::double AS length FROM customer WHERE c_acctbal <> 0")
def unit_vectors(spark, sf_dir):
    """Vectors of a customer's numbers over their length, and the length that leaves."""
    vector = F.array(F.col("c_acctbal"), F.col("c_custkey").cast("double"), F.lit(1.0))
    found = table(spark, sf_dir, "customer").filter("c_acctbal <> 0").select("c_custkey", hashing.unit(vector).alias("v"))
    return found.select("c_custkey", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("length"))


@query("SELECT o_orderkey, abs(o_totalprice - round(o_totalprice)) < 0.1 AS agrees FROM orders")
def numbers_agree(spark, sf_dir):
    """Whether a recomputed number is that of a report within a tolerance."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.within(price, F.round(price), 0.1).alias("agrees"))


@query("""WITH c AS (SELECT p_partkey AS crop, p_partkey + 1 AS parent FROM part WHERE p_partkey % 4 = 0)
SELECT count(*) AS pairs, count(*) FILTER (a.p_brand <> b.p_brand) AS crossing, CASE WHEN count(*) FILTER (a.p_brand <> b.p_brand) = 0 THEN 'ok' ELSE 'known limitation' END AS verdict FROM c JOIN part a ON crop = a.p_partkey JOIN part b ON parent = b.p_partkey""")
def crop_parent_span(spark, sf_dir):
    """Crops whose parent has another brand, here in the place of a split."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("split"))
    crops = parts.filter("item % 4 = 0").select(F.col("item").alias("crop"), (F.col("item") + 1).alias("parent"))
    return checks.crop_parent_span(crops, parts, "item", "split", known_limitation=True)


@query(f"""WITH {fx.PAIRS}, r AS (SELECT a, b, 20 - dist AS score FROM pairs), t AS (SELECT 'top' AS band, row_number() OVER (ORDER BY score DESC, a, b) AS rank, * FROM r), m AS (SELECT 'middle' AS band, row_number() OVER (ORDER BY score DESC, a, b) AS rank, * FROM r WHERE score BETWEEN 3 AND 4)
SELECT band, rank::int AS rank, a, b, score FROM t WHERE rank <= 40 UNION ALL SELECT band, rank::int, a, b, score FROM m WHERE rank <= 20""")
def best_of_bands(spark, sf_dir):
    """The best pairs, and the best of a middle band of scores."""
    scored = fx.pairs(spark, sf_dir).select("a", "b", (20 - F.col("dist")).alias("score"))
    return pair_ops.heads(scored, "score", [("top", None, None, 40), ("middle", 3, 4, 20)], "a", "b")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(source || '_' || doc_id::varchar, '^.+_\d+$') AND doc_id % 5 <> 0 THEN source ELSE 'x' || doc_id::varchar END AS prefix, CASE WHEN doc_id % 5 <> 0 THEN doc_id ELSE -1 END AS number FROM documents""")
def flagged_stems(spark, sf_dir):
    """Prefix and number of stems; those of another form are flagged with -1. Every fifth stem has no number here."""
    stem = F.when(F.col("doc_id") % 5 != 0, F.concat_ws("_", "source", "doc_id")).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.stem_flagged(stem).alias("s")).select("doc_id", "s.prefix", "s.number")
