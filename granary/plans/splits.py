"""Queries on split construction, sessions and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as pair_ops
from ..operators import sessions as ses
from ..operators import splits as ops
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


SIGNATURE = "lang || '/' || coalesce(quality::varchar, '-') || '/' || coalesce(toxic::varchar, '-')"


def signed(spark, sf_dir):
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return fx.items(spark, sf_dir).withColumn("stratum", F.concat_ws("/", "lang", known("quality"), known("toxic"))).drop("split")


@query(f"""WITH {fx.ITEMS}, s AS (SELECT doc_id, {SIGNATURE} AS stratum FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {fx.draw_sql(42, "doc_id")}, doc_id) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY stratum) * 0.15::double, 0)::bigint) AS n FROM s)
SELECT doc_id, stratum, CASE WHEN r <= n THEN 'test' WHEN r <= 2 * n THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    return ops.stratified(signed(spark, sf_dir), "doc_id", "stratum").select("doc_id", "stratum", "split")


@query(f"""WITH {fx.ITEMS}, c AS (SELECT number // 10 AS component, split, count(*) AS n FROM items GROUP BY ALL)
SELECT component, split FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, list_position(['train', 'val', 'test'], split)) AS r FROM c) WHERE r = 1""")
def majority_split(spark, sf_dir):
    members = fx.items(spark, sf_dir).withColumn("component", F.floor(F.col("number") / 10))
    return ops.majority(members, "component", "split")


@query(f"""WITH {fx.ITEMS}, c AS (SELECT number // 10 AS component, split, count(*) AS n FROM items GROUP BY ALL),
m AS (SELECT component, split AS new FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, list_position(['train', 'val', 'test'], split)) AS r FROM c) WHERE r = 1)
SELECT count(*) AS n, count(*) FILTER (split <> new) AS moved FROM items JOIN m ON number // 10 = component""")
def moved_count(spark, sf_dir):
    members = fx.items(spark, sf_dir).withColumn("component", F.floor(F.col("number") / 10))
    new = ops.majority(members, "component", "split").withColumnRenamed("split", "new")
    return ops.moved(members.join(new, "component"), "split", "new")


def measures():
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return {"items": F.lit(1), "quality": zero("quality"), "toxic": zero("toxic"), "background": F.col("quality").isNull().cast("int")}


@query()
def randomised_group_split(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    stats = ops.group_stats(items, "prefix", measures(), F.col("number") == 0)
    return ops.search_groups(stats, "prefix", list(measures()))


@query()
def size_ordered_group_split(spark, sf_dir):
    stats = ops.group_stats(fx.items(spark, sf_dir), "prefix", measures())
    return ops.search_groups(stats, "prefix", list(measures()), by_size=True, val_first=True, least_train=0.68, tolerance=0.03)


@query()
def rebalanced_split(spark, sf_dir):
    members = fx.items(spark, sf_dir).withColumn("component", F.floor(F.col("number") / 10))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("prefix").alias("prefixes"))
    table_ = ops.majority(members, "component", "split").join(sizes, "component").withColumn("movable", F.lit(True))
    return ops.rebalance(table_, "component", "split", "n", "movable").select("component", "split", "new_split", "moved")


@query(f"""WITH {fx.ITEMS}, f AS (SELECT (count(*) FILTER (split = 'test'))::double / count(*) AS test, max(n) / sum(n) AS largest, count(DISTINCT split) AS splits FROM (SELECT split, count(*) OVER (PARTITION BY prefix) AS n FROM items)),
g AS (SELECT (count(*) FILTER (split = 'test'))::double / count(*) AS test, count(DISTINCT split) AS splits, count(DISTINCT prefix) AS prefixes FROM items),
c AS (SELECT abs(test - 0.15) <= 0.03 AS test_share, splits = 3 AS all_splits, prefixes >= 30 AS many_prefixes FROM g)
SELECT *, array_to_string(list_filter([CASE WHEN NOT test_share THEN 'test_share' END, CASE WHEN NOT all_splits THEN 'all_splits' END, CASE WHEN NOT many_prefixes THEN 'many_prefixes' END], lambda x: x IS NOT NULL), ',') AS failing, CASE WHEN test_share AND all_splits AND many_prefixes THEN 'A' ELSE 'B' END AS path FROM c""")
def feasibility_gate(spark, sf_dir):
    facts = fx.items(spark, sf_dir).agg((F.count_if(F.col("split") == "test") / F.count("*")).alias("test"), F.count_distinct("split").alias("splits"), F.count_distinct("prefix").alias("prefixes"))
    return ops.gate(facts, {"test_share": F.abs(F.col("test") - 0.15) <= 0.03, "all_splits": F.col("splits") == 3, "many_prefixes": F.col("prefixes") >= 30})


@query(f"WITH {fx.ITEMS} SELECT doc_id, 'train' AS split, row_number() OVER (ORDER BY doc_id) + 999 AS group_id FROM items WHERE quality IS NULL")
def unassigned_to_train(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    return ops.place_unassigned(items, items.filter("quality IS NOT NULL").select("doc_id"), "doc_id", 1000)


@query(f"SELECT doc_id FROM documents ORDER BY {fx.draw_sql(42, 'doc_id')}, doc_id LIMIT 25")
def seeded_sample(spark, sf_dir):
    return ops.sample_by_draw(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25)


WEIGHTED = f"""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT source, n, (n * (n - 1) // 2)::bigint AS w, sum(n * (n - 1) // 2) OVER (ORDER BY source)::bigint AS upto FROM g WHERE n > 1), t AS (SELECT max(upto) AS total FROM r),
d AS (SELECT i.range AS i, {fx.draw_sql(42, "i.range", "'group'")} % total AS spot FROM range(1000) i, t),
p AS (SELECT i, source, n, {fx.draw_sql(42, "i", "'first'")} % n AS first, 1 + {fx.draw_sql(42, "i", "'second'")} % (n - 1) AS step FROM d JOIN r ON spot >= upto - w AND spot < upto)"""


def weighted(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return ops.sample_pairs_weighted(groups, "source", "n", 1000)


@query(f"{WEIGHTED} SELECT i, source, first, (first + step) % n AS second FROM p")
def weighted_pairs(spark, sf_dir):
    return weighted(spark, sf_dir)


@query(f"""{WEIGHTED}, random AS (SELECT avg((abs(first - (first + step) % n) <= 20)::int) AS f FROM p), {fx.PAIRS}, strong AS (SELECT count(*) AS n, avg((abs(a - b) <= 20)::int) AS f FROM pairs)
SELECT strong.n, round(strong.f, 6) AS strong_fraction, round(random.f, 6) AS random_fraction, strong.n >= 30 AND strong.f >= 3 * random.f AS enriched FROM strong, random""")
def gap_enrichment(spark, sf_dir):
    strong = ses.gap_distribution(fx.pairs(spark, sf_dir), "a", "b", 20)
    random = ses.gap_distribution(weighted(spark, sf_dir), "first", "second", 20)
    return ses.enrichment(strong, random).withColumns({c: F.round(c, 6) for c in ("strong_fraction", "random_fraction")})


def gap_sql(minutes: int) -> str:
    return f"""g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {minutes * 60_000_000} THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT event_id, user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS session FROM g)"""


@query(f"WITH {gap_sql(60)} SELECT * FROM s")
def sessions_gap(spark, sf_dir):
    return ses.by_gap(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 60).select("event_id", "user_id", "session")


@query("SELECT event_id, user_id, (dense_rank() OVER (PARTITION BY user_id ORDER BY ts::date) - 1)::int AS session FROM events")
def sessions_day(spark, sf_dir):
    return ses.by_day(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "user_id", "session")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {gap_sql(m)} SELECT {m} AS minutes, count(*) AS sessions, sum(n)::bigint AS items, round(avg(n), 6) AS mean_size, max(n) AS largest FROM (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL))" for m in (5, 15, 30, 60)))
def session_stats(spark, sf_dir):
    events, out = table(spark, sf_dir, "events"), None
    for minutes in (5, 15, 30, 60):
        row = ses.stats(ses.by_gap(events, "user_id", "ts", "event_id", minutes), "user_id").select(F.lit(minutes).alias("minutes"), "*")
        out = row if out is None else out.unionByName(row)
    return out


CROPS = f"{gap_sql(60)}, crops AS (SELECT event_id + 1000000 AS event_id, CASE WHEN event_id % 2 = 0 THEN event_id + 1 END AS parent FROM events WHERE event_id % 5 = 0)"


def crops(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id % 5 = 0").select((F.col("event_id") + 1_000_000).alias("event_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 1).alias("parent"))


@query(f"WITH {CROPS} SELECT c.event_id, s.session FROM crops c JOIN s ON c.parent = s.event_id")
def inherited_sessions(spark, sf_dir):
    return ses.inherited(crops(spark, sf_dir), sessions_gap(spark, sf_dir), "event_id", "parent")


@query(f"WITH {CROPS} SELECT event_id FROM crops c WHERE parent IS NULL OR parent NOT IN (SELECT event_id FROM events)")
def unplaceable_items(spark, sf_dir):
    mine, timed = crops(spark, sf_dir), sessions_gap(spark, sf_dir)
    return ses.unplaceable(mine, timed, ses.inherited(mine, timed, "event_id", "parent"), "event_id").select("event_id")


@query("SELECT k, v, r FROM (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r - CASE WHEN n >= 3 THEN 1 ELSE 0 END BETWEEN 1 AND 2")
def offset_pick(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_totalprice")
    return pair_ops.offset_pick(orders, "k", 2, 1, F.desc("o_totalprice"), F.col("v")).select("k", "v", F.col("rank").cast("bigint").alias("r"))


@query("SELECT o_custkey AS k, o_orderkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_row_per_key(spark, sf_dir):
    out = pair_ops.best_per(table(spark, sf_dir, "orders"), "o_custkey", F.desc("o_totalprice"), F.col("o_orderkey"))
    return out.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))




@query()
def session_group_split(spark, sf_dir):
    """Sessions dealt to splits, by decreasing size in every third round and in random orders else."""
    found = ses.by_day(table(spark, sf_dir, "events"), "event_type", "ts").withColumn("grp", F.concat_ws("/", "event_type", F.col("session").cast("string")))
    return ops.search_groups(ops.group_stats(found, "grp", {"items": F.lit(1)}), "grp", ["items"], by_size=True)


@query()
def block_choice(spark, sf_dir):
    """The largest block size whose groups can be split evenly and have no giant."""
    items, attempts = fx.items(spark, sf_dir), {}
    for size in (400, 100, 20):
        grouped = items.withColumn("grp", F.concat_ws("/", F.lit("b"), F.floor(F.col("number") / size).cast("string")))
        best = ops.search_groups(ops.group_stats(grouped, "grp", measures()), "grp", list(measures()))
        counts = grouped.groupBy("grp").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("largest_share"))
        attempts[size] = best.agg(F.max("deviation").alias("deviation")).join(F.broadcast(counts))
    return spark.createDataFrame([(ops.choose_block(spark, attempts),)], "block int")


@query(f"""WITH {fx.ITEMS}, l AS (SELECT split, unnest(['items', 'quality', 'toxic']) AS measure, unnest([1, coalesce(quality, 0), coalesce(toxic, 0)]) AS n FROM items),
s AS (SELECT measure, sum(n) FILTER (split = 'train')::double / sum(n) AS train, sum(n) FILTER (split = 'val')::double / sum(n) AS val, sum(n) FILTER (split = 'test')::double / sum(n) AS test FROM l GROUP BY 1)
SELECT measure, round(train, 6) AS train, round(val, 6) AS val, round(test, 6) AS test, round(greatest(abs(train - 0.7::double), abs(val - 0.15::double), abs(test - 0.15::double)), 6) AS deviation, greatest(abs(train - 0.7::double), abs(val - 0.15::double), abs(test - 0.15::double)) <= 0.03 AS achievable FROM s""")
def class_deviation(spark, sf_dir):
    """How far each measure's shares of the splits are from the targets."""
    kept = {k: v for k, v in measures().items() if k != "background"}
    out = ops.class_deviation(fx.items(spark, sf_dir), "split", kept)
    return out.withColumns({c: F.round(c, 6) for c in ("train", "val", "test", "deviation")})
