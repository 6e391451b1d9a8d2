"""Queries on hashes, similarity pairs, groups and leak audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, leakage, pairs as ops
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


@query(f"WITH {fx.CODES} SELECT vec_id, code, split FROM codes")
def hash64_vectors(spark, sf_dir):
    return fx.codes(spark, sf_dir).select("vec_id", "code", "split")


@query(f"WITH {fx.PAIRS} SELECT * FROM pairs")
def hamming_pairs(spark, sf_dir):
    return fx.pairs(spark, sf_dir)


@query(f"WITH {fx.PAIRS}, t AS (SELECT unnest([12, 14, 16, 18]) AS threshold) SELECT threshold::int AS threshold, count(dist) FILTER (dist <= threshold) AS n FROM t, pairs GROUP BY 1")
def hamming_threshold_grid(spark, sf_dir):
    return ops.threshold_grid(fx.pairs(spark, sf_dir), "dist", [12, 14, 16, 18])


@query(f"WITH {fx.PAIRS} SELECT cross_split, count(*) AS n, min(dist) AS nearest FROM pairs GROUP BY 1")
def cross_vs_within(spark, sf_dir):
    return fx.pairs(spark, sf_dir).groupBy("cross_split").agg(F.count("*").alias("n"), F.min("dist").alias("nearest"))


@query(f"""WITH {fx.CODES}, v AS (SELECT vec_id, [xor(code, k * 72340172838076673) FOR k IN range(8)] AS h FROM codes),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, least(list_min([bit_count(xor(a.h[1], x)) FOR x IN b.h]), list_min([bit_count(xor(b.h[1], x)) FOR x IN a.h]))::int AS dist FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT a, b, dist FROM d WHERE dist <= 20""")
def dihedral_pairs(spark, sf_dir):
    variants = F.transform(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>"), lambda k: F.col("code").bitwiseXOR(k * F.lit(72340172838076673)))
    return ops.dihedral_pairs(fx.codes(spark, sf_dir).select("vec_id", variants.alias("h")), "vec_id", "h", 20)


KNN = """v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
sims AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.label <> b.label),
knn AS (SELECT query, candidate, c, row_number() OVER (PARTITION BY query ORDER BY c DESC, candidate) AS rank FROM sims QUALIFY rank <= 5)"""


def knn(spark, sf_dir):
    return ops.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query(f"WITH {KNN} SELECT query, candidate, round(c, 6) AS cosine, rank::int AS rank FROM knn")
def topk_cosine_cross_group(spark, sf_dir):
    return knn(spark, sf_dir).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {KNN}, p AS (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99, 1.0]::double[]) AS p) SELECT p, round((SELECT quantile_cont(c, 0.5) FROM knn) * (p = 0.5)::int + (SELECT quantile_cont(c, 0.75) FROM knn) * (p = 0.75)::int + (SELECT quantile_cont(c, 0.9) FROM knn) * (p = 0.9)::int + (SELECT quantile_cont(c, 0.95) FROM knn) * (p = 0.95)::int + (SELECT quantile_cont(c, 0.99) FROM knn) * (p = 0.99)::int + (SELECT max(c) FROM knn) * (p = 1.0)::int, 6) AS value FROM p")
def cosine_percentiles(spark, sf_dir):
    return ops.percentiles(knn(spark, sf_dir), "cosine", [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]).withColumn("value", F.round("value", 6))


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem) SELECT v FROM s WHERE r = floor(0.9::double * (n - 1)) + 1")
def percentile_lower(spark, sf_dir):
    return ops.percentile_lower(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v")), "v", 0.9)


@query(f"""WITH {fx.PAIRS}, {KNN}, e AS (SELECT least(query, candidate) AS a, greatest(query, candidate) AS b, max(c) AS cosine FROM knn GROUP BY 1, 2)
SELECT coalesce(p.a, e.a) AS a, coalesce(p.b, e.b) AS b, p.dist, round(e.cosine, 6) AS cosine FROM pairs p FULL JOIN e ON p.a = e.a AND p.b = e.b""")
def candidate_union(spark, sf_dir):
    embedded = knn(spark, sf_dir).select(F.col("query").alias("a"), F.col("candidate").alias("b"), "cosine")
    return ops.union_candidates(fx.pairs(spark, sf_dir), embedded).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {fx.PAIRS}, {KNN}, e AS (SELECT DISTINCT least(query, candidate) AS a, greatest(query, candidate) AS b FROM knn),
f AS (SELECT p.a AS pa, e.a AS ea FROM pairs p FULL JOIN e ON p.a = e.a AND p.b = e.b)
SELECT count(*) FILTER (pa IS NOT NULL AND ea IS NOT NULL) AS shared, count(*) FILTER (ea IS NULL) AS only_a, count(*) FILTER (pa IS NULL) AS only_b FROM f""")
def audit_overlap(spark, sf_dir):
    return ops.overlap(fx.pairs(spark, sf_dir), knn(spark, sf_dir).select(F.col("query").alias("a"), F.col("candidate").alias("b")))


@query(f"""WITH {fx.AUDITED}, more AS (SELECT query AS a, candidate AS b FROM (SELECT vec_id AS query, vec_id + 7 AS candidate FROM embeddings WHERE vec_id % 9 = 0))
SELECT a, b, dist FROM audited UNION ALL SELECT a, b, NULL FROM more m WHERE NOT EXISTS (SELECT 1 FROM audited x WHERE x.a = m.a AND x.b = m.b)""")
def augmented_pairs(spark, sf_dir):
    """The audited pairs and those of a second source, which ties every ninth vector to the one seven places on."""
    more = table(spark, sf_dir, "embeddings").filter("vec_id % 9 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 7).alias("b"))
    return ops.add_absent(fx.audited(spark, sf_dir).select("a", "b", "dist"), more)


@query(f"WITH {fx.PAIRS} SELECT p.a, p.b, CASE (a % 2 = 0)::int + (b % 2 = 0)::int WHEN 2 THEN 'both' WHEN 1 THEN 'one' ELSE 'none' END AS disposition FROM pairs p")
def pair_dispositions(spark, sf_dir):
    even = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select("vec_id")
    return ops.dispositions(fx.pairs(spark, sf_dir).select("a", "b"), even, "vec_id")


TIERED = f"""{fx.AUDITED}, tiered AS (SELECT *, {fx.TIER} AS tier FROM audited),
decided AS (SELECT *, CASE WHEN tier = 'A' AND cross_split THEN 'merge' WHEN tier = 'A' THEN 'merge_within' WHEN tier = 'B' AND cross_split THEN 'verify' ELSE 'reject' END AS decision FROM tiered)"""


def tiered(spark, sf_dir):
    args = (F.col("dist"), F.col("verified"), F.col("backdrop"))
    p = fx.audited(spark, sf_dir).withColumns({"tier": leakage.tier(*args), "reason": leakage.reason(*args)})
    return p.withColumn("decision", leakage.decision(F.col("tier"), F.col("cross_split")))


@query(f"""WITH {TIERED} SELECT a, b, tier, decision, CASE WHEN dist <= 4 THEN 'near hash' WHEN verified AND NOT backdrop THEN 'verified' WHEN dist > 4 AND dist <= 8 THEN 'middle hash' WHEN verified AND backdrop THEN 'backdrop' ELSE 'far' END AS reason FROM decided""")
def pair_tiers(spark, sf_dir):
    return tiered(spark, sf_dir).select("a", "b", "tier", "decision", "reason")


VERIFIED = f"""{TIERED}, results AS (SELECT vec_id AS a, vec_id AS k, (vec_id % 60)::int AS inliers, (vec_id % 10) / 10.0::double AS coverage FROM embeddings),
final AS (SELECT d.* REPLACE (CASE WHEN decision = 'verify' THEN CASE WHEN r.inliers >= 30 AND r.coverage >= 0.5 THEN 'merge' ELSE 'reject' END ELSE decision END AS decision) FROM decided d LEFT JOIN results r ON d.a = r.k)"""


def decided(spark, sf_dir):
    p = tiered(spark, sf_dir)
    results = p.select("a", "b", (F.col("a") % 60).cast("int").alias("inliers"), (F.col("a") % 10 / 10.0).alias("coverage"))
    return leakage.after_verification(p, results)


@query(f"WITH {VERIFIED} SELECT tier, decision, count(*) AS n FROM final GROUP BY ALL")
def tier_decisions(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("tier", "decision").agg(F.count("*").alias("n"))


@query(f"""WITH {VERIFIED}, x AS (SELECT CASE WHEN split_a = 'test' THEN a ELSE b END AS item, CASE WHEN split_a = 'test' THEN split_b ELSE split_a END AS other FROM final WHERE decision = 'merge' AND split_a <> split_b AND (split_a = 'test' OR split_b = 'test'))
SELECT item, bool_or(other = 'train') AS has_train_copy, bool_or(other = 'val') AS has_val_copy FROM x GROUP BY 1""")
def exclusion_list(spark, sf_dir):
    return leakage.exclusions(decided(spark, sf_dir).filter("decision = 'merge'"))


@query(f"""WITH {VERIFIED}, x AS (SELECT CASE WHEN split_a = 'test' THEN a ELSE b END AS item FROM final WHERE decision = 'merge' AND split_a <> split_b AND (split_a = 'test' OR split_b = 'test'))
SELECT vec_id AS item FROM codes WHERE split = 'test' AND vec_id NOT IN (SELECT item FROM x)""")
def filtered_list(spark, sf_dir):
    test = fx.codes(spark, sf_dir).filter("split = 'test'").select(F.col("vec_id").alias("item"))
    return leakage.without(test, exclusion_list(spark, sf_dir), "item")


@query(f"WITH {fx.PAIRS} SELECT least(split_a, split_b) || '|' || greatest(split_a, split_b) AS split_pair, count(*) AS n FROM pairs WHERE split_a <> split_b GROUP BY 1")
def residual_cross_split(spark, sf_dir):
    return leakage.residual(fx.pairs(spark, sf_dir), fx.codes(spark, sf_dir), "vec_id", "split")


@query(f"WITH {fx.PAIRS} SELECT least(split_a, split_b) || '|' || greatest(split_a, split_b) AS split_pair, count(*) AS n FROM pairs GROUP BY 1")
def split_pair_counts(spark, sf_dir):
    return leakage.split_pair_counts(fx.pairs(spark, sf_dir))


@query(f"WITH {fx.PAIRS} SELECT source, count(*) AS n FROM (SELECT split_a AS source FROM pairs UNION ALL SELECT split_b FROM pairs) GROUP BY 1")
def both_ends_by_source(spark, sf_dir):
    return leakage.ends_by_source(fx.pairs(spark, sf_dir), "split_a", "split_b")


@query(f"""WITH {fx.PAIRS}, t AS (SELECT unnest([14, 16, 18]) AS threshold), once AS (SELECT DISTINCT threshold, b FROM t, pairs WHERE split_a = 'train' AND split_b = 'test' AND dist <= threshold)
SELECT threshold::int AS threshold, count(*) AS items, sum(label)::bigint AS total FROM once JOIN codes ON b = vec_id GROUP BY 1""")
def twins_by_threshold(spark, sf_dir):
    pairs = fx.pairs(spark, sf_dir).filter("split_a = 'train' AND split_b = 'test'")
    return leakage.twins(pairs, "dist", [14, 16, 18], fx.codes(spark, sf_dir).select("vec_id", "label"), "vec_id", "label")


@query(f"WITH {fx.PAIRS} SELECT a, b FROM pairs WHERE split_a <> split_b OR a // 20 <> b // 20")
def cross_block_pairs(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return leakage.cross_block(p, F.col("split_a"), F.col("a"), F.col("split_b"), F.col("b"), 20).select("a", "b")


BLOCKS = f"{fx.ITEMS}, block_edges AS (SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY prefix, number // 200) AS a, doc_id AS b FROM items) WHERE a <> b)"


def block_edges_of(spark, sf_dir):
    return graph.block_edges(fx.items(spark, sf_dir), "doc_id", "prefix", F.col("number"), 200)


@query(f"WITH {BLOCKS} SELECT a, b FROM block_edges")
def block_edges(spark, sf_dir):
    return block_edges_of(spark, sf_dir)


def reach_sql(edges: str, nodes: str) -> str:
    return f"""both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
components AS (SELECT n.item, coalesce(least(min(r.b), n.item), n.item) AS component FROM {nodes} n LEFT JOIN reach r ON n.item = r.a GROUP BY n.item)"""


@query(f"WITH RECURSIVE {fx.PAIRS}, nodes AS (SELECT vec_id AS item FROM codes), {reach_sql('pairs', 'nodes')} SELECT item AS vec_id, component FROM components")
def components(spark, sf_dir):
    return graph.with_components(fx.codes(spark, sf_dir).select("vec_id"), "vec_id", fx.pairs(spark, sf_dir)).select("vec_id", "component")


@query(f"""WITH RECURSIVE {fx.PAIRS}, ids AS (SELECT vec_id AS item FROM codes), t AS (SELECT unnest([14, 16, 18]) AS threshold),
both_ways AS (SELECT threshold, a, b FROM pairs, t WHERE dist <= threshold UNION SELECT threshold, b, a FROM pairs, t WHERE dist <= threshold),
reach AS (SELECT threshold, a, b FROM both_ways UNION SELECT r.threshold, r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a AND r.threshold = e.threshold),
c AS (SELECT t.threshold, n.item, coalesce(least(min(r.b), n.item), n.item) AS component FROM ids n CROSS JOIN t LEFT JOIN reach r ON n.item = r.a AND r.threshold = t.threshold GROUP BY t.threshold, n.item),
s AS (SELECT threshold, component, count(*) AS n FROM c GROUP BY ALL)
SELECT CASE threshold WHEN 14 THEN 'd14' WHEN 16 THEN 'd14+d16' ELSE 'd14+d16+d18' END AS rules, count(*) AS components, max(n) AS largest FROM s GROUP BY 1""")
def edge_ablation(spark, sf_dir):
    pairs = fx.pairs(spark, sf_dir)
    rules = {f"d{t}": graph.hash_edges(pairs, "dist", t) for t in (14, 16, 18)}
    return graph.ablation(fx.codes(spark, sf_dir), "vec_id", rules)


@query(f"""WITH {fx.PAIRS}, m AS (SELECT least(x.label, y.label) AS prefix_a, greatest(x.label, y.label) AS prefix_b FROM pairs JOIN codes x ON a = x.vec_id JOIN codes y ON b = y.vec_id WHERE x.label <> y.label)
SELECT prefix_a, prefix_b, count(*) AS n FROM m GROUP BY ALL""")
def prefix_supergraph(spark, sf_dir):
    return graph.supergraph(fx.pairs(spark, sf_dir), fx.codes(spark, sf_dir), "vec_id", "label")


MEMBERS = f"WITH RECURSIVE {fx.PAIRS}, nodes AS (SELECT vec_id AS item FROM codes), {reach_sql('pairs', 'nodes')}, members AS (SELECT component, split, label, vec_id FROM components JOIN codes ON item = vec_id)"


def members(spark, sf_dir):
    known = fx.codes(spark, sf_dir).drop("embedding")
    return graph.with_components(known, "vec_id", fx.pairs(spark, sf_dir))


@query(f"{MEMBERS} SELECT component, count(*) AS members, count(DISTINCT split) AS splits, count(DISTINCT label) AS prefixes FROM members GROUP BY 1")
def component_anatomy(spark, sf_dir):
    return graph.anatomy(members(spark, sf_dir), "component", "split", "label")


@query(f"{MEMBERS} SELECT component, count(DISTINCT split) AS splits, count(*) AS members FROM members GROUP BY 1 HAVING count(DISTINCT split) > 1")
def spans_splits(spark, sf_dir):
    return graph.spanning(members(spark, sf_dir), "component", "split")


@query(f"""{MEMBERS}, s AS (SELECT component, count(*)::double AS n, sum(label)::double AS l FROM members GROUP BY 1), t AS (SELECT count(*)::double AS n, sum(label)::double AS l FROM members),
u AS (SELECT component, 'items' AS measure, round(s.n / t.n, 6) AS share FROM s, t UNION ALL SELECT component, 'label', round(s.l / t.l, 6) FROM s, t) SELECT * FROM u WHERE share > 0.003""")
def dominating_components(spark, sf_dir):
    return graph.dominating(members(spark, sf_dir), "component", {"items": F.lit(1), "label": F.col("label")}, 0.003)


@query(f"{MEMBERS} SELECT component, sum(label)::bigint AS instances FROM members WHERE split = 'test' GROUP BY 1 HAVING sum(label) > 0")
def test_fragments(spark, sf_dir):
    return graph.fragments(members(spark, sf_dir), "component", "split", "label")


@query(f"""WITH RECURSIVE {fx.PAIRS}, passed AS (SELECT a, b FROM pairs WHERE (a + b) % 3 <> 0), nodes AS (SELECT a AS item FROM passed UNION SELECT b FROM passed), {reach_sql('passed', 'nodes')} SELECT item, component FROM components""")
def rebuild_without_failed(spark, sf_dir):
    pairs = fx.pairs(spark, sf_dir).select("a", "b")
    return graph.rebuild_without(pairs, pairs.filter("(a + b) % 3 = 0"))


@query("""WITH s AS (SELECT c.p_partkey AS crop, o.p_partkey AS parent, c.p_brand = o.p_brand AS family, 100 - abs(c.p_size - o.p_size) AS score FROM part c JOIN part o ON c.p_partkey % 100 = 0 AND o.p_partkey % 100 <> 0 WHERE 100 - abs(c.p_size - o.p_size) >= 99),
f AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY score DESC, parent) AS r FROM s WHERE family), g AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY score DESC, parent) AS r FROM s WHERE NOT family AND crop NOT IN (SELECT crop FROM f))
SELECT crop, parent, score, 'family' AS phase FROM f WHERE r = 1 UNION ALL SELECT crop, parent, score, 'all' FROM g WHERE r = 1""")
def family_two_phase(spark, sf_dir):
    """Crops are the parts whose number ends in 00; every other part is a candidate."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("family"), "p_size")
    score = 100 - F.abs(F.col("p_size_c") - F.col("p_size_o"))
    return ops.parents_two_phase(parts.filter("item % 100 = 0"), parts.filter("item % 100 <> 0"), "family", score, 99, near=("p_size", 1))


@query(f"WITH {fx.PAIRS} SELECT b, a, dist FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY dist, a) AS r FROM pairs) WHERE r = 1")
def best_parent(spark, sf_dir):
    return ops.best_per(fx.pairs(spark, sf_dir), "b", F.col("dist"), F.col("a")).select("b", "a", "dist")


@query(f"WITH {KNN} SELECT count(DISTINCT (least(query, candidate), greatest(query, candidate))) AS n FROM knn WHERE c >= 0.35")
def distinct_pairs_above(spark, sf_dir):
    near = knn(spark, sf_dir).filter("cosine >= 0.35")
    return near.agg(F.count_distinct(F.struct(F.least("query", "candidate"), F.greatest("query", "candidate"))).alias("n"))


@query(f"{MEMBERS} SELECT count(*) AS items, count(DISTINCT component) AS components, count(*) - count(DISTINCT component) AS effective FROM members")
def effective_edges(spark, sf_dir):
    counts = members(spark, sf_dir).agg(F.count("*").alias("items"), F.count_distinct("component").alias("components"))
    return counts.withColumn("effective", graph.effective_edges(F.col("items"), F.col("components")))


RULES = f"""WITH {fx.ITEMS}, blocks AS (SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY prefix, number // 200) AS a, doc_id AS b FROM items) WHERE a <> b),
crops AS (SELECT doc_id + 1 AS a, doc_id AS b FROM items WHERE doc_id % 7 = 0 AND doc_id % 3 <> 0), orphans AS (SELECT * FROM items WHERE doc_id % 7 = 0 AND doc_id % 3 = 0),
strays AS (SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY prefix, number // 400) AS a, doc_id AS b FROM orphans) WHERE a <> b),
edges AS (SELECT 'a' AS rule, a, b FROM blocks UNION ALL SELECT 'b', a, b FROM crops UNION ALL SELECT 'c', a, b FROM strays)"""


def rules_of(spark, sf_dir):
    """Edges of blocks, of crops to their parents (the next document) and of crops without one."""
    items = fx.items(spark, sf_dir)
    crops = items.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("crop"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") + 1).alias("parent"))
    orphans = crops.filter("parent IS NULL").select(F.col("crop").alias("doc_id"))
    return {
        "a": block_edges_of(spark, sf_dir),
        "b": graph.crop_parent_edges(crops, "crop", "parent"),
        "c": graph.orphan_edges(items, orphans, "doc_id", "prefix", F.col("number"), 400),
    }


@query(f"{RULES} SELECT rule, least(a, b) AS a, greatest(a, b) AS b FROM edges")
def edges_by_rule(spark, sf_dir):
    """The edges that each of the three rules makes."""
    out = None
    for name, edges in rules_of(spark, sf_dir).items():
        rows = edges.select(F.lit(name).alias("rule"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def ablation_by_rule(spark, sf_dir):
    """Components and the largest one as the three rules are added."""
    return graph.ablation(table(spark, sf_dir, "documents"), "doc_id", rules_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {fx.PAIRS}, m AS (SELECT DISTINCT x.label AS a, y.label AS b FROM pairs JOIN codes x ON a = x.vec_id JOIN codes y ON b = y.vec_id WHERE x.label <> y.label), nodes AS (SELECT DISTINCT label AS item FROM codes), {reach_sql('m', 'nodes')}
SELECT item AS prefix, component FROM components""")
def prefix_components(spark, sf_dir):
    return graph.prefix_components(fx.pairs(spark, sf_dir), fx.codes(spark, sf_dir), "vec_id", "label")


@query(f"""WITH RECURSIVE {fx.PAIRS}, tied AS (SELECT label AS ga, vec_id, label * 50 + vec_id % 50 AS g FROM codes), e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM pairs JOIN tied x ON a = x.vec_id JOIN tied y ON b = y.vec_id WHERE x.g <> y.g),
nodes AS (SELECT DISTINCT g AS item FROM tied), {reach_sql('e', 'nodes')}, named AS (SELECT t.vec_id, c.component AS root FROM tied t JOIN components c ON t.g = c.item)
SELECT vec_id, min(vec_id) OVER (PARTITION BY root) AS component FROM named""")
def merged_groups(spark, sf_dir):
    """Groups of vectors, merged where a pair ties two of them."""
    items = fx.codes(spark, sf_dir).select("vec_id", (F.col("label") * 50 + F.col("vec_id") % 50).alias("grp"))
    return graph.merge_groups(items, "vec_id", "grp", fx.pairs(spark, sf_dir)).select("vec_id", "component")


@query(f"{MEMBERS} SELECT x.component, count(*) AS edges, count(*) FILTER (x.split <> y.split) AS crossing FROM pairs JOIN members x ON a = x.vec_id JOIN members y ON b = y.vec_id GROUP BY 1")
def crossing_edges(spark, sf_dir):
    return graph.crossing_edges(fx.pairs(spark, sf_dir), members(spark, sf_dir), "vec_id", "component", "split")
