"""Queries on texts, claims, terms and citations, and on geometric kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import checks as ops
from ..operators import pairs as pair_ops
from ..sources.readers import table

QUERIES, ORACLE_SQL = {}, {}
TERMS = ("password", "stupid", "License", "trash")


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(f"""WITH t AS (SELECT unnest({[t.lower() for t in TERMS]}) AS term)
SELECT doc_id, term, ((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::bigint AS n, substr(text, greatest(instr(lower(text), term), 1), length(term)) AS snippet FROM documents, t WHERE contains(lower(text), term)""")
def banned_terms(spark, sf_dir):
    return ops.term_scan(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


@query("""SELECT page_id, term, ((length(lower(html)) - length(replace(lower(html), term, ''))) // length(term))::bigint AS n, substr(html, greatest(instr(lower(html), term) - 10, 1), length(term) + 20) AS snippet FROM pages, (SELECT unnest(['example.com', 'track(']) AS term) WHERE contains(lower(html), term)""")
def identifier_scan(spark, sf_dir):
    return ops.term_scan(table(spark, sf_dir, "pages"), "page_id", "html", ["example.com", "track("], 10)


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '[ \\t\\n\\x0b\\f\\r]+')) END::int AS words, length(text) BETWEEN 100 AND 5000 AS in_bounds FROM documents")
def word_bounds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.words(F.col("text")).alias("words"), F.length("text").between(100, 5000).alias("in_bounds"))


@query("SELECT page_id, marker, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1)) AS marker FROM pages) GROUP BY ALL")
def page_markers(spark, sf_dir):
    return ops.markers(table(spark, sf_dir, "pages"), "page_id", "html", 'href="/([A-Za-z]+)"')


@query("""WITH cited AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS k FROM pages), entries AS (SELECT DISTINCT lang AS k FROM documents UNION SELECT unnest(['The', 'and']))
SELECT 'no entry' AS problem, k FROM cited WHERE k NOT IN (SELECT k FROM entries) UNION ALL SELECT 'not cited', k FROM entries WHERE k NOT IN (SELECT k FROM cited)""")
def citation_closure(spark, sf_dir):
    cited = page_markers(spark, sf_dir).select(F.col("marker").alias("k"))
    entries = table(spark, sf_dir, "documents").select(F.col("lang").alias("k")).unionByName(spark.createDataFrame([("The",), ("and",)], "k string"))
    return ops.closure(cited, entries, "k")


@query("""WITH m AS (SELECT lang AS token, min(doc_id) AS first FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first, token)::int AS rank, row_number() OVER (ORDER BY token) AS want FROM m)
SELECT token, first, rank FROM r WHERE rank <> want""")
def mention_order(spark, sf_dir):
    mentions = ops.first_mentions(table(spark, sf_dir, "documents").withColumnRenamed("lang", "token"), "token", "doc_id")
    return ops.out_of_order(mentions, F.col("token"))


@query("""WITH told AS (SELECT source AS k, round(avg(n_chars), 3) + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS v FROM documents GROUP BY 1), computed AS (SELECT source AS k, avg(n_chars) AS v FROM documents WHERE source <> 'src5' GROUP BY 1)
SELECT k, round(t.v, 3) AS told, round(c.v, 3) AS computed, coalesce(abs(t.v - c.v) < 1e-3, false) AS ok FROM told t LEFT JOIN computed c USING (k)""")
def text_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mean = docs.groupBy(F.col("source").alias("k")).agg(F.avg("n_chars").alias("value"))
    told = mean.withColumn("value", F.round("value", 3) + F.when(F.col("k") == "src3", 1.0).otherwise(0.0))
    return ops.claims(told, mean.filter("k <> 'src5'"), "k", 1e-3).withColumns({c: F.round(c, 3) for c in ("told", "computed")})


@query("""WITH m AS (SELECT 'documents' AS name, count(*)::double AS value FROM documents UNION ALL SELECT 'regions', count(*)::double FROM region), e AS (SELECT unnest(['regions', 'documents', 'absent']) AS name, unnest([5, 7, 1])::double AS expected)
SELECT name, value, expected, coalesce(value = expected, false) AS ok FROM e LEFT JOIN m USING (name)""")
def expected_counts(spark, sf_dir):
    counted = lambda name, t: table(spark, sf_dir, t).agg(F.lit(name).alias("name"), F.count("*").cast("double").alias("value"))
    return ops.verdicts(counted("documents", "documents").unionByName(counted("regions", "region")), {"regions": 5, "documents": 7, "absent": 1})


@query("SELECT lang, source, count(*) AS n FROM documents WHERE (lang = 'fr' AND source = 'src0') OR (lang = 'de' AND source = 'src1') GROUP BY ALL")
def class_conflicts(spark, sf_dir):
    return ops.forbidden(table(spark, sf_dir, "documents"), [("fr", "src0"), ("de", "src1")], "lang", "source")


@query("SELECT page_id, sha256(html) AS sha256, strlen(html)::int AS bytes FROM pages")
def checksums(spark, sf_dir):
    return ops.checksums(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT doc_id, replace(replace(text, 'the', 'THE'), 'THE ', 'the_') <> text AS changed, replace(replace(text, 'the', 'THE'), 'THE ', 'the_') AS text FROM documents")
def multi_replace(spark, sf_dir):
    new = scalars.replace_all(F.col("text"), {"the": "THE", "THE ": "the_"})
    return table(spark, sf_dir, "documents").select("doc_id", (new != F.col("text")).alias("changed"), new.alias("text"))


@query("SELECT page_id, CASE WHEN contains(html, '<title>') THEN split_part(split_part(html, '<title>', -1), '</title>', 1) END AS title, CASE WHEN instr(html, 'nav') > 0 THEN substr(html, greatest(instr(html, 'nav') - 5, 1), 13) END AS around FROM pages")
def sections(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", scalars.section(html, "<title>", "</title>").alias("title"), scalars.context(html, F.lit("nav"), 5).alias("around"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_matches(x, '^[0-9][0-9]$')))::int AS n FROM documents")
def lone_numbers(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"(?<![0-9.])([0-9]{2})(?![0-9.])"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"))


@query("WITH s AS (SELECT p_partkey, greatest(10 - p_size % 12, 0) * greatest(10 - p_partkey % 12, 0) / 100.0::double AS v FROM part) SELECT p_partkey, round(v, 6) AS over_a, round(v, 6) AS over_b FROM s")
def polygon_overlap(spark, sf_dir):
    """Shares of two quadrilaterals derived from a part's numbers that each covers of the other."""

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, size in zip(f["p_partkey"], f["p_size"], strict=True):
            a = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
            b = a + np.array([size % 12, key % 12])
            out.append(geometry.containment(a, b))
        return pd.DataFrame({"p_partkey": f["p_partkey"], "over_a": [x[0] for x in out], "over_b": [x[1] for x in out]})

    found = pair_ops.verify_pairs(table(spark, sf_dir, "part").select("p_partkey", "p_size"), kernel, "p_partkey bigint, over_a double, over_b double")
    return found.withColumns({c: F.round(c, 6) for c in ("over_a", "over_b")})


@query()
def hull_coverage(spark, sf_dir):
    """Hull of a vector's coordinates, taken two by two, over the square that holds them."""

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        shares = [geometry.hull_coverage(np.asarray(v, float).reshape(-1, 2) * 100, 40_000, 40_000) for v in f["embedding"]]
        return pd.DataFrame({"vec_id": f["vec_id"], "coverage": shares})

    return pair_ops.verify_pairs(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), kernel, "vec_id bigint, coverage double")
