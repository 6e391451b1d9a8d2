"""Consistency checks: expected counts, published numbers, term scans, citations and checksums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdicts(metrics: DataFrame, expected: Mapping[str, float]) -> DataFrame:
    """(name, value, expected, ok) of a (name, value) table; a missing value is not ok."""
    rules = metrics.sparkSession.createDataFrame([(k, float(v)) for k, v in expected.items()], "name string, expected double")
    return F.broadcast(rules).join(metrics, "name", "left").select("name", "value", "expected", F.coalesce(F.col("value") == F.col("expected"), F.lit(False)).alias("ok"))


def enforce(checked: DataFrame) -> None:
    """Raise ValueError with all rows that are not ok, after all have been gathered."""
    bad = checked.filter("not ok").collect()
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {r['value']} instead of {r['expected']}" for r in bad))


def claims(told: DataFrame, computed: DataFrame, key: str, tolerance: float = 5e-4) -> DataFrame:
    """(key, told, computed, ok): numbers in a text against computed ones."""
    joined = told.select(key, F.col("value").alias("told")).join(computed.select(key, F.col("value").alias("computed")), key, "left")
    return joined.withColumn("ok", F.coalesce(F.abs(F.col("told") - F.col("computed")) < tolerance, F.lit(False)))


def term_scan(texts: DataFrame, item: str, text: str, terms: Sequence[str], around: int = 0) -> DataFrame:
    """(item, term, n, snippet): literal terms found in texts, whatever their case."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t.lower())) for t in terms]))
    hits = texts.select(F.col(item), F.col(text).alias("_text"), low.alias("_low"), F.explode(found).alias("term"))
    n = ((F.length("_low") - F.length(F.replace(F.col("_low"), F.col("term"), F.lit("")))) / F.length("term")).cast("bigint")
    at = F.instr(F.col("_low"), F.col("term"))
    snippet = F.col("_text").substr(F.greatest(at - around, F.lit(1)), F.length("term") + 2 * around)
    return hits.select(item, "term", n.alias("n"), snippet.alias("snippet"))


def markers(texts: DataFrame, item: str, text: str, pattern: str) -> DataFrame:
    """(item, marker, n): matches of a pattern's first group."""
    found = F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("marker")
    return texts.select(item, found).groupBy(item, "marker").agg(F.count("*").alias("n"))


def closure(cited: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(problem, key): citations without an entry and entries without a citation."""
    a = cited.select(key).distinct().join(entries, key, "left_anti").select(F.lit("no entry").alias("problem"), key)
    b = entries.select(key).distinct().join(cited, key, "left_anti").select(F.lit("not cited").alias("problem"), key)
    return a.unionByName(b)


def first_mentions(tokens: DataFrame, token: str, place: str) -> DataFrame:
    """(token, first, rank): tokens by their first place."""
    from pyspark.sql.window import Window

    firsts = tokens.groupBy(token).agg(F.min(place).alias("first"))
    return firsts.withColumn("rank", F.row_number().over(Window.orderBy("first", token)))


def out_of_order(mentions: DataFrame, number: Column) -> DataFrame:
    """Mentions whose rank is not the rank of their number."""
    from pyspark.sql.window import Window

    return mentions.withColumn("_want", F.row_number().over(Window.orderBy(number))).filter("rank <> _want").drop("_want")


def forbidden(boxes: DataFrame, rules: Sequence[tuple[str, str]], cls: str, source: str) -> DataFrame:
    """(class, source, n) of combinations that must not occur."""
    bad = F.lit(False)
    for c, s in rules:
        bad = bad | ((F.col(cls) == c) & (F.col(source) == s))
    return boxes.filter(bad).groupBy(cls, source).agg(F.count("*").alias("n"))


def checksums(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, sha256, bytes)."""
    return files.select(path, F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("bytes"))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Whether a recomputed number agrees with a reported one."""
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def crop_parent_span(crops: DataFrame, assigned: DataFrame, item: str, split: str, known_limitation: bool = False) -> DataFrame:
    """(pairs, crossing, verdict): crops (crop, parent) whose parent is in another split; pairs with an end that has no
    split are not counted. Crossing pairs fail the check, unless they are a known limitation of how groups were made."""
    side = lambda end: assigned.select(F.col(item).alias(end), F.col(split).alias(f"_s_{end}"))
    met = crops.select("crop", "parent").join(side("crop"), "crop").join(side("parent"), "parent")
    counts = met.agg(F.count("*").alias("pairs"), F.count_if(F.col("_s_crop") != F.col("_s_parent")).alias("crossing"))
    return counts.withColumn("verdict", F.when(F.col("crossing") == 0, "ok").otherwise("known limitation" if known_limitation else "failed"))


def delete_one(rows: DataFrame, matches: Column) -> DataFrame:
    """rows without the one that matches; raises ValueError unless just one does."""
    hit = F.coalesce(matches, F.lit(False))
    n = rows.filter(hit).count()
    if n != 1:
        raise ValueError(f"{n} rows match, not one")
    return rows.filter(~hit)
