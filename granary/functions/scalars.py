"""Scalar expressions over names, paths, labels, times and texts (all built-in functions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEM = r"^(.+?)_(\d+)$"
DATE_FORMAT = "yyyy:MM:dd HH:mm:ss"


def stem_prefix(stem: Column) -> Column:
    """PREFIX of PREFIX_NUMBER; null if the stem has another form."""
    return F.when(stem.rlike(STEM), F.regexp_extract(stem, STEM, 1))


def stem_number(stem: Column) -> Column:
    """NUMBER of PREFIX_NUMBER; null if the stem has another form."""
    return F.when(stem.rlike(STEM), F.regexp_extract(stem, STEM, 2).cast("bigint"))


def stem_strict(stem: Column) -> Column:
    """The stem itself; the query fails on a stem of another form."""
    return F.when(stem.rlike(STEM), stem).otherwise(F.raise_error(F.concat(F.lit("bad stem: "), F.coalesce(stem, F.lit("null")))))


def stem_flagged(stem: Column) -> Column:
    """(prefix, number) of a stem; one of another form is its own prefix and has the number -1."""
    known = stem.rlike(STEM)
    number = F.when(known, F.regexp_extract(stem, STEM, 2).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return F.struct(F.when(known, F.regexp_extract(stem, STEM, 1)).otherwise(stem).alias("prefix"), number.alias("number"))


def prefix_letters(stem: Column) -> Column:
    """Leading letters and underscores, without underscores at their end."""
    return F.rtrim(F.regexp_extract(stem, "^([A-Za-z_]+)", 1), F.lit("_"))


def prefix_coarse(stem: Column) -> Column:
    """Characters up to the first underscore or digit; if there are none, the first four characters."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, "^([^_0-9]*)", 1), F.lit("")), F.substring(stem, 1, 4))


def prefix_tokens(stem: Column, n: int) -> Column:
    """The first n tokens between underscores."""
    return F.substring_index(stem, "_", n)


def remap(value: Column, mapping: Mapping[int, int], dropped: Sequence[int]) -> Column:
    """Mapped class; null for a dropped one; the query fails on a class that is neither."""
    out = F.when(value.isin(*dropped), F.lit(None).cast("int"))
    for old, new in mapping.items():
        out = out.when(value == old, F.lit(new))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown class: "), value.cast("string"))))


def override(key: Column, mapping: Mapping[str, str], fallback: Column) -> Column:
    """The mapped value of a key, else the fallback."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)
    return F.coalesce(found, fallback)


def label_path(path: Column) -> Column:
    """images/.../x.jpg as labels/.../x.txt; only a folder named images is replaced."""
    return F.regexp_replace(F.regexp_replace(path, "(^|/)images/", "$1labels/"), r"\.[A-Za-z]+$", ".txt")


def label_path_inner(path: Column) -> Column:
    """The label file of an image: folders named images within a path become labels, whatever the slashes, and the last
    extension becomes txt."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"[/\\\\]images[/\\\\]", "/labels/"), r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))


def label_path_anywhere(path: Column) -> Column:
    """The label file of an image by plain replacement: every images and every .jpg, wherever they stand."""
    return F.replace(F.replace(path, F.lit("images"), F.lit("labels")), F.lit(".jpg"), F.lit(".txt"))


def split_of_path(path: Column) -> Column:
    """train, val or test as a folder of the path, else unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "(?:^|/)(train|val|test)/", 1), F.lit("")), F.lit("unknown"))


def first_non_empty(*columns: Column, default: str = "UNKNOWN") -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(default))


def replace_all(text: Column, pairs: Mapping[str, str]) -> Column:
    """Literal replacements, one after another."""
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def camera_time(text: Column) -> Column:
    """A timestamp in camera notation; null if it has another form."""
    return F.try_to_timestamp(text, F.lit(DATE_FORMAT))


def time_errors(rows: DataFrame, item: str, raw: str) -> DataFrame:
    """(item, raw) of times that have a text but no form that camera_time reads."""
    return rows.filter(F.col(raw).isNotNull() & camera_time(F.col(raw)).isNull()).select(item, F.col(raw).alias("raw"))


def time_source(original: Column, fallback: Column) -> Column:
    """Which of two parsed times is used."""
    return F.when(original.isNotNull(), "original").when(fallback.isNotNull(), "fallback").otherwise("none")


def block_of(number: Column, size: int) -> Column:
    """Integer block of a number."""
    return F.floor(number / F.lit(size)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is zero."""
    return F.try_divide(100.0 * part, whole)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; zero where both are."""
    return F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))


def area_ratio(a: Column, b: Column) -> Column:
    """Larger over smaller area; null where the smaller is zero."""
    return F.try_divide(F.greatest(a, b), F.least(a, b))


def words(text: Column) -> Column:
    """How many words white space leaves; zero for blank text."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def context(text: Column, term: Column, around: int) -> Column:
    """The text around the first place of a term; null where it is absent."""
    at = F.instr(text, term)
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.length(term) + 2 * around))


def section(text: Column, begin: str, end: str) -> Column:
    """The text between two markers; null where the first is absent, up to the end where the second is."""
    rest = F.when(F.contains(text, F.lit(begin)), F.substring_index(text, begin, -1))
    return F.substring_index(rest, end, 1)


def draw(seed: int, *keys: Column, top: int = 1 << 32) -> Column:
    """A whole number under 2^32 from keys, the same in any engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % top


def evidence(contained: Column, resolution: Column) -> Column:
    """Which of two signals speak for a crop."""
    return F.when(contained & resolution, "both").when(contained, "containment").when(resolution, "resolution").otherwise("none")
