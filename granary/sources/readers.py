"""Readers with explicit schemas: tables, labels, lists, training logs, images, configurations and nested results."""

from __future__ import annotations

import fnmatch
import io
import json
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import ship

STEM_OF_PATH = r"([^/]+)\.[^./]+$"
SPLIT_OF_PATH = r"/(train|val|test)/"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header under a given schema; nothing is inferred."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def padded_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose names and values are padded with blanks, all as strings."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.toDF(*[c.strip() for c in raw.columns])


def find_column(df: DataFrame, *fragments: str) -> str:
    """The column that a fragment of its name finds: fragments are tried in order, and the first column that holds one
    counts if it has a value that is a number; else the next fragment is tried. None found is an error."""
    for f in fragments:
        named = next((c for c in df.columns if f in c), None)
        if named is not None and not df.filter(F.col(named).try_cast("double").isNotNull()).isEmpty():
            return named
    raise KeyError(f"no column with {fragments}")


def truth(text: Column) -> Column:
    """A boolean written as text."""
    return F.lower(F.trim(text)) == "true"


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a list without its blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, split, stem) of files under a folder whose names match a glob, empty files too.

    The folder is listed by the driver, as any scan does; Spark's own file sources leave empty files out.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, rows = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        if fnmatch.fnmatchcase(f.getPath().getName(), pattern):
            rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    listed = spark.createDataFrame(rows, "path string, length bigint, ms bigint")
    return listed.select("path", "length", F.timestamp_millis("ms").alias("modified"), F.regexp_extract("path", SPLIT_OF_PATH, 1).alias("split"), F.regexp_extract("path", STEM_OF_PATH, 1).alias("stem"))


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, stem) of the files that are not empty."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return read.select("path", "length", "content", F.regexp_extract("path", STEM_OF_PATH, 1).alias("stem"))


def folder_size(listed: DataFrame, excluded: str | None = None) -> DataFrame:
    """(files, bytes) of a listing, without paths that hold a part."""
    kept = listed if excluded is None else listed.filter(~F.contains(F.col("path"), F.lit(excluded)))
    return kept.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def empty_files(listed: DataFrame) -> DataFrame:
    """Files without a byte."""
    return listed.filter("length = 0")


def missing_files(expected: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Expected items without a file."""
    return expected.join(listed, key, "left_anti")


def latest(listed: DataFrame) -> DataFrame:
    """(path) of the most recent file, ties to the last name."""
    return listed.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def label_lines(spark: SparkSession, path: str, stem: str = STEM_OF_PATH) -> DataFrame:
    """(stem, parts) of every line that is not blank; empty files are absent here and are found by their listing.

    stem: what of a file's path names its item; its name without the extension, unless another pattern is given.
    """
    lines = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), stem, 1).alias("stem"), F.trim("value").alias("line"))
    return lines.filter("line <> ''").select("stem", F.split("line", r"\s+").alias("parts"))


def label_boxes(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(stem, cls, cx, cy, w, h) of label lines. strict: other lines than those of five tokens are dropped; else a
    line's first token is its class and numbers that lack are null."""
    kept = lines.filter(F.size("parts") == 5) if strict else lines
    number = lambda i: F.get("parts", F.lit(i)).try_cast("double")
    return kept.select("stem", F.get("parts", F.lit(0)).try_cast("int").alias("cls"), *[number(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def known_classes(boxes: DataFrame, classes: Sequence[int], cls: str = "cls") -> DataFrame:
    """boxes; the query fails on a class that is not known."""
    bad = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(cls).cast("string"), F.lit("null"))))
    return boxes.withColumn(cls, F.when(F.col(cls).isin(*classes), F.col(cls)).otherwise(bad.cast(boxes.schema[cls].dataType)))


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of one or more lines under a given schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_leaves(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of every leaf of a small nested JSON file; read by Spark, flattened on the driver."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    out: list[tuple[str, str | None]] = []

    def walk(at: str, node: object) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(f"{at}.{k}" if at else k, v)
        elif isinstance(node, list):
            for k, v in enumerate(node):
                walk(f"{at}[{k}]", v)
        else:
            out.append((at, None if node is None else json.dumps(node)))

    walk("", json.loads(text))
    return spark.createDataFrame(out, "path string, value string")


def flat_yaml(text: str) -> dict[str, object]:
    """A configuration of scalars and one level of lists or maps; PyYAML reads it where it is installed."""
    try:
        import yaml
    except ImportError:
        found: dict[str, object] = {}
        at = None
        for line in text.splitlines():
            line = line.split(" #")[0].rstrip()
            if not line or line.lstrip().startswith("#"):
                continue
            key, _, value = line.strip().removeprefix("- ").partition(":")
            if line[0] not in " -":
                at, found[key] = key, _scalar(value) if value.strip() else None
            elif line.strip().startswith("- "):
                found[at] = [*(found[at] or []), _scalar(line.strip()[2:])]
            else:
                found[at] = {**(found[at] or {}), _scalar(key): _scalar(value)}
        return found
    return yaml.safe_load(text)


def _scalar(text: str) -> object:
    text = text.strip().strip("'\"")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text)


def configs_with(spark: SparkSession, path: str, pattern: str, part: str) -> DataFrame:
    """(path, state) of configurations that hold a part; archived if a folder of the path says so."""
    read = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    return read.filter(F.contains("value", F.lit(part))).select("path", F.when(F.lower("path").rlike("archiv|backup|/old"), "archived").otherwise("active").alias("state"))


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG or JPEG; null for other bytes."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in (0x01, *range(0xD0, 0xDA)):
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_sizes(listed: DataFrame) -> DataFrame:
    """listed (path, content) with width and height from the headers."""
    return with_kernel(listed.select("path", "content"), lambda data: image_size(bytes(data)) or (None, None), ("width", "height"), "path string, width int, height int")


def with_kernel(content: DataFrame, kernel: Callable, names: Sequence[str], schema: str) -> DataFrame:
    """(path, names..) from a kernel over the content column; the way to plug in decoders and metadata readers."""

    ship(content.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = pd.DataFrame([kernel(c) for c in f["content"]], columns=list(names)).astype(object)
            yield pd.concat([f[["path"]].reset_index(drop=True), rows.where(rows.notna(), None)], axis=1)

    return content.mapInPandas(run, schema)


def npy_values(content: DataFrame, key: str, column: str) -> DataFrame:
    """(key, shape, values) of arrays in NPY form, in row order; other bytes, and arrays of objects, fail the query."""
    ship(content.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            arrays = [np.load(io.BytesIO(bytes(c)), allow_pickle=False) for c in f[column]]
            yield pd.DataFrame({key: f[key], "shape": [list(a.shape) for a in arrays], "values": [a.astype(float).reshape(-1).tolist() for a in arrays]})

    kind = content.schema[key].dataType.simpleString()
    return content.filter(F.col(column).isNotNull()).select(key, column).mapInPandas(run, f"`{key}` {kind}, shape array<int>, values array<double>")


#: The tags of a camera's metadata that are read, and where the two further tables stand.
CAMERA_TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "time", 0x9003: "time_original"}
DETAIL_TABLE, PLACE_TABLE = 0x8769, 0x8825


def camera_metadata(data: bytes) -> dict[str, object]:
    """make, model, time, time_original, has_gps, latitude and longitude (degrees, south and west negative) from a JPEG's
    metadata; empty where there is none or it is damaged."""
    at = data.find(b"Exif\0\0") + 6
    if data[:2] != b"\xff\xd8" or at < 6 or data[at : at + 2] not in (b"II", b"MM"):
        return {}
    order, base, found = "<" if data[at : at + 2] == b"II" else ">", data[at:], {"has_gps": False}
    todo = [struct.unpack_from(order + "I", base, 4)[0]] if len(base) >= 8 else []
    for begin in todo:
        if len(todo) > 4 or begin + 2 > len(base):
            continue
        for k in range(struct.unpack_from(order + "H", base, begin)[0]):
            entry = begin + 2 + 12 * k
            if entry + 12 > len(base):
                break
            tag, kind, count, value = struct.unpack_from(order + "HHII", base, entry)
            if tag == DETAIL_TABLE:
                todo.append(value)
            elif tag == PLACE_TABLE:
                found["has_gps"] = True
                found |= _place(base, order, value)
            elif tag in CAMERA_TAGS and kind == 2:
                raw = base[entry + 8 : entry + 8 + count] if count <= 4 else base[value : value + count]
                found[CAMERA_TAGS[tag]] = raw.split(b"\0")[0].decode("ascii", "replace").strip()
    return found


def _place(base: bytes, order: str, begin: int) -> dict[str, float]:
    """latitude and longitude of a table of places: fixed tags 1 to 4, a letter and three fractions for each."""
    letters, angles = {}, {}
    if begin + 2 > len(base):
        return {}
    for k in range(struct.unpack_from(order + "H", base, begin)[0]):
        entry = begin + 2 + 12 * k
        if entry + 12 > len(base):
            break
        tag, kind, count, value = struct.unpack_from(order + "HHII", base, entry)
        if tag in (1, 3) and kind == 2:
            letters[tag] = chr(base[entry + 8])
        elif tag in (2, 4) and kind == 5 and count == 3 and value + 24 <= len(base):
            parts = struct.unpack_from(order + "6I", base, value)
            if all(parts[1::2]):
                angles[tag] = parts[0] / parts[1] + parts[2] / parts[3] / 60 + parts[4] / parts[5] / 3600
    named = {2: ("latitude", "S"), 4: ("longitude", "W")}
    return {named[t][0]: -a if letters.get(t - 1) == named[t][1] else a for t, a in angles.items()}


def camera_files(content: DataFrame) -> DataFrame:
    """(path, make, model, time, time_original, has_gps, latitude, longitude) of image files."""
    names = ("make", "model", "time", "time_original", "has_gps", "latitude", "longitude")
    return with_kernel(content.select("path", "content"), lambda data: [camera_metadata(bytes(data)).get(n) for n in names], names, "path string, make string, model string, time string, time_original string, has_gps boolean, latitude double, longitude double")
