"""Writers: tables, split lists, manifests, nested results and reports."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import ship

MOST_COPIED = 20 * 1024 * 1024


def csv_out(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """A CSV folder with a header, of all columns or some."""
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True)


def split_lists(df: DataFrame, path: str, item: str, split: str) -> None:
    """A sorted text list for each split, in a folder of its own."""
    lines = df.select(F.col(item).cast("string").alias("value"), F.col(split).alias("split"))
    lines.repartitionByRange("split", "value").sortWithinPartitions("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def next_version(df: DataFrame, folder: str, version: int) -> str:
    """A manifest's next version beside the earlier ones; inputs are never overwritten."""
    path = f"{folder}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def merge_section(spark: SparkSession, path: str, section: str, value: object) -> None:
    """Replace one section of a JSON file, on any file system that Spark reaches; the file is swapped when it is whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.draft"))
    store = file.getFileSystem(conf)
    whole = json.loads(spark.read.text(path, wholetext=True).first()["value"]) if store.exists(file) else {}
    whole[section] = value
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(whole, indent=2, sort_keys=True).encode()))
    out.close()
    store.delete(file, False)
    store.rename(draft, file)


def npy_bytes(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, content) of arrays of numbers in NPY form, as doubles."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f[values]:
                held = io.BytesIO()
                np.save(held, np.asarray(v, float), allow_pickle=False)
                out.append(held.getvalue())
            yield pd.DataFrame({key: f[key], "content": out})

    kind = df.schema[key].dataType.simpleString()
    return df.filter(F.col(values).isNotNull()).select(key, values).mapInPandas(run, f"`{key}` {kind}, content binary")


def json_column(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more rows than most are an error, as reports hold aggregates."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def copy_plan(items: DataFrame, path: Column, target: Column, length: Column) -> DataFrame:
    """(path, target, bytes) of files to copy; the query fails on one over the limit."""
    safe = F.when(length <= MOST_COPIED, length).otherwise(F.raise_error(F.concat(F.lit("too large: "), path)).cast("bigint"))
    return items.select(path.alias("path"), target.alias("target"), safe.alias("bytes"))


def relative(path: Column, prefix: str) -> Column:
    """The path after a prefix; the query fails on a path elsewhere."""
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(F.raise_error(F.concat(F.lit("outside: "), path)))
