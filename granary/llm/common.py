"""What several operators share: bounded slices of Arrow batches and joins that stand a hot key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard as discard
from ..functions.storage import new_path as new_path
from ..functions.storage import ship as ship
from ..functions.storage import stored as materialize  # noqa: F401

#: Bytes of text that a worker holds as Python objects at once, unless one text alone has more. Spark bounds the batches
#: it sends by bytes too (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
SLICE_BYTES = 1 << 23
#: A join broadcasts keys that more than 1/HOT_KEYS of the rows carry; there are at most HOT_KEYS of them.
HOT_KEYS = 1000


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts (of a column by number) have at most so many bytes together."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def unit_draw(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) from a key: the first 13 hex digits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def attach(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], rows: str, total: int, spread: str) -> DataFrame:
    """left joined to values of right, which has one row a key and says in column rows how many left rows carry it.

    Keys with more than total / HOT_KEYS rows number at most HOT_KEYS; these are broadcast. The left rows that found
    theirs keep a salt made of column spread, so the shuffle join deals them evenly. Nulls are equal to nulls.
    right must be a materialized table, as it is read twice.
    """
    limit = max(total // HOT_KEYS, 1)
    right_keys = [F.col(k).alias(f"_k_{k}") for k in keys]
    hot = right.filter(F.col(rows) > limit).select(*right_keys, *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_hot"))
    cold = right.filter(F.col(rows) <= limit).select(*right_keys, *[F.col(v).alias(f"_c_{v}") for v in values], F.lit(0).alias("_k_salt"))

    def same(on: list[str]) -> Column:
        found = F.lit(True)
        for k in on:
            found = found & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return found

    drop = [f"_k_{k}" for k in keys]
    with_hot = left.join(F.broadcast(hot), same(keys), "left").drop(*drop)
    salted = with_hot.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(9973)) + 1).otherwise(0).cast("int"))
    joined = salted.join(cold, same(keys) & (F.col("_salt") == F.col("_k_salt")), "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"_h_{v}"), F.col(f"_c_{v}")).alias(v) for v in values])
