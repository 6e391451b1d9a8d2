"""Sessions over time, numbering gaps and their enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_gap(events: DataFrame, camera: str, time: str, item: str, minutes: int) -> DataFrame:
    """events with session: a new one begins where the gap is longer than so many minutes; an equal gap stays."""
    w = Window.partitionBy(camera).orderBy(time, item)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    begun = F.when(gap > minutes * 60 * 1_000_000, 1).otherwise(0)
    return events.withColumn("_b", begun).withColumn("session", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def by_day(events: DataFrame, camera: str, time: str) -> DataFrame:
    """events with session: the number of the calendar day among the camera's days."""
    return events.withColumn("session", F.dense_rank().over(Window.partitionBy(camera).orderBy(F.to_date(time))) - 1)


def stats(sessions: DataFrame, camera: str) -> DataFrame:
    """Sessions, items, and the mean and largest size over all cameras."""
    sizes = sessions.groupBy(camera, "session").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("sessions"), F.sum("n").alias("items"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"))


def inherited(crops: DataFrame, sessions: DataFrame, item: str, parent: str) -> DataFrame:
    """(item, session) of crops through their parents."""
    of = sessions.select(F.col(item).alias("_p"), "session")
    return crops.join(of, F.col(parent) == F.col("_p")).select(item, "session")


def unplaceable(items: DataFrame, timed: DataFrame, heirs: DataFrame, item: str) -> DataFrame:
    """Items that have neither a time nor a parent with one."""
    return items.join(timed.select(item).unionByName(heirs.select(item)).distinct(), item, "left_anti")


def gap_distribution(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """(pairs, close, fraction): numeric gaps between pair ends that are at most so large."""
    close = F.abs(F.col(a) - F.col(b)) <= most
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(close).alias("close"), F.avg(close.cast("double")).alias("fraction"))


def enrichment(strong: DataFrame, random: DataFrame, factor: float = 3.0, least: int = 30) -> DataFrame:
    """(n, strong_fraction, random_fraction, enriched): whether close numbers are that much more frequent among strong pairs."""
    s = strong.select(F.col("pairs").alias("n"), F.col("fraction").alias("strong_fraction"))
    joined = s.join(F.broadcast(random.select(F.col("fraction").alias("random_fraction"))))
    return joined.withColumn("enriched", (F.col("n") >= least) & (F.col("strong_fraction") >= factor * F.col("random_fraction")))
