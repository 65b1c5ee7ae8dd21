"""Figures about batches and runs, and texts that are worked on once however often they occur."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_stats(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(texts, ok, entities, mean_seconds, per_second) of results with success, entities and seconds."""
    seconds = F.sum("seconds")
    made = [
        F.count(F.lit(1)).alias("texts"), F.sum(F.col("success").cast("long")).alias("ok"), F.sum("entities").cast("long").alias("entities"),
        (seconds / F.count(F.lit(1))).alias("mean_seconds"), (F.count(F.lit(1)) / F.greatest(seconds, F.lit(0.001))).alias("per_second"),
    ]
    return (results.groupBy(*by) if by else results).agg(*made)


def performance(runs: DataFrame, order: str, last: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """Of the last runs (by ``order``, of each group): mean, most and least seconds, mean and most throughput, mean share of cache hits.
    Without groups the last runs are a top-k, which Spark takes without sorting all; with them a window limited to its first rows."""
    if by:
        place = Window.partitionBy(*by).orderBy(F.desc(order))
        runs = runs.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= last).drop("_n")
    else:
        runs = runs.orderBy(F.desc(order)).limit(last)
    hits = F.coalesce(F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses")).cast("double")), F.lit(0.0))
    made = [F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("most_seconds"), F.min("seconds").alias("least_seconds"), F.avg("chars_per_second").alias("mean_throughput"), F.max("chars_per_second").alias("most_throughput"), F.avg(hits).alias("hit_rate"), F.count(F.lit(1)).alias("runs")]
    return (runs.groupBy(*by) if by else runs).agg(*made)


def normalised(text: Column) -> Column:
    """Without white space at the ends, every other run of it a blank."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def text_hash(text: Column) -> Column:
    return F.md5(text)


def once(df: DataFrame, work: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``df`` with the columns that ``work`` adds to a relation of (text), worked out once for each distinct text.

    Texts are grouped by a digest, so that copies are folded before the shuffle and text moves once; what comes back is
    joined by the digest. Worth it where copies are many; rows that occur once cost two shuffles more."""
    keyed = df.withColumn("__digest", F.sha2(F.col(text), 256))
    distinct = keyed.where(F.col(text).isNotNull()).groupBy("__digest").agg(F.any_value(text).alias(text))
    done = work(distinct)
    new = [c for c in done.columns if c not in (text, "__digest")]
    return keyed.join(done.select("__digest", *new), "__digest", "left").select(*df.columns, *new)
