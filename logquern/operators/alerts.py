"""Alerts: records of matches, both kinds in one table, acknowledgements, notification."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import level_rank


def records(matches: DataFrame, event: Column, timestamp: Column | None = None) -> DataFrame:
    """Alerts of matches. timestamp: seconds of the event; None: of now."""
    return matches.select(F.lit("ruled").alias("type"), "rule_id", "rule_title", "level", event.alias("event"), (timestamp if timestamp is not None else F.unix_timestamp()).cast("long").alias("timestamp"))


def union(ruled: DataFrame, correlated: DataFrame) -> DataFrame:
    return ruled.withColumn("type", F.lit("ruled")).unionByName(correlated.withColumn("type", F.lit("correlated")), allowMissingColumns=True)


def watermarks(acks: DataFrame) -> DataFrame:
    """What is acknowledged: the latest time for each rule."""
    return acks.filter(F.col("rule_id").isNotNull() & F.col("timestamp").isNotNull()).groupBy("rule_id").agg(F.max("timestamp").alias("acked"))


def open_alerts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts later than what is acknowledged for their rule; those without rule or time always stay."""
    marks = watermarks(acks).withColumnRenamed("rule_id", "_rule")
    joined = alerts.join(marks, alerts["rule_id"] == marks["_rule"], "left")
    return joined.filter(F.col("acked").isNull() | F.col("timestamp").isNull() | (F.col("timestamp") > F.col("acked"))).drop("_rule", "acked")


def acknowledge(spark, path: str, rule_id: str, at: int | None = None, note: str | None = None) -> None:
    row = [(rule_id, int(at if at is not None else time.time()), note)]
    spark.createDataFrame(row, "rule_id string, timestamp long, note string").write.mode("append").json(path)


def notifiable(alerts: DataFrame, least: str = "high") -> DataFrame:
    """Alerts of at least a level, and every correlated one (as high); unknown levels never."""
    rank = F.when(F.col("type") == "correlated", 3).otherwise(F.coalesce(level_rank(F.col("level")), F.lit(0)))
    return alerts.filter((rank >= {"low": 1, "medium": 2, "high": 3, "critical": 4}[least]) & (rank > 0)).withColumn("priority", F.when(F.col("type") == "correlated", "high").otherwise(F.col("level")))


def notifier(least: str, send: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sends what is notifiable of a batch."""

    def each(batch: DataFrame, _: int) -> None:
        for row in notifiable(batch, least).toLocalIterator():
            send(row.asDict(True))

    return each
