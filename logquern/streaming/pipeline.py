"""Streaming queries: lines to events, events to alerts, alerts to a callback, and counts by event time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts as al
from ..operators import ingest
from ..operators.search import event_field
from ..plans.rules import Rule, match_rules
from ..sources import sinks


def store_events(lines: DataFrame, path: str, checkpoint: str, now: Column | None = None, once: bool = False) -> StreamingQuery:
    """Lines to the partitioned event table, each once."""
    events = ingest.normalize(lines, now if now is not None else F.current_timestamp())
    writer = events.writeStream.format("parquet").partitionBy("dt", "hh").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def detect(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each event and matching rule; stateless."""
    return match_rules(events, rules, event_field(events), events["line"])


def passthrough(alerts: DataFrame, correlated: DataFrame) -> DataFrame:
    """Every alert, and what correlation adds."""
    return al.union(alerts, correlated)


def in_order(alerts: DataFrame, correlated: DataFrame) -> DataFrame:
    """Every alert and correlation by time, a correlation right before the alerts of the second that completes it."""
    both = passthrough(alerts, correlated)
    return both.orderBy(F.coalesce("timestamp", "chain_end"), F.when(F.col("type") == "correlated", 0).otherwise(1))


def store_alerts(alerts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Alerts (or correlations) as JSON lines by day and hour of writing."""

    def each(batch: DataFrame, _: int) -> None:
        sinks.write_alerts(batch, path)

    writer = alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def first_start(spark: SparkSession, checkpoint: str) -> int:
    """When a query was first started with this checkpoint, in seconds: now, if it never was."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/first-start")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        out = fs.create(at)
        out.writeLong(int(time.time()))
        out.close()
    read = fs.open(at)
    found = read.readLong()
    read.close()
    return int(found)


def notify(alerts: DataFrame, checkpoint: str, send: Callable[[dict], None], least: str = "high", once: bool = False, replay: bool = False) -> StreamingQuery:
    """Sends what is notifiable, once. Alerts from before the first start are history: they aren't sent, unless replay."""
    if not replay:
        since = first_start(alerts.sparkSession, checkpoint)
        at = [F.col(n) for n in ("timestamp", "chain_end") if n in alerts.columns]
        alerts = alerts.filter(F.coalesce(*at, F.lit(since)) >= since)
    writer = alerts.writeStream.foreachBatch(al.notifier(least, send)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def rate(events: DataFrame, key: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts of tumbling event-time windows; events later than the watermark are left out."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", width), key).agg(F.count(F.lit(1)).alias("count"))
