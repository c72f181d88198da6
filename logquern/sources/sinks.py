"""Sinks: partitioned tables, idempotent loads, side files, rendered results, retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tsv

SIDECAR = ("timestamp", "src_ip", "dst_ip", "event_type", "severity", "_source_type")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """By day and hour; rows of a file in order of source, so that row groups can be skipped by source and address.
    mode="overwrite" replaces the hours that events have, and no other."""
    sort = [c for c in ("_source_type", "src_ip") if c in events.columns]
    out = events.repartition("dt", "hh", F.pmod(F.xxhash64(*sort), F.lit(8)) if sort else F.lit(0)).sortWithinPartitions("dt", "hh", *sort)
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("dt", "hh")
    for c in sort:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def upsert(events: DataFrame, path: str, key: str = "rec_id") -> DataFrame:
    """Appends the events that the table lacks; loading twice changes nothing. Gives what was new."""
    spark = events.sparkSession
    new = events.dropDuplicates([key])
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        hours = new.select("dt", "hh").distinct()
        new = new.join(old.join(hours, ["dt", "hh"], "left_semi").select(key), key, "left_anti").select(*events.columns)
    write_events(new, path)
    return new


def backfill(events: DataFrame, path: str, hours: Sequence[tuple[str, int]] | None = None) -> None:
    """Writes the hours of the events anew (of those given only, as day and hour), and no other."""
    if hours is not None:
        wanted = [(F.col("dt") == F.lit(day).cast("date")) & (F.col("hh") == hour) for day, hour in hours]
        events = events.filter(reduce(lambda a, b: a | b, wanted, F.lit(False)))
    write_events(events, path, mode="overwrite")


def reindex_all(events: DataFrame, path: str) -> None:
    """The whole table anew, from all events."""
    clear(events.sparkSession, path)
    write_events(events, path)


def reindex_new(events: DataFrame, path: str) -> None:
    """The newest hour of the table and all later ones anew; that hour stays as it is where no event of it is left."""
    newest = events.sparkSession.read.parquet(path).agg(F.max(F.struct("dt", "hh")).alias("x")).first()["x"]
    if newest is not None:
        later = F.col("dt") > F.lit(newest["dt"])
        events = events.filter(later | ((F.col("dt") == F.lit(newest["dt"])) & (F.col("hh") >= newest["hh"])))
    write_events(events, path, mode="overwrite")


def clear(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_alerts(alerts: DataFrame, path: str, now: Column | None = None) -> None:
    """JSON lines by day and hour of writing."""
    now = now if now is not None else F.current_timestamp()
    out = alerts.withColumn("dt", F.date_format(now, "yyyy-MM-dd")).withColumn("hh", F.date_format(now, "HH"))
    out.write.mode("append").partitionBy("dt", "hh").json(path)


def sidecar(events: DataFrame) -> DataFrame:
    """The six columns of the side file."""
    of = lambda n: F.col(n) if n in events.columns else (F.get(F.array(F.col("fields")[n]), F.lit(0)) if "fields" in events.columns else F.lit(""))
    return events.select(*[tsv(of(n)).alias("source" if n == "_source_type" else n) for n in SIDECAR])


def write_sidecar(events: DataFrame, path: str) -> None:
    sidecar(events).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def as_json(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """Each row as JSON, in the order of columns, nulls written."""
    return F.to_json(F.struct(*[F.col(n) for n in (names or df.columns)]), {"ignoreNullFields": "false"})


def as_tsv(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    return F.concat_ws("\t", *[tsv(F.col(n)) for n in (names or df.columns)])


def render(df: DataFrame, form: str = "json") -> DataFrame:
    """One column, `value`. The header of tsv is df.columns."""
    return df.select((as_json(df) if form == "json" else as_tsv(df)).alias("value"))


def retention(spark: SparkSession, path: str, days: int, today: date, confirmed: bool = False) -> list[str]:
    """Deletes the days before today - days. days=0 needs to be confirmed. Gives the partitions that went."""
    if days < 0 or (days == 0 and not confirmed):
        raise ValueError("deleting everything needs to be confirmed")
    cutoff = today - timedelta(days=days)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("dt=") and date.fromisoformat(name[3:]) < cutoff:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone


def compact_acks(acks: DataFrame, cutoff: int) -> DataFrame:
    """Acknowledgements that still count: those not before the cutoff, or without a readable time."""
    return acks.filter(F.col("timestamp").isNull() | (F.col("timestamp") >= cutoff))
