"""Counting: groups, coverage, trends, volumes against a baseline, top lists, gaps."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from ..timeutil import Window as Range
from ..timeutil import series_bucket, series_length


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled, total, pct: one pass over the table, whatever the number of fields."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(filled(F.col(f).cast("string"))).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.col("total")) for f in fields]))
    return one.select(rows.alias("r")).select("r.*").withColumn("pct", F.round(100 * F.col("filled") / F.col("total"), 4))


def trend(df: DataFrame, key: str, time: Column, window: Range, width: timedelta) -> DataFrame:
    """A row for each key, a column b0, b1, ... for each bucket, zeros filled; empty keys are left out."""
    n = series_length(window, width)
    inside = df.filter(window.contains(time) & filled(F.col(key))).withColumn("_b", series_bucket(time, window, width))
    return inside.groupBy(key).agg(*[F.count_if(F.col("_b") == i).alias(f"b{i}") for i in range(n)], F.count(F.lit(1)).alias("total"))


def trend_table(df: DataFrame, key: str, time: Column, window: Range, width: timedelta, ungrouped: bool = False) -> DataFrame:
    """trend, the largest total first. ungrouped: where no row has the key, one row `(total, ungrouped)` of all of them."""
    if ungrouped:
        any_ = df.filter(window.contains(time)).agg(F.max(filled(F.col(key)))).first()[0]
        if any_ is False:
            df = df.withColumn(key, F.lit("(total, ungrouped)"))
    return trend(df, key, time, window, width).orderBy(F.desc("total"), key)


def series(df: DataFrame, time: Column, window: Range, width: timedelta) -> DataFrame:
    """bucket, count of every tumbling bucket of the window, empty ones too."""
    counted = df.filter(window.contains(time)).groupBy(series_bucket(time, window, width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(series_length(window, width)).withColumnRenamed("id", "bucket")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("count"))


def volume(df: DataFrame, key: str, time: Column, window: Range, spike: float = 50.0, least: int = 5, new: bool = True, cold: bool = False) -> DataFrame:
    """key, count, baseline, delta_pct, flag: the window against the one before it, in one aggregation. A drop to nothing
    is flagged whatever the counts; else both sides under `least` are noise."""
    before = window.baseline()
    both = Range(before.start, window.end)
    out = df.filter(both.contains(time) & filled(F.col(key))).groupBy(key).agg(F.count_if(window.contains(time)).alias("count"), F.count_if(before.contains(time)).alias("baseline"))
    pct = (F.col("count") - F.col("baseline")) / F.col("baseline") * 100.0
    noise = (F.col("count") < least) & (F.col("baseline") < least)
    flag = F.when((F.col("baseline") == 0) & F.lit(new and not cold) & (F.col("count") > 0), "new")
    flag = flag.when((F.col("baseline") > 0) & (F.col("count") == 0), "drop").when((F.col("baseline") > 0) & (pct > spike) & ~noise, "spike").when((F.col("baseline") > 0) & (pct < -spike) & ~noise, "drop")
    return out.select(key, "count", "baseline", F.when(F.col("baseline") > 0, F.round(pct, 4)).alias("delta_pct"), flag.alias("flag"))


def seen(df: DataFrame, key: str, time: Column) -> DataFrame:
    return df.groupBy(key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("count"))


def only_in(df: DataFrame, key: str, time: Column, window: Range, other: Range) -> DataFrame:
    """Keys of the window that the other window lacks, as one aggregation."""
    both = df.filter((window.contains(time) | other.contains(time)) & filled(F.col(key)))
    return both.groupBy(key).agg(F.count_if(window.contains(time)).alias("a"), F.count_if(other.contains(time)).alias("b")).filter("a > 0 AND b = 0").select(key)


def gap_clusters(df: DataFrame, name: str, time: str, gap: int = 300, least: int = 5) -> DataFrame:
    """Clusters of rows of which each follows the one before by at most `gap` seconds; those of `least` rows and more:
    count, names in order, first and last time. time: seconds (long); rows without one take no part.

    The rows of a day are put in order apart, and the days joined by what each begins and ends with, so no task sorts
    all rows."""
    rows = df.filter(F.col(time).isNotNull()).select(F.col(name).alias("name"), F.col(time).alias("t"), F.floor(F.col(time) / 86400).alias("day"))
    by_day = Window.partitionBy("day").orderBy("t", "name")
    rows = rows.withColumn("before", F.lag("t").over(by_day))
    ends = rows.groupBy("day").agg(F.max("t").alias("end"))
    spans = ends.select("day", F.lag("end").over(Window.orderBy("day")).alias("end_before"))  # a row for each day
    rows = rows.join(spans, "day").withColumn("new", (F.coalesce(F.col("t") - F.coalesce("before", "end_before") > gap, F.lit(True))).cast("long"))
    opened = rows.groupBy("day").agg(F.sum("new").alias("opened"))
    opened = opened.select("day", F.coalesce(F.sum("opened").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.join(opened, "day").withColumn("cluster", F.col("base") + F.sum("new").over(by_day))
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("name")).alias("names"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.filter(F.col("count") >= least).drop("cluster")


def top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    return group_count(df, *keys).orderBy(F.desc("count"), *keys).limit(k)


def concentration(df: DataFrame, key: str, share: float) -> DataFrame:
    """The most frequent key, if its share of all rows is above `share`."""
    counts = group_count(df, key)
    one = counts.agg(F.max_by(key, F.struct(F.col("count"), F.col(key))).alias(key), F.max("count").alias("count"), F.sum("count").alias("total"))
    return one.filter(F.col("count") > share * F.col("total")).withColumn("pct", F.round(100 * F.col("count") / F.col("total"), 4))


def breakdown(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """key, total and its parts as `a/b:n` in order, joined with ';'."""
    inner = group_count(df, key, *parts)
    item = F.struct(F.concat(F.concat_ws("/", *parts), F.lit(":"), F.col("count").cast("string")).alias("item"))
    return inner.groupBy(key).agg(F.sum("count").alias("total"), F.array_join(F.array_sort(F.collect_list(item["item"])), ";").alias("parts"))


def normalization_rate(df: DataFrame) -> DataFrame:
    """total, normalized, pct."""
    one = df.agg(F.count(F.lit(1)).alias("total"), F.count_if("_normalized").alias("normalized"))
    return one.withColumn("pct", F.round(100 * F.col("normalized") / F.nullif(F.col("total"), F.lit(0)), 4))


@dataclass
class FileStatus:
    total: int
    by_source: list


def file_status(events: DataFrame) -> FileStatus:
    """Bytes of all files, and by source the number of files that hold it and the newest one. Only the source is read, and
    what Spark knows of files."""
    m = F.col("_metadata")
    files = events.select("_source_type", m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("at")).distinct()
    total = files.select("path", "size").distinct().agg(F.sum("size")).first()[0] or 0
    by = files.groupBy("_source_type").agg(F.count(F.lit(1)).alias("files"), F.max("at").alias("last")).orderBy("_source_type")
    return FileStatus(int(total), [r.asDict() for r in by.collect()])
