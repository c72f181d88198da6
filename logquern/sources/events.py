"""The canonical event table, and the view of a plain `events` table as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

SOURCE_OF = {"error": "sshd", "signup": "sudo", "purchase": "filterlog", "click": "systemd"}


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as security events: every column is derived from event_id, user_id, event_type, value and ts."""
    session.prepare(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda c: c.cast("string")
    source = F.when(F.col("event_type").isNull(), "cron")
    for kind, name in SOURCE_OF.items():
        source = source.when(F.col("event_type") == kind, name)
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        "event_id", "user_id", "event_type", "value", ts.alias("ts"),
        source.otherwise("cron").alias("_source_type"),
        F.concat(F.lit("10."), text(F.col("user_id") % 4), F.lit("."), text(F.col("event_id") % 8), F.lit("."), text(F.col("event_id") % 250)).alias("src_ip"),
        F.concat(F.lit("172.16."), text(F.col("user_id") % 16), F.lit("."), text(F.col("event_id") % 32)).alias("dst_ip"),
        F.when(F.col("event_id") % 3 == 0, "22").when(F.col("event_id") % 3 == 1, "80").otherwise("443").alias("dst_port"),
        F.when(F.col("value") >= 200, "critical").when(F.col("value") >= 100, "warning").otherwise("informational").alias("severity"),
        F.when(F.col("event_type") != "purchase", "").when(F.col("event_id") % 4 == 0, "ALLOW").otherwise("BLOCK").alias("action"),
        F.when(F.col("event_id") % 10 == 0, "").otherwise(F.concat(F.lit("user"), text(F.col("user_id")))).alias("username"),
        F.date_trunc("second", ts).cast("timestamp_ntz").alias("event_sec"),
        ts.cast("date").alias("dt"), F.hour(ts).alias("hh"),
        F.concat(F.lit('{"event_id":'), text(F.col("event_id")), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}")).alias("line"),
    )


#: The same view for DuckDB.
EVENTS_SQL = """ev AS (
  SELECT event_id, user_id, event_type, value, ts,
    CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sudo' WHEN 'purchase' THEN 'filterlog' WHEN 'click' THEN 'systemd' ELSE 'cron' END AS _source_type,
    '10.' || (user_id % 4) || '.' || (event_id % 8) || '.' || (event_id % 250) AS src_ip,
    '172.16.' || (user_id % 16) || '.' || (event_id % 32) AS dst_ip,
    CASE event_id % 3 WHEN 0 THEN '22' WHEN 1 THEN '80' ELSE '443' END AS dst_port,
    CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'warning' ELSE 'informational' END AS severity,
    CASE WHEN event_type <> 'purchase' THEN '' WHEN event_id % 4 = 0 THEN 'ALLOW' ELSE 'BLOCK' END AS action,
    CASE WHEN event_id % 10 = 0 THEN '' ELSE 'user' || user_id END AS username,
    date_trunc('second', ts) AS event_sec, CAST(ts AS DATE) AS dt, CAST(hour(ts) AS INTEGER) AS hh,
    '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":' || props || '}' AS line
  FROM events
)"""
