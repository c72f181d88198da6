"""Spark sessions set up for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Spark 4.1 loses aliases of struct fields that it makes below several generators (INTERNAL_ERROR_ATTRIBUTE_NOT_FOUND).
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("logquern")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that queries rely on, for a session made elsewhere."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy", "spark.sql.optimizer.expression.nestedPruning.enabled"):
        spark.conf.set(key, SETTINGS[key])
    return spark
