"""Lines of files and sockets, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled


def strip_octet_count(df: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a TCP stream may begin with their length and a space."""
    return df.withColumn(column, F.regexp_replace(F.col(column), r"^\d+ ", ""))


def read(spark: SparkSession, path: str, source_addr: str = "stdin") -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).filter(filled(F.col("value"))).withColumn("source_addr", F.lit(source_addr))


def follow(spark: SparkSession, path: str, files_per_trigger: int = 100, source_addr: str = "stdin") -> DataFrame:
    """Each new file of a folder once; the checkpoint keeps which ones were read."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(path)
    return stream.filter(filled(F.col("value"))).withColumn("source_addr", F.lit(source_addr))


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """For development: Spark's socket source keeps no offsets."""
    return strip_octet_count(spark.readStream.format("socket").option("host", host).option("port", port).load()).withColumn("source_addr", F.lit(host))


def alerts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Alerts written as JSON lines; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
