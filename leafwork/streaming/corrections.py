"""Running figures of the correction log, kept by a stream: count, mean and share of low confidence for each source.

An exact median is no streaming aggregate; the threshold that needs it is
recomputed from the log (query auto_tune) or in foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("block_id", "source")]
    + [T.StructField(n, T.DoubleType()) for n in ("old_confidence", "new_confidence")]
    + [T.StructField(n, T.StringType()) for n in ("old_text", "new_text")]
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of JSON lines; a line that is no JSON is dropped."""
    lines = spark.readStream.schema(T.StructType([*SCHEMA.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return lines.where("_corrupt is null").drop("_corrupt")


def figures(log: DataFrame, low: float = 0.5) -> DataFrame:
    """source, n, mean_confidence, low_share; works on a stream and on a table."""
    c = F.col("new_confidence")
    return log.groupBy("source").agg(F.count("*").alias("n"), F.avg(c).alias("mean_confidence"), (F.count_if(c < low) / F.count("*")).alias("low_share"))
