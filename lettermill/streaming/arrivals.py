"""New messages from a growing table, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.criteria import compile_criteria
from ..operators.select import summary, with_headers
from ..schema import MESSAGE
from ..sources.stored import APPENDED, GEN, Store


def arrivals(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the messages that are appended to a stored table (not of those that a deletion or a
    move wrote anew), or of the Parquet files that come into a plain folder."""
    table = Store(spark, path)
    fresh = spark.readStream.option("maxFilesPerTrigger", files_at_once)
    if not table.exists():
        return fresh.schema(MESSAGE).parquet(path)
    return fresh.schema(T.StructType([*MESSAGE.fields, GEN])).option("basePath", f"{table.path}/data").parquet(f"{table.path}/data/gen={APPENDED}*").drop("gen")


def once(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (folder, uid) once, as long as repeats come within `late`: state is bounded by that."""
    dated = messages.withColumn("arrived", messages["internal_date"].cast("timestamp")).withWatermark("arrived", late)
    return dated.dropDuplicatesWithinWatermark(["folder", "uid"]).drop("arrived")


def watch(messages: DataFrame, criteria, checkpoint: str) -> DataStreamWriter:
    """A writer of summaries of the messages that meet the criteria; the caller names the sink."""
    return summary(with_headers(messages).where(compile_criteria(criteria))).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
