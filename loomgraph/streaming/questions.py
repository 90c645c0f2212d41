"""Questions as they arrive: the batch jobs of routing on a stream, joined to static reports. Stateless, append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import routing
from ..sources.shared import shared_folder


def read_questions(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files under the folder whose path there, or that of a folder above them, matches the pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{pattern}")


def stored_reports(reports: DataFrame) -> DataFrame:
    """The reports as a table in the shared folder: made once, however many micro-batches are joined to them."""
    folder = shared_folder(reports.sparkSession, "reports")
    reports.write.parquet(folder)
    return reports.sparkSession.read.schema(reports.schema).parquet(folder)


def routed(questions: DataFrame, reports: DataFrame | None = None, question: str = "question") -> DataFrame:
    return routing.route(routing.classify(questions, question), reports)


def write(stream: DataFrame, path: str, checkpoint: str):
    """Runs over what has arrived and ends; the checkpoint makes a restart go on from there, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
