"""The evaluator over an append log as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.evaluation import CELL, evaluate


def stream_answers(spark: SparkSession, path: str, schema: StructType | str, *, files_per_trigger: int = 100, late: str = "7 days") -> DataFrame:
    """Answers from JSON log files, each response_id once within ``late`` of the newest answer."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    timed = raw.withColumn("answered_at", F.try_to_timestamp("timestamp_utc")).where("answered_at IS NOT NULL")
    return timed.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["response_id"])


def running_cells(answers: DataFrame) -> DataFrame:
    """Count, parse rate and mean metrics of each cell so far; for output mode complete or update."""
    e = evaluate(answers)
    return e.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg(F.col("parse_success").cast("double")).alias("parse_rate"), F.avg("mrr").alias("mrr"), F.avg("recall_10").alias("recall_10"))
