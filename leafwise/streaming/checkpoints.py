"""Checkpoint evaluation as a Structured Streaming query.

Training writes one prediction file per checkpoint over hours; the same
report plan (:func:`leafwise.plans.reports.checkpoint_report`) runs
incrementally over a file stream: the per-checkpoint counts are streaming
aggregation state, the metrics are a projection of that state, and each
trigger rewrites the (small) report table through ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwise.plans.reports import checkpoint_report
from leafwise.session import scratch_dir
from leafwise.sources.files import PREDICTION_SCHEMA, checkpoint_of, file_stem


def checkpoint_stream(spark: SparkSession, root: str, schema: str = PREDICTION_SCHEMA,
                      max_files_per_trigger: int | None = None, layout: str = "flat",
                      key: str = "file") -> DataFrame:
    """Streaming rows ``(checkpoint, <schema>)`` from prediction files landing in ``root``.

    ``flat``: one file per checkpoint, named like the family; ``partitioned``:
    ``{root}/file=<stem>/part-*.csv``.
    """
    full = f"{schema}, `{key}` string" if layout == "partitioned" else schema
    # a stream has no listing to take headers from: names that are not in the declared places raise
    reader = spark.readStream.option("header", True).option("enforceSchema", False).option("escape", '"').schema(full)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(root)
    stem = F.col(key) if layout == "partitioned" else file_stem(F.col("_metadata.file_name"))
    return raw.withColumn("checkpoint", checkpoint_of(stem)).where(F.col("checkpoint").isNotNull())


def start_checkpoint_report(spark: SparkSession, root: str, out_path: str, state_path: str | None = None,
                            schema: str = PREDICTION_SCHEMA, available_now: bool = True,
                            expected_n: int = 451, layout: str = "flat") -> StreamingQuery:
    """Start the incremental report; every trigger overwrites ``out_path`` (parquet).

    Progress and aggregation state live under ``state_path`` (default: a
    folder in ``spark.checkpoint.dir``), so a restarted query resumes.
    """
    report = checkpoint_report(checkpoint_stream(spark, root, schema, layout=layout), expected_n=expected_n)

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    writer = (report.writeStream.outputMode("complete").foreachBatch(write)
              .option("checkpointLocation", state_path or scratch_dir(spark, "stream-state")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
