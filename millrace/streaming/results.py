"""Running statistics of a folder of result files, resumable from a checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, name: str, max_files: int = 100) -> DataFrame:
    """A stream over the files of a table; each file is read once."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def run_counts(stream: DataFrame, out: str, state: str) -> None:
    """Append the counts per model and day of every batch to ``out``, once each, until all files are read.

    A batch is written under its number, so a batch that is repeated after a failure replaces its own rows. The offsets
    and the numbers are in ``state``; a later run goes on behind them.
    """

    def sink(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("model", "run_day").agg(F.count("*").alias("answers"), F.count_if("correct").alias("n_correct"), F.count_if("error").alias("n_error"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def total_counts(spark: SparkSession, out: str) -> DataFrame:
    """The sums over all batches."""
    return spark.read.parquet(out).groupBy("model", "run_day").agg(*(F.sum(c).alias(c) for c in ("answers", "n_correct", "n_error")))

