"""An incremental batch run: what is pending, the next few, and what became of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.relations import pending

STATE = "dataset string, file_id string, failed boolean, error string"


def next_batch(files: DataFrame, state: DataFrame, outputs: DataFrame, dataset: str, size: int) -> DataFrame:
    """The first ``size`` files (file_id) of a dataset, by name, that are neither done nor have an output.

    Files that failed are tried again.
    """
    done = state.where((F.col("dataset") == dataset) & ~F.coalesce("failed", F.lit(False)))
    left = pending(pending(files, done), outputs)
    return left.orderBy("file_id").limit(max(0, size))


def run_batch(spark: SparkSession, batch: DataFrame, dataset: str, process: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], state_path: str) -> DataFrame:
    """Process a batch as one job and append its outcome to the state; gives the outcome.

    ``process`` keeps file_id and gives ``problem`` (null where all went well); rows with a problem are not
    written.  If the job as a whole fails, every file of the batch is noted as failed with its error.
    """
    try:
        done = process(batch)
        write(done.where("problem is null").drop("problem"))
        outcome = batch.select("file_id").join(done.groupBy("file_id").agg(F.max("problem").alias("error")), "file_id", "left")
        rows = outcome.select(F.lit(dataset).alias("dataset"), "file_id", F.col("error").isNotNull().alias("failed"), "error")
        rows.write.mode("append").parquet(state_path)
    except Exception as problem:  # noqa: BLE001  a failing batch must not stop the next one
        rows = batch.select(F.lit(dataset).alias("dataset"), "file_id", F.lit(True).alias("failed"), F.lit(str(problem)[:500]).alias("error"))
        rows.write.mode("append").parquet(state_path)
    return rows
