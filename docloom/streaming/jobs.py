"""The job queue as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_jobs(submitted: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], sink: str, checkpoint: str):
    """Starts a stream that runs each batch's distinct jobs by type and appends (id, job_type, status, result) to ``sink``.

    A handler takes the jobs of its type and returns (id, result). Jobs without a handler
    fail. A batch that runs again after a failure replaces its own folder.
    """

    def batch(jobs: DataFrame, n: int) -> None:
        first = jobs.groupBy("paper_id", "job_type", "params").agg(F.min("id").alias("id"))
        out = None
        for kind, handler in handlers.items():
            mine = first.where(F.col("job_type") == kind)
            done = mine.select("id", "job_type").join(handler(mine), "id", "left")
            done = done.select("id", "job_type", F.when(F.col("result").isNull(), "failed").otherwise("completed").alias("status"), "result")
            out = done if out is None else out.unionByName(done)
        lost = first.where(~F.col("job_type").isin(list(handlers))).select("id", "job_type", F.lit("failed").alias("status"), F.lit("no handler").alias("result"))
        out = lost if out is None else out.unionByName(lost)
        out.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return submitted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
