"""Incremental processing: rows that arrive in a folder are handled once.

The reference's nearest counterpart is skipping inputs whose output exists. See ``jobs`` for jobs with a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from prismflow.operators.split import not_done


def process_new(spark: SparkSession, source: str, schema: str, target: str, state: str, key: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``work`` on every Parquet row that arrives in ``source`` and whose key ``target`` lacks; ends when all is done.

    The key check makes a batch that is run again after a failure harmless.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def handle(batch: DataFrame, number: int) -> None:
        try:
            done = batch.sparkSession.read.parquet(target)
        except Exception as error:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            done = batch.select(key).limit(0)
        work(not_done(batch, done, key)).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start()

