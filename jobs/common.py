"""What the jobs share: the command line, their small JSON configuration, and counted, logged reads and writes."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("prismflow.jobs")


def configured(spark: SparkSession, path: str, known: dict) -> dict:
    """The defaults ``known`` with the values of a JSON file, read by Spark as paths may be remote. An unknown name is an error."""
    given = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return known | given


def write(rows: DataFrame, path: str, *by: str, how: Callable[[DataFrameWriter], DataFrameWriter] = lambda w: w.mode("overwrite")) -> int:
    """Write ``rows`` as Parquet, partitioned by ``by``; returns and logs their number, counted while they are written."""
    seen = Observation()
    writer = how(rows.observe(seen, F.count(F.lit(1)).alias("rows")).write)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    n = int(seen.get["rows"])
    log.info("wrote %d rows to %s%s", n, path, f" by {', '.join(by)}" if by else "")
    return n


def existing(spark: SparkSession, path: str, schema: str, *by: str) -> DataFrame:
    """The table at ``path``, which is made, empty, if there is none."""
    empty = spark.createDataFrame([], schema).write.mode("append")
    (empty.partitionBy(*by) if by else empty).parquet(path)
    return spark.read.schema(schema).parquet(path)


def main(run: Callable[..., object], about: str, inputs: list[str], known: dict) -> None:
    """Command line of a job: plain paths, and a configuration file."""
    options = argparse.ArgumentParser(description=about)
    for name in (*inputs, "output"):
        options.add_argument(f"--{name}", required=True, help=f"path of {name}, anything that Spark can read")
    options.add_argument("--config", help=f"JSON file with any of: {', '.join(known)}")
    given = options.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about.split(":")[0]).getOrCreate()
    try:
        config = configured(spark, given.config, known) if given.config else dict(known)
        run(spark, *(getattr(given, name) for name in inputs), given.output, config)
    finally:
        spark.stop()
