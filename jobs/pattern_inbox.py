"""Pattern inbox: patterns are identified once, as the files that hold them arrive.

    python -m jobs.pattern_inbox --reference PATH --incoming PATH --output PATH [--config jobs/pattern_inbox.json]

``reference`` holds known patterns (vec_id, embedding, label); ``incoming`` is a Parquet folder to which files are added, with the same columns
(a label may be null). Below the output path:

* ``model``: the mean pattern of each class, fitted on the reference by the first run and frozen, so that results of different runs compare;
* ``predictions``, partitioned by batch and decision: each pattern's most probable classes, their probabilities, whether the first is right (where the
  label is known), and the decision: ``accept`` if the first is ahead of the second by ``margin``, else ``review``: these are the patterns that are
  worth a label;
* ``problems``, partitioned by batch: patterns that cannot be judged: without id, without values, with values that are no numbers, of another length than the model;
* ``report``: per batch and over all, how many were judged, accepted and right, and the mean probability. A batch that falls off has shifted.

Incremental: a file stream with a checkpoint (``checkpoint`` below the output) takes only files that no earlier run took. Each micro-batch replaces its
own partitions, so one that is run again after a failure leaves what it would have left; a pattern whose id was judged in an earlier batch is not judged again, of
equal ids within a batch the smallest row is. A run over nothing new changes nothing.

Scale: a pattern is scored within its row against a model of classes times dimensions (the size is checked before it is handed to the
tasks); the only shuffles are by id, to judge each once: of earlier batches only the ids are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from jobs.common import log
from prismflow.operators import evaluate, split

#: Defaults; see pattern_inbox.json. ``files`` limits the files of a micro-batch, 0 takes all.
CONFIG = {"top": 3, "margin": 0.01, "files": 0}
#: Numbers of a model that may be handed to every task (64 MB).
MOST = 1 << 23
MODEL = "centroids array<struct<class: int, c: array<double>>>"
BY = ("batch", "decision")


def predictions_schema(top: int) -> str:
    pairs = ", ".join(f"top{r}_class int, top{r}_p double" for r in range(1, top + 1))
    return f"vec_id long, label int, {pairs}, correct boolean, batch long, decision string"


PROBLEMS = "vec_id long, problem string, batch long"


def _values(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label"))


def _finite() -> F.Column:
    return F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def frozen_model(spark: SparkSession, reference: str, path: str) -> DataFrame:
    """The model at ``path``, fitted on the reference if there is none yet."""
    model = common.existing(spark, path, MODEL)
    if not model.limit(1).count():
        known = _values(spark.read.parquet(reference)).where(F.col("label").isNotNull() & _finite() & (F.size("v") > 0))
        fitted = evaluate.centroids(known, "v", "label").select(F.col("centroids").cast(MODEL.split(" ", 1)[1]))
        common.write(fitted, path)
        model = spark.read.schema(MODEL).parquet(path)
        log.info("fitted the model on %s", reference)
    sizes = model.select(F.size("centroids").alias("classes"), F.expr("aggregate(centroids, 0, (n, z) -> n + size(z.c))").alias("numbers")).first()
    if sizes is None or not sizes.classes:
        raise ValueError(f"no labelled pattern in {reference}")
    if sizes.numbers > MOST:
        raise ValueError(f"a model of {sizes.numbers} numbers is too large to hand to every task")
    return model


def judged(rows: DataFrame, model: DataFrame, top: int, margin: float) -> tuple[DataFrame, DataFrame]:
    """(predictions, problems) of patterns, each within its own row."""
    each = _values(rows).join(F.broadcast(model))
    problem = F.when(F.col("vec_id").isNull(), "no id").when(F.col("v").isNull() | (F.size("v") == 0), "no values").when(~_finite(), "not a number")
    each = each.withColumn("problem", problem.when(F.size("v") != F.size(F.get("centroids", F.lit(0))["c"]), "another length"))
    fine = each.where("problem is null").withColumn("best", evaluate.best_classes(F.col("v"), F.col("centroids"), top))
    columns = [c for r in range(top) for c in (F.get("best", F.lit(r))["class"].alias(f"top{r + 1}_class"), F.round(F.get("best", F.lit(r))["p"], 6).alias(f"top{r + 1}_p"))]
    ahead = F.round(F.get("best", F.lit(0))["p"] - F.coalesce(F.get("best", F.lit(1))["p"], F.lit(0.0)), 6)
    decision = F.when(ahead >= margin, "accept").otherwise("review")
    predictions = fine.select("vec_id", "label", *columns, (F.col("label") == F.get("best", F.lit(0))["class"]).alias("correct"), decision.alias("decision"))
    return predictions, each.where("problem is not null").select("vec_id", "problem")


def report(predictions: DataFrame) -> DataFrame:
    """(batch, n, accepted, known, right, mean_p), batch null for all."""
    counts = [F.count("*").alias("n"), F.count_if(F.col("decision") == "accept").alias("accepted"), F.count("label").alias("known"), F.count_if("correct").alias("right"), F.round(F.avg("top1_p"), 6).alias("mean_p")]
    return predictions.rollup("batch").agg(*counts)


def as_glob(path: str) -> str:
    """A pattern that only ``path`` matches: so a stream also takes a path that is a single file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, reference: str, incoming: str, output: str, config: dict) -> dict[str, int]:
    """Judge what is new; returns how many patterns this run judged and left as problems."""
    output = output.rstrip("/")
    top = int(config["top"])
    if top < 2 or not math.isfinite(config["margin"]):
        raise ValueError("top must be 2 or more, and margin a number")
    schema = predictions_schema(top)
    model = frozen_model(spark, reference, f"{output}/model")
    common.existing(spark, f"{output}/predictions", schema, *BY)
    common.existing(spark, f"{output}/problems", PROBLEMS, "batch")
    done = {"judged": 0, "problems": 0}

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = session.read.schema(schema).parquet(f"{output}/predictions").where(F.col("batch") < number)
        fresh = batch.where("vec_id is null").unionByName(split.not_done(batch.where("vec_id is not null"), earlier, "vec_id"))
        predictions, problems = judged(fresh, model, top, config["margin"])
        value = F.struct(*(c for c in predictions.columns if c != "vec_id"))
        once = predictions.groupBy("vec_id").agg(F.min(value).alias("r")).select("vec_id", "r.*").withColumn("batch", F.lit(number).cast("long"))
        replace = lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        done["judged"] += common.write(once.hint("rebalance", "decision"), f"{output}/predictions", *BY, how=replace)
        done["problems"] += common.write(problems.withColumn("batch", F.lit(number).cast("long")), f"{output}/problems", "batch", how=replace)

    log.info("reading new files of %s", incoming)
    stream = spark.readStream.schema(spark.read.parquet(incoming).schema)
    stream = stream.option("maxFilesPerTrigger", config["files"]) if config["files"] else stream
    query = stream.parquet(as_glob(incoming)).writeStream.foreachBatch(handle).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    common.write(report(spark.read.schema(schema).parquet(f"{output}/predictions")).coalesce(1), f"{output}/report")
    log.info("judged %d patterns, %d with problems", done["judged"], done["problems"])
    return done


def predictions(spark: SparkSession, output: str, config: dict) -> DataFrame:
    """All predictions of all runs."""
    return spark.read.schema(predictions_schema(int(config["top"]))).parquet(f"{output.rstrip('/')}/predictions")


if __name__ == "__main__":
    common.main(run, "pattern inbox: new patterns identified once", ["reference", "incoming"], CONFIG)
