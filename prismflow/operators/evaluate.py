"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow.functions import vectors as V

#: Fixed value: logit of a class that a mask rules out.
MASKED = -1e9


def centroids(rows: DataFrame, vector_col: str, label_col: str) -> DataFrame:
    """One row with ``centroids``, an array of (class, c): as large as classes times dimensions, whatever the number of rows."""
    long = rows.select(F.col(label_col).alias("class"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "x"))
    means = long.groupBy("class", "pos").agg(F.avg("x").alias("c"))
    vectors = means.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda z: z["c"]).alias("c"))
    return vectors.agg(F.array_sort(F.collect_list(F.struct("class", "c"))).alias("centroids"))


def logits_to(rows: DataFrame, to: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, class, logit): dot products of rows with the centroids of ``to``; rows are not shuffled."""
    each = rows.join(F.broadcast(to)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.explode("centroids").alias("k"))
    return each.select("id", "label", F.col("k.class").alias("class"), V.dot(F.col("v"), F.col("k.c")).alias("logit"))


def centroid_logits(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, class, logit) with centroids of the rows themselves; a stand-in for a network's output layer."""
    return logits_to(rows, centroids(rows, vector_col, label_col), id_col, vector_col, label_col)


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """(id, rank, class, p): softmax over the classes of an id, the k most probable, ties to the lower class."""
    every = Window.partitionBy("id")
    power = F.exp(F.col("logit") - F.max("logit").over(every))
    chances = logits.withColumn("e", power).withColumn("p", F.col("e") / F.sum("e").over(every))
    order = every.orderBy(F.round("p", 12).desc(), "class")
    return chances.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "label", "rank", "class", "p")


def best_classes(vector: Column, centroids: Column, k: int) -> Column:
    """The k most probable classes of one vector, an array of (class, p) with p rounded to 12 digits, ties to the lower class: as ``top_k``,
    within the row and without a shuffle. ``centroids`` is an array of (class, c)."""
    logits = F.transform(centroids, lambda z: V.dot(vector, z["c"]))
    each = F.arrays_zip(F.transform(V.softmax(logits), lambda p: -F.round(p, 12)).alias("minus"), F.transform(centroids, lambda z: z["class"]).alias("class"))
    return F.transform(F.slice(F.array_sort(each), 1, k), lambda z: F.struct(z["class"].alias("class"), (-z["minus"]).alias("p")))


def masked(logits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Logits with ruled-out classes at ``MASKED``; ``allowed`` is (class)."""
    marked = logits.join(F.broadcast(allowed.select("class", F.lit(True).alias("_in"))), "class", "left")
    return marked.withColumn("logit", F.when(F.col("_in"), F.col("logit")).otherwise(MASKED)).drop("_in")


def domain_accuracy(rows: DataFrame) -> DataFrame:
    """One row: share of (label = predicted) for all, domain 0 and domain 1, and the counts."""
    right = F.col("label") == F.col("predicted")

    def of(name: str, inside) -> list:
        n = F.count_if(inside)
        return [(F.count_if(right & inside) / F.greatest(n, F.lit(1))).alias(f"accuracy_{name}"), n.alias(f"count_{name}")]

    return rows.agg(*of("all", F.lit(True)), *of("source", F.col("domain") == 0), *of("target", F.col("domain") == 1))


def class_accuracy(rows: DataFrame) -> DataFrame:
    """Per class of the target domain: correct, count, accuracy; worst first, then fewer, then class."""
    each = rows.where("domain = 1").groupBy("label").agg(F.count_if(F.col("label") == F.col("predicted")).alias("correct"), F.count("*").alias("count"))
    return each.withColumn("accuracy", F.col("correct") / F.col("count")).orderBy("accuracy", "count", "label")


def macro_scores(rows: DataFrame) -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over labels seen on either side; 0 where undefined."""
    cells = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    true = cells.groupBy("label").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n"))).alias("hit"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("s"))
    both = true.join(said, "label", "full").na.fill(0, ["t", "s", "hit"])
    p, r = F.coalesce(F.try_divide("hit", "s"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "t"), F.lit(0.0))
    each = both.withColumn("p", p).withColumn("r", r).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    return each.agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"), F.avg("f").alias("f1_macro"))


def cross_entropy(logits: DataFrame) -> DataFrame:
    """One row, ``loss``: mean over ids of minus the logarithm of the softmax at the label; an id whose label is no class counts as nothing.
    ``logits`` is (id, label, class, logit)."""
    each = logits.groupBy("id").agg(F.max("logit").alias("top"), F.max(F.when(F.col("class") == F.col("label"), F.col("logit"))).alias("own"), F.collect_list("logit").alias("all"))
    power = F.aggregate("all", F.lit(0.0), lambda total, z: total + F.exp(z - F.col("top")))
    return each.select((F.ln(power) + F.col("top") - F.col("own")).alias("l")).agg(F.avg("l").alias("loss"))


def round_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per round: seeds, mean and sample deviation (0 for one seed) of each metric."""
    stats = [s for m in metrics for s in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return runs.groupBy("round").agg(F.countDistinct("seed").alias("n_seeds"), *stats)


def final_rounds(runs: DataFrame) -> DataFrame:
    """The last round of every seed."""
    return runs.withColumn("_at", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("round").desc()))).where("_at = 1").drop("_at")


def metric_statistics(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric: mean and sample deviation (null for one row)."""
    long = runs.unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def learning_stop(history: DataFrame, patience: int, delta: float = 0.001) -> DataFrame:
    """Per seed: the first round at which ``patience`` rounds, counted since the best value last rose by ``delta`` or more, did not; null if none.

    The best value rises only with such a round, so many small steps do not add up to one. A run's rounds are few and are folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("round", F.col("value").cast("double").alias("value"))))
    runs = history.groupBy("seed").agg(ordered.alias("rounds"))
    kind = f"struct<best:double,waited:int,stop:{history.schema['round'].dataType.simpleString()}>"
    state = lambda best, waited, stop: F.struct(best.alias("best"), waited.cast("int").alias("waited"), stop.alias("stop")).cast(kind)

    def step(done: Column, x: Column) -> Column:
        waited = done["waited"] + 1
        better = done["best"].isNull() | (x["value"] >= done["best"] + delta)
        return F.when(better, state(x["value"], F.lit(0), done["stop"])).otherwise(state(done["best"], waited, F.coalesce(done["stop"], F.when(waited >= patience, x["round"]))))

    start = F.lit(None).cast(kind)
    start = state(start["best"], F.lit(0), start["stop"])
    return runs.select("seed", F.aggregate("rounds", start, step)["stop"].alias("stop_round"))
