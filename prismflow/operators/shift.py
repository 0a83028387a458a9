"""Shift between a source and a target domain, class by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.operators.distances import empirical_w1

EPS = 1e-8


def long_form(rows: DataFrame, id_col: str, vector_col: str, *keep: str) -> DataFrame:
    """(id, keep..., pos, x)."""
    return rows.select(F.col(id_col).alias("id"), *keep, F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "x"))


def standardized(long: DataFrame) -> DataFrame:
    """``x`` minus the column's mean over its population deviation plus 1e-8; statistics are aggregated before they are joined."""
    stats = long.groupBy("pos").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return long.join(F.broadcast(stats), "pos").withColumn("x", (F.col("x") - F.col("_m")) / (F.col("_s") + EPS)).drop("_m", "_s")


def class_radius(long: DataFrame) -> DataFrame:
    """(label, domain, n, radius): mean distance of rows to their group's centroid."""
    centre = long.groupBy("label", "domain", "pos").agg(F.avg("x").alias("c"))
    each = long.join(centre, ["label", "domain", "pos"]).groupBy("label", "domain", "id").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("r"))
    return each.groupBy("label", "domain").agg(F.count("*").alias("n"), F.avg("r").alias("radius"))


def shift_scores(long: DataFrame) -> DataFrame:
    """Per class in both domains: feature_shift (norm of the per-dimension distances), radii, and the score."""
    per_dim = empirical_w1(long.select("label", "pos", "domain", "x"), ["label", "pos"], "domain", "x")
    moved = per_dim.groupBy("label").agg(F.sqrt(F.sum(F.col("w1") ** 2)).alias("feature_shift"))
    radii = class_radius(long)
    source = radii.where("domain = 0").select("label", F.col("n").alias("n_source"), F.col("radius").alias("r_source"))
    target = radii.where("domain = 1").select("label", F.col("n").alias("n_target"), F.col("radius").alias("r_target"))
    score = F.col("feature_shift") / (F.col("feature_shift") + 0.5 * (F.col("r_source") + F.col("r_target")) + EPS)
    return moved.join(source, "label").join(target, "label").withColumn("shift_score", score)


def worst_shifts(scores: DataFrame, k: int) -> DataFrame:
    """The k classes with the largest score; a limit that is the feature."""
    return scores.orderBy(F.col("shift_score").desc(), "label").limit(k)

