"""Selection of samples for active learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.operators.distances import badge_distance


#: Groups whose newest centres are handed to every task; more are joined.
FEW_GROUPS = 10_000
#: Steps after which distances are written.
FOLD = 16


def least_distance(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, d): least distance of every row (id, p, h) to the chosen centres (a small table of the same form)."""
    picked = centres.select(F.col("p").alias("pc"), F.col("h").alias("hc"))
    return rows.join(F.broadcast(picked)).groupBy("id").agg(F.min(badge_distance("p", "h", "pc", "hc")).alias("d"))


def _uniform(seed: int | str, step: int) -> Column:
    """A number in (0, 1) fixed by seed, step and id."""
    text = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(step)), F.col("id").cast("string")).cast("binary"))
    return (F.conv(F.substring(text, 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48


def _norm(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)


def badge_select(rows: DataFrame, group: str | None, k: int, seed: int, digits: int = 9) -> DataFrame:
    """(group, rank, id): k rows per group, or of all rows without one, by squared-distance sampling.

    ``rows`` has id, p and h. The first is the row with the largest norm (rounded to ``digits``, ties to the lower id). Each next one is drawn with
    probability proportional to the square of its distance to the nearest one chosen: the row with the least
    -ln(u) / d^2, u fixed by seed, step and id, which is a draw with those odds. If all distances are zero any row left may be drawn.

    Steps follow each other; every step is a distributed aggregate over all groups. Only the chosen rows are kept between steps, and every ``FOLD`` steps
    the distances to them, so the vectors are written anew once in as many steps.
    """
    key = F.lit(0) if group is None else F.col(group)
    rows = rows.select(key.alias("g"), F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p"), F.col("h").cast("array<double>").alias("h"))
    norm = F.round(F.sqrt(_norm("p") * _norm("h")), digits)
    scratch = storage.Scratch()
    base = state = storage.cut(rows.withColumn("d2", F.lit(None).cast("double")).withColumn("taken", F.lit(False)))
    chosen, recent, few = [], [], True
    for step in range(1, k + 1):
        if step == 1:
            order = F.struct((-norm).alias("a"), F.col("id").alias("b"))
        else:
            u = _uniform(seed, step)
            order = F.struct((F.col("d2") == 0).alias("a"), F.when(F.col("d2") > 0, -F.ln(u) / F.col("d2")).otherwise(u).alias("b"), F.col("id").alias("c"))
        pick = scratch.cut(state.where(~F.col("taken")).groupBy("g").agg(F.min_by(F.struct("id", "p", "h"), order).alias("c")))
        chosen.append(pick.select("g", F.lit(step).alias("rank"), F.col("c.id").alias("id")))
        recent.append(pick)
        if step == 1:
            few = pick.count() <= FEW_GROUPS
        centres = recent[0]
        for more in recent[1:]:
            centres = centres.unionByName(more)
        centres = centres.groupBy("g").agg(F.collect_list("c").alias("cs"))
        near = F.transform("cs", lambda c: badge_distance("p", "h", c["p"], c["h"]))
        near = F.array_min(F.transform(near, lambda d: F.round(d * d, digits)))
        taken = F.col("taken") | F.coalesce(F.exists("cs", lambda c: c["id"] == F.col("id")), F.lit(False))
        state = base.join(F.broadcast(centres) if few else centres, "g", "left").select("g", "id", "p", "h", F.coalesce(F.least("d2", near), near, "d2").alias("d2"), taken.alias("taken"))
        if len(recent) == FOLD and step < k:
            last, base = base, storage.cut(state)
            storage.drop(last)
            state, recent = base, []
    found = chosen[0] if chosen else base.limit(0).select("g", F.lit(0).alias("rank"), "id")
    for more in chosen[1:]:
        found = found.unionByName(more)
    found = storage.cut(found)
    storage.drop(base)
    scratch.close()
    return found.drop("g") if group is None else found.withColumnRenamed("g", group)
