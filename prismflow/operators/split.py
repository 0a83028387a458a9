"""Deduplication, seeded order, sampling and splitting.

Random picks are ranks by the MD5 of seed and key: repeatable, independent of partitioning, equal in other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow import storage


#: Parts that a group's rows are dealt into before the few that are wanted meet.
SALTS = 64


def ticket(seed: int | str, *keys: str | Column) -> Column:
    """Sort key of a seeded random order."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)).cast("binary"))


def ranked(rows: DataFrame, groups: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def dedup_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last written row of each key."""
    return ranked(rows, keys, F.col(order).desc()).where("rank = 1").drop("rank")


def duplicate_groups(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, n, members sorted) of keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members")).where("n > 1")


def split(rows: DataFrame, group: str, order: list, train: int, val: int, test: int) -> DataFrame:
    """The first train + val + test rows of every group in ``order``, with their ``split``. Groups with too few rows are an error."""
    need = train + val + test
    of = ranked(rows, [group], *order).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    short = F.when(F.col("_n") < need, F.raise_error(F.concat(F.lit("too few rows in "), F.col(group).cast("string"))))
    name = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return of.where(F.col("rank") <= need).withColumn("split", F.coalesce(short.cast("string"), name)).drop("_n")


def split_shares(rows: DataFrame, group: str, order: list, train: float, val: float) -> DataFrame:
    """Every row with its ``split``: shares of each group's size, the rest is test."""
    of = ranked(rows, [group], *order).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    name = F.when(F.col("rank") <= F.floor(F.col("_n") * train), "train").when(F.col("rank") <= F.floor(F.col("_n") * (train + val)), "val").otherwise("test")
    return of.withColumn("split", name).drop("_n")


def spread_ranks(rows: DataFrame, group: str, *order) -> DataFrame:
    """``rows`` with ``rank`` from 1 in their group by ``order`` and ``size``, the group's rows, for groups of any size.

    Rows are range-partitioned by group and order, so a large group lies in many partitions. A row's place in its partition
    and the counts of its group in the partitions before make its rank: no task sees a whole group, and only a row per partition
    and group is gathered. The partitions are written once, as sampling them again could move their bounds.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.select("*", *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    keys = [group, *(f"_o{k}" for k in range(len(order)))]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop(*keys[1:])
    placed = storage.cut(placed.withColumn("_part", F.shiftright("_at", 33)))
    sizes = placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    within = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", before.alias("_before"), F.sum("_n").over(within).alias("size"))
    met = placed.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("rank"), "size")


def share_name(rank: Column, size: Column, train: float, val: float) -> Column:
    """The split of a row by its rank in a group of ``size`` rows: shares of the group, the rest is test."""
    return F.when(rank <= F.floor(size * train), "train").when(rank <= F.floor(size * (train + val)), "val").otherwise("test")


def stratified(rows: DataFrame, group: str, k: int, seed: int, key: str) -> DataFrame:
    """min(k, size) rows of every group. A group's rows are thinned out in ``SALTS`` parts first, so one group may hold any share of the rows."""
    few = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(19), key), F.lit(SALTS)))
    for groups in ([group, "_salt"], [group]):
        few = few.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(ticket(seed, key), key))).where(F.col("_place") <= k)
    return few.drop("_salt", "_place")


def acquire_random(pool: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows of the whole pool."""
    return pool.orderBy(ticket(seed, key), key).limit(k)


def window_sample(rows: DataFrame, group: str, order: str, seed: int, size: int = 50, keep: int = 20) -> DataFrame:
    """``keep`` rows of every full block of ``size`` consecutive rows of a group; an incomplete last block gives none."""
    placed = ranked(rows, [group], order).withColumn("block", F.floor((F.col("rank") - 1) / size)).drop("rank")
    full = placed.withColumn("_n", F.count("*").over(Window.partitionBy(group, "block"))).where(F.col("_n") == size).drop("_n")
    return ranked(full, [group, "block"], ticket(seed, order), order).where(F.col("rank") <= keep).drop("rank")


def manifest(rows: DataFrame, group: str, chosen: DataFrame) -> DataFrame:
    """Per group: rows available, selected, and per split."""
    total = rows.groupBy(group).agg(F.count("*").alias("total_available"))
    parts = chosen.groupBy(group).agg(F.count("*").alias("selected_count"), *(F.count_if(F.col("split") == s).alias(f"{s}_count") for s in ("train", "val", "test")))
    return total.join(parts, group, "left").na.fill(0)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return rows.join(done.select(key), key, "left_anti")


def tagged_union(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both domains with ``domain`` 0 and 1."""
    return source.withColumn("domain", F.lit(0)).unionByName(target.withColumn("domain", F.lit(1)))


def first_seen(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, first) of the distinct labels, in the order of their first appearance."""
    return rows.groupBy(label).agg(F.min(order).alias("first")).orderBy("first", label)


def aligned(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Samples with their labels by an explicit key; a sample without a label, a label without a sample or a repeated key is an error."""
    sides = samples.select(key, F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(labels.select(key, F.lit(0).alias("s"), F.lit(1).alias("t")))
    bad = sides.groupBy(key).agg(F.sum("s").alias("s"), F.sum("t").alias("t")).where("s <> 1 or t <> 1").orderBy(key).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].s} samples and {bad[0].t} labels for {bad[0][key]!r}")
    return samples.join(labels, key)
