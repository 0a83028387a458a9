"""Label tables: validation, duplicate policies, joins and element masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.functions import chemistry


def strict_label(raw: Column) -> Column:
    """Integer of a label text, null where the strict reader rejects it: not a number, negative, or too far from a whole number."""
    value = F.trim(raw).try_cast("double")
    whole = F.bround(value, 0)
    near = F.abs(value - whole) <= 1e-8 + 1e-5 * F.abs(whole)
    return F.when(near & (whole >= 0), whole.cast("long"))


def validated(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with ``label`` and a ``problem`` (empty, not numeric, not whole, negative; null if fine)."""
    text, value = F.trim(raw), F.trim(raw).try_cast("double")
    problem = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(value.isNull() | F.isnan(value), "not numeric")
        .when(value < -1e-8, "negative")
        .when(strict_label(F.col(raw)).isNull(), "not whole")
    )
    return rows.withColumn("label", strict_label(F.col(raw))).withColumn("problem", problem)


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the least ``order``."""
    return _edge_per_key(rows, key, F.col(order))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest ``order`` (lenient reader: the last one wins)."""
    return _edge_per_key(rows, key, F.col(order).desc())


def _edge_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_at = 1").drop("_at")


def conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n_labels) of keys with more than one label."""
    return rows.groupBy(key).agg(F.countDistinct(label).alias("n_labels")).where("n_labels > 1")


def joined(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Inner join; see ``unlabelled`` and ``unused`` for what it leaves out."""
    return rows.join(labels, key)


def unlabelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels, key, "left_anti")


def unused(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return labels.join(rows, key, "left_anti")


def dense_ids(rows: DataFrame, name: str) -> DataFrame:
    """(name, position) of the distinct names in code-point order, counted from 0.

    Positions are local to range partitions plus the sizes of the partitions before, so no task sees all names. The
    partitions are written once, as sampling them again could move their bounds.
    """
    ordered = storage.cut(rows.select(name).distinct().repartitionByRange(name).withColumn("_part", F.spark_partition_id()))
    local = ordered.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(name)))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n"), F.min(name).alias("low"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return local.join(before, "_part").select(name, (F.col("_at") + F.col("before") - 1).alias("position"))


def class_gaps(labels: DataFrame, label: str) -> DataFrame:
    """(n_classes, gap): for every id below the number of classes (largest label in use + 1) that nothing uses. Only that number reaches the driver."""
    top = labels.agg(F.max(F.col(label).cast("long"))).first()[0]
    used = labels.select(F.col(label).cast("long").alias("gap")).distinct()
    every = labels.sparkSession.range(0, 0 if top is None else top + 1).toDF("gap")
    return every.join(used, "gap", "left_anti").select(F.lit(0 if top is None else top + 1).cast("long").alias("n_classes"), "gap")


def check_range(rows: DataFrame, label: str, n_classes: int) -> DataFrame:
    """``rows`` if all labels are 0 to ``n_classes`` - 1; otherwise an error that names the range found."""
    low, high, missing = rows.agg(F.min(label), F.max(label), F.count_if(F.col(label).isNull())).first()
    if missing or (low is not None and (low < 0 or high >= n_classes)):
        raise ValueError(f"class labels must be 0 to {n_classes - 1}, got {low} to {high}" + (f" and {missing} nulls" if missing else ""))
    return rows


def hard_mask(classes: DataFrame, allowed: Column) -> DataFrame:
    """The ``classes`` that are ``allowed``; an error if none is."""
    kept = classes.where(allowed)
    if not kept.limit(1).count():
        raise ValueError("the mask leaves no class")
    return kept


def allowed_all(elements: Column, required: list[str], only_allowed: bool = False) -> Column:
    """All required elements present; with ``only_allowed`` no others either. Nothing required allows all."""
    needed = F.array(*map(F.lit, required)).cast("array<string>")
    inside = F.size(F.array_except(needed, elements)) == 0
    exact = inside & (F.size(F.array_except(elements, needed)) == 0)
    return (exact if only_allowed else inside) if required else F.lit(True)


def allowed_any(elements: Column, required: list[str], only_allowed: bool = False) -> Column:
    """Any required element present; with ``only_allowed`` the same set."""
    needed = F.array(*map(F.lit, required)).cast("array<string>")
    return allowed_all(elements, required, True) if only_allowed else F.arrays_overlap(elements, needed)


def mixes_to(states: Column, n: Column, wanted: Column) -> Column:
    """Whether ``n`` atoms, each in one of the ``states``, can add up to ``wanted``.

    Counted from the lowest state, atoms add steps of up to ``top``. Of any ``top`` smaller steps some add up to a multiple of ``top`` and could be
    whole steps instead, so fewer than ``top`` smaller ones are enough to try: the work does not grow with the number of atoms.
    """
    low = F.array_min(states)
    steps = F.array_distinct(F.transform(states, lambda s: (s - low).cast("long")))
    top, rest = F.array_max(steps), (wanted - n * low).cast("long")
    zero = F.array(F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")))

    def more(seen: Column, k: Column) -> Column:
        last = F.filter(seen, lambda x: x["n"] == k - 1)
        sums = F.flatten(F.transform(last, lambda x: F.transform(F.filter(steps, lambda d: (d > 0) & (d < top)), lambda d: x["sum"] + d)))
        fresh = F.array_except(F.array_distinct(sums), F.transform(seen, lambda x: x["sum"]))
        return F.concat(seen, F.transform(fresh, lambda s: F.struct(s.alias("sum"), k.alias("n"))))

    count = F.least(n.cast("int"), (top - 1).cast("int"))
    few = F.when(count >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), zero, more)).otherwise(zero)
    whole = lambda x: (rest >= x["sum"]) & ((rest - x["sum"]) % top == 0) & (x["n"] + (rest - x["sum"]) / top <= n)
    return F.when(top == 0, rest == 0).otherwise(F.exists(few, whole))


def neutral(compounds: DataFrame, states: DataFrame) -> DataFrame:
    """Compounds (id, counts map) with a charge-neutral choice of oxidation states; ``states`` is (element, states array).

    First one element with several states may mix its states over its atoms while the others take their first;
    else every element takes one state, whose sums are built as sets of reachable charges. A compound with an element of unknown states is not neutral.
    A compound is judged in its own row; ``states`` is a table of the elements and goes to all tasks as one map.
    """
    known = F.broadcast(states.where("states is not null").agg(F.map_from_entries(F.collect_list(F.struct("element", "states"))).alias("known")))
    parts = F.transform(F.map_entries("counts"), lambda z: F.struct(z["value"].cast("long").alias("n"), F.element_at("known", z["key"]).alias("states")))
    zero = F.lit(0).cast("long")
    first = lambda z: F.element_at(z["states"], 1) * z["n"]

    def balanced(parts: Column) -> Column:
        mixed = lambda whole: F.exists(parts, lambda z: (F.size(z["states"]) > 1) & mixes_to(z["states"], z["n"], first(z) - whole))
        one = chemistry.once(F.aggregate(parts, zero, lambda s, z: s + first(z)), mixed)
        sums = F.aggregate(parts, F.array(zero), lambda seen, z: F.array_distinct(F.flatten(F.transform(seen, lambda s: F.transform(z["states"], lambda x: s + x * z["n"])))))
        complete = (F.size(parts) > 0) & F.forall(parts, lambda z: z["states"].isNotNull())
        return F.when(complete, F.array_contains(sums, zero) | F.coalesce(one, F.lit(False))).otherwise(False)

    # One condition: several would each have the parts, and the formulas below them, worked out again.
    return compounds.join(known).where(F.coalesce(chemistry.once(parts, balanced), F.lit(False))).select("id").distinct()
