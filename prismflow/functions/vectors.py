"""Column functions over ``array<double>`` vectors; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l1_normalized(v: Column) -> Column:
    """Negatives become 0, then the sum becomes 1; a vector without mass becomes uniform."""
    clipped = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    mass = total(clipped)
    return F.when(mass == 0, F.transform(v, lambda x: 1.0 / F.size(v))).otherwise(F.transform(clipped, lambda x: F.try_divide(x, mass)))


def l2_normalized(v: Column, eps: float = 1e-8) -> Column:
    norm = F.sqrt(dot(v, v)) + eps
    return F.transform(v, lambda x: x / norm)


def max_normalized(v: Column, top: float = 100.0) -> Column:
    return F.transform(v, lambda x: F.try_divide(top * x, F.array_max(v)))


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.when(k == label, 1.0).otherwise(0.0))


def arg_max(v: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column) -> Column:
    powers = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(powers, lambda x: x / total(powers))
