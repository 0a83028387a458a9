"""Column functions over formulas and space groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Last space group of each crystal system, in order.
CRYSTAL_SYSTEMS = [(2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic")]


def elements(key: Column) -> Column:
    """Distinct element symbols before the first ``|``, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.split_part(key, F.lit("|"), F.lit(1)), F.lit("([A-Z][a-z]?)"), 1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a ``value`` that is worked out once, however often the expression names it; inside higher-order functions nothing else keeps it from being repeated."""
    return F.element_at(F.transform(F.array(value), use), 1)


def formula_counts(formula: Column) -> Column:
    """map<element, count> of a formula with parentheses of any depth; an element that occurs more than once is summed.
    Anything but symbols, whole numbers and closed parentheses is an error."""
    tokens = F.reverse(F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?\d*|\(|\)\d*)"), 1))
    number = lambda t: F.coalesce(F.regexp_extract(t, r"(\d+)$", 1).try_cast("bigint"), F.lit(1).cast("bigint"))
    start = F.from_json(F.lit('{"stack":[1],"parts":[]}'), "struct<stack:array<bigint>,parts:array<struct<symbol:string,number:bigint>>>")

    # Read from the end: a closing parenthesis multiplies all up to its opening one.
    def step(done: Column, token: Column) -> Column:
        stack, times = done["stack"], F.element_at(done["stack"], -1)
        opened = F.struct(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))).alias("stack"), done["parts"].alias("parts"))
        closed = F.struct(F.concat(stack, F.array(times * number(token))).alias("stack"), done["parts"].alias("parts"))
        part = F.struct(F.regexp_extract(token, "^([A-Za-z]+)", 1).alias("symbol"), (times * number(token)).alias("number"))
        atom = F.struct(stack.alias("stack"), F.concat(done["parts"], F.array(part)).alias("parts"))
        return F.when(F.size(stack) == 0, done).when(token == "(", opened).when(token.startswith(")"), closed).otherwise(atom)

    def summed(parts: Column) -> Column:
        symbols = F.array_distinct(F.transform(parts, lambda z: z["symbol"]))
        count = lambda s: F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, z: total + F.when(z["symbol"] == s, z["number"]).otherwise(0)).cast("int")
        return once(symbols, lambda names: F.map_from_arrays(names, F.transform(names, count)))

    def checked(found: Column) -> Column:
        whole = (F.array_join(F.reverse(found["tokens"]), "") == formula) & (F.size(found["read"]["stack"]) == 1)
        return F.reverse(F.when(whole, found["read"]["parts"]).otherwise(F.raise_error(F.concat(F.lit("no formula: "), formula)).cast("array<struct<symbol:string,number:bigint>>")))

    read = lambda tokens: F.struct(tokens.alias("tokens"), F.aggregate(tokens, start, step).alias("read"))
    return once(tokens, lambda t: once(read(t), lambda found: once(checked(found), summed)))


def gcd_of(numbers: Column) -> Column:
    """Greatest common divisor of an array of positive integers, by Euclid's steps: no more than one and a half for each binary digit of the smaller number, and two."""
    pair = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    divide = lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], F.try_mod(s["a"], s["b"])))
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda done, n: F.aggregate(F.sequence(F.lit(1), 2 + (1.5 * F.log2(F.greatest(done, F.lit(1)) + 1)).cast("int")), pair(n, done), divide)["a"])


def rounded_counts(counts: Column, several: Column) -> Column:
    """Where some element has ``several`` oxidation states: large counts rounded by magnitude (half to even), then divided
    by their common divisor. Other formulas stay as they are."""
    step = F.transform_values(counts, lambda k, v: F.when(v > 100000, F.bround(v, -3)).when(v > 10000, F.bround(v, -2)).when(v > 1000, F.bround(v, -1)).otherwise(v).cast("int"))
    divided = once(step, lambda found: once(gcd_of(F.map_values(found)), lambda divisor: F.transform_values(found, lambda k, v: (v / divisor).cast("int"))))
    return F.when(several, divided).otherwise(counts)


def has_several_states(counts: Column, several: list[str]) -> Column:
    """Whether an element of the formula is among those with more than one oxidation state."""
    return F.arrays_overlap(F.map_keys(counts), F.array(*map(F.lit, several)).cast("array<string>"))


def crystal_system(group: Column) -> Column:
    """Crystal system of a space group number; numbers outside 1 to 230 are an error."""
    out = F.raise_error(F.concat(F.lit("no space group: "), group.cast("string"))).cast("string")
    for last, name in reversed(CRYSTAL_SYSTEMS):
        out = F.when(group <= last, name).otherwise(out)
    return F.when(group >= 1, out).otherwise(F.raise_error(F.concat(F.lit("no space group: "), group.cast("string"))).cast("string"))


def strain_class(group: Column) -> Column:
    """Symmetry class for strain; its bins differ from the crystal systems (75 counts as orthorhombic)."""
    low = group.between(76, 82) | group.between(143, 148) | group.between(168, 174)
    return (
        F.when(group.between(195, 230), "cubic")
        .when(group.between(16, 75), "orthorhombic")
        .when(group.between(3, 15), "monoclinic")
        .when(group.between(1, 2), "triclinic")
        .when(low, "low-sym hexagonal/tetragonal")
        .when(group.between(76, 194), "high-sym hexagonal/tetragonal")
    )


def suffix_group(name: Column) -> Column:
    """Space group at the end of a name (``_123``); null if there is none."""
    return F.regexp_extract(name, r"_(\d{1,3})$", 1).try_cast("int")
