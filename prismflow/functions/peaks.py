"""Column functions over diffraction peaks.

Fixed values: the grid has 4501 points from 10 to 80 degrees (step 70/4500), kernel widths are scaled by 70/4501
cells, and a kernel ends after four standard deviations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH, POINTS = 10.0, 80.0, 4501
STEP, CELL = (HIGH - LOW) / (POINTS - 1), (HIGH - LOW) / POINTS
TRUNCATE, WAVELENGTH, SHAPE = 4.0, 0.154184, 0.9


def grid_cell(angle: Column) -> Column:
    """Nearest grid cell; halves go down, angles off the range to the edge cell."""
    return F.least(F.lit(POINTS - 1), F.greatest(F.lit(0), F.ceil((angle - LOW) / STEP - 0.5))).cast("int")


def grid_angle(angle: Column) -> Column:
    """The angle of the nearest grid cell, at which widths are taken."""
    return LOW + grid_cell(angle) * STEP


def peak_width(angle: Column, domain: Column, inside_root: bool = False) -> Column:
    """Standard deviation in degrees of a peak of a domain size in nm; ``inside_root`` is the form of the strain and texture effects."""
    half = 0.5 * F.degrees(SHAPE * WAVELENGTH / (F.cos(F.radians(angle / 2)) * domain))
    factor = 1 / (2 * math.log(2))
    return F.sqrt(factor * half) if inside_root else math.sqrt(factor) * half


def texture_factor(hkl: Column, direction: Column, max_texture: float) -> Column:
    """|cos| of the angle between a reflection and the preferred direction, mapped to [1 - max_texture, 1]."""

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))

    inner = F.aggregate(F.zip_with(hkl, direction, lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return (1 - max_texture) + max_texture * F.abs(F.try_divide(inner, norm(hkl) * norm(direction)))


def preferred_direction(seed: str, *keys: Column, size: Column) -> Column:
    """A non-zero vector of zeros and ones of a given size (4 for indices of hexagonal cells), fixed by seed and keys."""
    bits = pick(seed, *keys, n=1 << 32) % (F.pow(F.lit(2.0), size).cast("long") - 1) + 1
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: (F.floor(bits / F.pow(F.lit(2.0), i)) % 2).cast("int"))


def four_indices(hkl: Column) -> Column:
    """(h, k, i, l) of (h, k, l) with i = -h - k."""
    h, k, at_l = (F.element_at(hkl, i) for i in (1, 2, 3))
    return F.array(h, k, -h - k, at_l)


def cell_matrix(lengths: Column, angles: Column) -> Column:
    """Rows of a cell's vectors from its lengths and angles in degrees: c along z, a in the x-z plane."""
    a, b, c = (F.element_at(lengths, i).cast("double") for i in (1, 2, 3))
    alpha, beta, gamma = (F.radians(F.element_at(angles, i).cast("double")) for i in (1, 2, 3))
    turned = (F.cos(alpha) * F.cos(beta) - F.cos(gamma)) / (F.sin(alpha) * F.sin(beta))
    turned = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), turned)))
    zero = F.lit(0.0)
    return F.array(
        F.array(a * F.sin(beta), zero, a * F.cos(beta)),
        F.array(-b * F.sin(alpha) * F.cos(turned), b * F.sin(alpha) * F.sin(turned), b * F.cos(alpha)),
        F.array(zero, zero, c),
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: nested formulas would otherwise multiply in the plan."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bragg_angle(hkl: Column, lattice: Column) -> Column:
    """Scattering angle (two theta, degrees) of a reflection (three or four indices) of a cell in angstrom; null if there is none."""
    h, k, at_l = F.element_at(hkl, 1), F.element_at(hkl, 2), F.element_at(hkl, -1)

    def faces(m: Column) -> Column:
        at = lambda i, j: F.element_at(F.element_at(m, i), j)
        cross = lambda i, j: [at(i, 2) * at(j, 3) - at(i, 3) * at(j, 2), at(i, 3) * at(j, 1) - at(i, 1) * at(j, 3), at(i, 1) * at(j, 2) - at(i, 2) * at(j, 1)]
        bc, ca, ab = cross(2, 3), cross(3, 1), cross(1, 2)
        across = F.array(*(h * x + k * y + at_l * z for x, y, z in zip(bc, ca, ab, strict=True)))
        return F.struct(across.alias("across"), (at(1, 1) * bc[0] + at(1, 2) * bc[1] + at(1, 3) * bc[2]).alias("volume"))

    length = lambda f: F.sqrt(F.aggregate(f["across"], F.lit(0.0), lambda total, x: total + (x / f["volume"]) * (x / f["volume"])))
    sine = 10 * WAVELENGTH / 2 * bound(bound(lattice, faces), length)
    return bound(sine, lambda s: F.when(s <= 1, 2 * F.degrees(F.asin(F.least(s, F.lit(1.0))))))


def strained_cell(system: Column, lengths: Column, angles: Column, strains: Column) -> Column:
    """struct(lengths, angles) after relative changes (six numbers: a, b, c, alpha, beta, gamma) of those lattice parameters that
    the crystal system leaves free; the others follow, so the symmetry stays."""
    of = lambda i: 1 + F.element_at(strains, i)
    uniaxial = system.isin("tetragonal", "hexagonal", "trigonal")
    b = F.when((system == "cubic") | uniaxial, of(1)).otherwise(of(2))
    c = F.when(system == "cubic", of(1)).otherwise(of(3))
    free = [F.when(system == "triclinic", of(4)).otherwise(1.0), F.when(system.isin("triclinic", "monoclinic"), of(5)).otherwise(1.0), F.when(system == "triclinic", of(6)).otherwise(1.0)]
    return F.struct(F.array(*(F.element_at(lengths, i + 1) * x for i, x in enumerate((of(1), b, c)))).alias("lengths"), F.array(*(F.element_at(angles, i + 1) * x for i, x in enumerate(free))).alias("angles"))


def strain_tensor(symmetry: Column, s: dict[str, Column]) -> Column:
    """3 x 3 strain by symmetry class from entries s11, s12, ... (columns)."""
    zero = F.lit(0.0)

    def tensor(*rows: tuple) -> Column:
        return F.array(*(F.array(*r) for r in rows))

    return (
        F.when(symmetry == "cubic", tensor((s["s11"], zero, zero), (zero, s["s11"], zero), (zero, zero, s["s11"])))
        .when(symmetry == "high-sym hexagonal/tetragonal", tensor((s["s11"], zero, zero), (zero, s["s11"], zero), (zero, zero, s["s33"])))
        .when(symmetry == "low-sym hexagonal/tetragonal", tensor((s["s11"], s["s12"], zero), (-s["s12"], s["s22"], zero), (zero, zero, s["s33"])))
        .when(symmetry == "orthorhombic", tensor((s["s11"], zero, zero), (zero, s["s22"], zero), (zero, zero, s["s33"])))
        .when(symmetry == "monoclinic", tensor((s["s11"], zero, zero), (zero, s["s22"], s["s23"]), (zero, s["s23"], s["s33"])))
        .when(symmetry == "triclinic", tensor((s["s11"], s["s12"], s["s13"]), (s["s21"], s["s22"], s["s23"]), (s["s31"], s["s32"], s["s33"])))
    )


def strained_lattice(lattice: Column, tensor: Column) -> Column:
    """lattice x (identity + tensor)."""

    def product(both: Column) -> Column:
        at = lambda m, i, j: F.element_at(F.element_at(both[m], i), j)

        def cell(i: int, j: int) -> Column:
            terms = [at("lattice", i, k) * (at("tensor", k, j) + float(j == k)) for k in (1, 2, 3)]
            return terms[0] + terms[1] + terms[2]

        return F.array(*(F.array(*(cell(i, j) for j in (1, 2, 3))) for i in (1, 2, 3)))

    return bound(F.struct(lattice.alias("lattice"), tensor.alias("tensor")), product)


def cell_of(lattice: Column) -> Column:
    """struct(lengths, angles) of three lattice vectors, given as rows."""

    def measured(m: Column) -> Column:
        at = lambda i, j: F.element_at(F.element_at(m, i), j)
        dot = lambda i, j: at(i, 1) * at(j, 1) + at(i, 2) * at(j, 2) + at(i, 3) * at(j, 3)
        length = [F.sqrt(dot(i, i)) for i in (1, 2, 3)]
        between = lambda i, j: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(i, j) / (length[i - 1] * length[j - 1])))))
        return F.struct(F.array(*length).alias("lengths"), F.array(between(2, 3), between(1, 3), between(1, 2)).alias("angles"))

    return bound(lattice, measured)


def impurity_mixed(clean: Column, impurity: Column, magnitude: Column) -> Column:
    """clean + magnitude * impurity / max(impurity), scaled to a maximum of 100."""
    mixed = F.zip_with(clean, impurity, lambda a, b: a + magnitude * F.try_divide(b, F.array_max(impurity)))
    return F.transform(mixed, lambda x: F.try_divide(100.0 * x, F.array_max(mixed)))


def pick(seed: str, *keys: Column, n: int) -> Column:
    """A number from 0 to n - 1 fixed by seed and keys: the same in any engine with MD5."""
    text = F.md5(F.concat_ws("-", F.lit(seed), *(k.cast("string") for k in keys)).cast("binary"))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % n


def gauss(seed: str, *keys: Column) -> Column:
    """A normal number fixed by seed and keys (Box and Muller's form over two parts of an MD5)."""
    text = F.md5(F.concat_ws("-", F.lit(seed), *(k.cast("string") for k in keys)).cast("binary"))
    one, two = ((F.conv(F.substring(text, at, 8), 16, 10).cast("double") + 0.5) / 2.0**32 for at in (1, 9))
    return F.sqrt(-2 * F.ln(one)) * F.cos(2 * math.pi * two)
