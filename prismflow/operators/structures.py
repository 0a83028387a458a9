"""Tables of crystal structures: filters, and the text form in which they are written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.functions import chemistry, lattices
from prismflow.functions import peaks as P
from prismflow.operators import split

PRIMITIVE = "lengths array<double>, angles array<double>, volume double, multiplicity int, sites array<struct<element:string,x:double,y:double,z:double,occupancy:double>>, problem string"


def ordered_only(rows: DataFrame, enforce: bool = True) -> DataFrame:
    """Structures without partly filled sites; all of them unless ``enforce`` is set."""
    return rows.where("ordered") if enforce else rows


def compounds_only(rows: DataFrame, elements: Column, include_elements: bool = False) -> DataFrame:
    """Structures of two elements or more; all of them with ``include_elements``."""
    return rows if include_elements else rows.where(F.size(elements) > 1)


def primitive_cells(rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(name, prim_lengths, prim_angles, prim_volume, multiplicity, prim_sites, prim_problem) of structures as ``read_cifs`` gives them.

    Listed sites are carried over the cell by the file's symmetry operations; translations that carry every site to one of its kind (element and
    occupancy) within ``tolerance`` show a centred or repeated cell; the lattice they span is reduced to its shortest vectors. ``multiplicity`` is how many
    primitive cells fill the given one. Structures that have a problem, or no sites or possible cell, get null columns and say why.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, lengths, angles, sites, operations in part.itertuples(index=False):
                row = {"name": name, "problem": None, "lengths": None, "angles": None, "volume": None, "multiplicity": None, "sites": None}
                try:
                    if sites is None or not len(sites):
                        raise ValueError("no sites")
                    kinds = [(s["element"], round(s["occupancy"], 6)) for s in sites]
                    places = np.array([[s[c] for c in "xyz"] for s in sites], float)
                    found = lattices.primitive(list(lengths), list(angles), kinds, places, list(operations) if operations is not None else [], tolerance)
                    row |= {k: found[k] for k in ("lengths", "angles", "volume", "multiplicity")}
                    row["sites"] = [{"element": e, "x": x, "y": y, "z": z, "occupancy": o} for (e, o), (x, y, z) in zip(found["kinds"], found["places"].tolist(), strict=True)]
                except (ValueError, TypeError, np.linalg.LinAlgError) as error:
                    row["problem"] = str(error)
                out.append(row)
            frame = pd.DataFrame(out, columns=["name", "lengths", "angles", "volume", "multiplicity", "sites", "problem"])
            yield frame.astype({"multiplicity": "Int32"})

    found = rows.select("name", "lengths", "angles", "sites", "operations").mapInPandas(work, f"name string, {PRIMITIVE}")
    return found.select("name", *(F.col(c).alias(c if c == "multiplicity" else f"prim_{c}") for c in ("lengths", "angles", "volume", "multiplicity", "sites", "problem")))


def strained(rows: DataFrame, seed: str, times: int = 1, most: float = 0.04) -> DataFrame:
    """``times`` strained copies of every structure with a known space group: its columns with new ``lengths`` and ``angles``, and ``copy`` from 0.

    An ordered structure changes those lattice parameters that its crystal system leaves free, so the symmetry stays; in a disordered one the tensor of its
    symmetry class acts on the lattice vectors. Every entry is one of 1000 steps from -``most`` to ``most``, fixed by seed, name and copy. Fractional
    coordinates stay, so atoms move with the cell.
    """
    step = lambda entry: (2 * P.pick(f"{seed}-{entry}", F.col("name"), F.col("copy"), n=1000) / 999.0 - 1) * most
    copies = rows.where("sg between 1 and 230").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    kept = P.strained_cell(chemistry.crystal_system(F.col("sg")), F.col("lengths"), F.col("angles"), F.array(*(step(k) for k in range(6))))
    tensor = P.strain_tensor(chemistry.strain_class(F.col("sg")), {f"s{i}{j}": step(f"s{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)})
    turned = P.cell_of(P.strained_lattice(P.cell_matrix(F.col("lengths"), F.col("angles")), tensor))
    moved = copies.withColumn("_cell", F.when(F.col("ordered"), kept).otherwise(turned))
    return moved.select(*(F.col(f"_cell.{c}").alias(c) if c in ("lengths", "angles") else c for c in rows.columns), "copy")


def unique_structures(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The last structure of every (formula, space group), and the groups with more than one: (formula, sg, n, members)."""
    known = rows.where("formula is not null and sg is not null")
    return split.dedup_last(known, ["formula", "sg"], order), split.duplicate_groups(known, ["formula", "sg"], "name")


def cif_text(row: dict[str, Column]) -> Column:
    """The text of a structure: name, formula, sg, lengths, angles and sites (element, x, y, z, occupancy)."""
    number = lambda x: F.format_string("%.6f", x)
    cell = [(f"_cell_length_{a}", F.element_at(row["lengths"], i)) for i, a in enumerate("abc", 1)]
    cell += [(f"_cell_angle_{a}", F.element_at(row["angles"], i)) for i, a in enumerate(("alpha", "beta", "gamma"), 1)]
    head = [F.concat(F.lit("data_"), row["formula"])] + [F.concat(F.lit(f"{k} "), number(v)) for k, v in cell]
    head += [F.concat(F.lit("_space_group_IT_number "), row["sg"].cast("string")), F.concat(F.lit("_chemical_formula_sum '"), row["formula"], F.lit("'"))]
    loop = [F.lit(x) for x in ("loop_", " _atom_site_type_symbol", " _atom_site_fract_x", " _atom_site_fract_y", " _atom_site_fract_z", " _atom_site_occupancy")]
    sites = F.transform(row["sites"], lambda s: F.concat_ws(" ", F.lit(""), s["element"], *(number(s[c]) for c in ("x", "y", "z", "occupancy"))))
    return F.concat(F.concat_ws("\n", *head, *loop), F.lit("\n"), F.array_join(sites, "\n"), F.lit("\n"))


def write_cifs(rows: DataFrame, path: str, include_elements: bool = False) -> None:
    """One text per (formula, space group) below ``path``, in a folder named formula_sg.cif; structures without a space group are
    dropped, an empty result is an error."""
    elements = F.array_distinct(F.transform("sites", lambda s: s["element"]))
    kept = compounds_only(rows.where("formula is not null and sg is not null"), elements, include_elements)
    if not kept.limit(1).count():
        raise ValueError("no structure is left to write")
    columns = {c: F.col(c) for c in ("formula", "sg", "lengths", "angles", "sites")}
    name = F.concat(F.col("formula"), F.lit("_"), F.col("sg").cast("string"), F.lit(".cif"))
    kept.select(cif_text(columns).alias("value"), name.alias("file")).write.mode("overwrite").partitionBy("file").text(path)
