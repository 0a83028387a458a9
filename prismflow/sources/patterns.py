"""Readers of pattern files and label tables.

Files are read by Spark (``binaryFile``, ``csv``), so any store that Spark reads will do; arrays are decoded on executors.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions import chemistry
from prismflow.operators import labels, split

PATTERN_SCHEMA = "compound string, sample_idx int, spectrum array<double>"


def discovered(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(name, path) of the regular files of ``folder`` that end in ``suffix``, by name; see ``check_names``."""
    if not suffix:
        raise ValueError("the suffix is empty")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    file = F.element_at(F.split("path", "/"), -1)
    found = files.where(file.endswith(suffix)).select(F.expr("url_decode(element_at(split(path, '/'), -1))").alias("file"), "path")
    return found.select(F.expr(f"left(file, length(file) - {len(suffix)})").alias("name"), "path").orderBy("name")


def check_names(files: DataFrame) -> DataFrame:
    """``files`` if there are any and every name is non-empty and unique; otherwise an error that names the first offender."""
    if not files.limit(1).count():
        raise ValueError("no file matches")
    bad = files.groupBy("name").agg(F.count("*").alias("n")).where("n > 1 or name = ''").orderBy("name").limit(1).collect()
    if bad:
        raise ValueError(f"empty or repeated name: {bad[0].name!r}")
    return files


def read_arrays(spark: SparkSession, folder: str, suffix: str = "_aug.npy", length: int | None = None) -> DataFrame:
    """Patterns of all array files: shape (n, length, 1), (length, 1) or (length,); pickled or misshapen files are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["file"], part["content"], strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.size == 0 or array.ndim not in (1, 2, 3) or (array.ndim > 1 and array.shape[-1] != 1):
                    raise ValueError(f"{file}: unexpected shape {array.shape}")
                rows = array.reshape(-1, array.shape[-2] if array.ndim > 1 else array.shape[0]).astype(float)
                if length is not None and rows.shape[1] != length:
                    raise ValueError(f"{file}: {rows.shape[1]} values instead of {length}")
                yield pd.DataFrame({"compound": file.removesuffix(suffix), "sample_idx": np.arange(len(rows)), "spectrum": list(rows)})

    return files.mapInPandas(decode, PATTERN_SCHEMA)


def _clean(rows: DataFrame) -> DataFrame:
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def strict_labels(spark: SparkSession, path: str, name_col: str, label_col: str) -> DataFrame:
    """(compound, label), one row per compound. Missing columns, bad labels and conflicting labels are errors."""
    rows = _clean(spark.read.csv(path, header=True, encoding="UTF-8"))
    for c in (name_col, label_col):
        if c not in rows.columns:
            raise ValueError(f"no column {c!r}")
    checked = labels.validated(rows.select(F.trim(name_col).alias("compound"), F.col(label_col).alias("raw")), "raw")
    bad = checked.where("problem is not null or compound is null or compound = ''").limit(1).collect()
    if bad:
        raise ValueError(f"bad row: {bad[0].compound!r}, {bad[0].raw!r} ({bad[0].problem or 'empty name'})")
    clash = labels.conflicts(checked, "compound", "label").orderBy("compound").limit(1).collect()
    if clash:
        raise ValueError(f"several labels for {clash[0].compound!r}")
    return checked.groupBy("compound").agg(F.min("label").alias("label"))


def inferred_columns(columns: list[str]) -> tuple[str, str]:
    """(label column, compound column): by the words in their names, else the first two."""
    lower = [c.lower() for c in columns]
    label = next((c for c, x in zip(columns, lower, strict=True) if "label" in x or "index" in x or x == "id"), columns[0])
    name = next((c for c, x in zip(columns, lower, strict=True) if any(w in x for w in ("compound", "chem", "name"))), columns[1])
    return label, name


#: Bytes of a label table that the driver decodes itself.
LABEL_BYTES = 64 << 20


def _decoded_csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """A label table in an encoding that Spark's reader does not know; one beyond ``LABEL_BYTES`` is an error."""
    file = spark.read.format("binaryFile").load(path)
    if file.where(F.col("length") > LABEL_BYTES).limit(1).count():
        raise ValueError(f"{path} is too large for a label table in {encoding}")
    table = pd.concat([pd.read_csv(io.BytesIO(r.content), encoding=encoding, dtype=str) for r in file.select("content").collect()])
    schema = ", ".join(f"`{c}` string" for c in table.columns)
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in row) for row in table.itertuples(index=False)], schema)


def lenient_labels(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(label, compound): rows whose label is no number are skipped, the last row of a label wins; none left is an error.

    Without an ``encoding`` the file is read as UTF-8, and again as GBK if it holds bytes that are not UTF-8.
    """
    rows = _clean(spark.read.csv(path, header=True, encoding=encoding or "UTF-8"))
    if encoding is None:
        broken = F.lit(any("\ufffd" in c for c in rows.columns))
        for c in rows.columns:
            broken = broken | F.coalesce(F.col(f"`{c}`").contains("\ufffd"), F.lit(False))
        if rows.where(broken).limit(1).count() or any("\ufffd" in c for c in rows.columns):
            rows = _clean(_decoded_csv(spark, path, "gbk"))
    if len(rows.columns) < 2:
        raise ValueError("a label table needs two columns")
    label, name = inferred_columns(rows.columns)
    found = last_named(rows.withColumn("_row", F.monotonically_increasing_id()), F.col(f"`{label}`"), F.col(f"`{name}`"))
    if not found.limit(1).count():
        raise ValueError("no row has a label")
    return found


def last_named(rows: DataFrame, label: Column, name: Column) -> DataFrame:
    number = label.try_cast("double").cast("long")
    kept = rows.select(number.alias("label"), F.trim(name).alias("compound"), "_row").where("label is not null")
    return kept.groupBy("label").agg(F.max_by("compound", "_row").alias("compound"))


def check_index(names: DataFrame) -> DataFrame:
    """``names`` (matrix_index, name) if the indexes are 0 to n - 1 and the names unique; otherwise an error."""
    seen = names.agg(F.count("*").alias("n"), F.countDistinct("matrix_index").alias("i"), F.min("matrix_index").alias("low"), F.max("matrix_index").alias("high"), F.countDistinct("name").alias("names")).first()
    if not (seen.n == seen.i == seen.names and (seen.n == 0 or (seen.low == 0 and seen.high == seen.n - 1))):
        raise ValueError("the name index does not match the matrix")
    return names


def domain_scan(spark: SparkSession, folder: str, label_table: DataFrame, length: int | None = None, subsample: int | None = None) -> tuple[DataFrame, int]:
    """Labelled patterns (compound, sample_idx, spectrum as floats, label) of one domain, and how many files had no label and were skipped.

    Files are matched by name before their arrays are read. With a seed in ``subsample`` 20 of every full 50 patterns of a
    compound are taken. Nothing left is an error.
    """
    files = discovered(spark, folder, "_aug.npy").select(F.col("name").alias("compound"))
    skipped = labels.unlabelled(files, label_table, "compound").count()
    known = labels.joined(read_arrays(spark, folder, length=length), label_table.select("compound", "label"), "compound")
    rows = known.withColumn("spectrum", F.col("spectrum").cast("array<float>"))
    if not files.join(label_table, "compound", "left_semi").limit(1).count():
        raise ValueError(f"no labelled pattern in {folder}")
    return (rows if subsample is None else split.window_sample(rows, "compound", "sample_idx", subsample).drop("block")), skipped


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Distances (i, j, d) and names (matrix_index, name) as ``sinks.write_matrix`` leaves them; both are checked again."""
    dist, names = spark.read.parquet(f"{path}/dist"), spark.read.parquet(f"{path}/names")
    return check_square(dist, check_index(names)), names


def check_square(dist: DataFrame, names: DataFrame) -> DataFrame:
    """``dist`` if it holds every pair i < j of the ``names``' indexes once; otherwise an error."""
    n = names.count()
    found = dist.agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("pairs"), F.count_if(~((F.col("i") >= 0) & (F.col("i") < F.col("j")) & (F.col("j") < n))).alias("bad")).first()
    if found.bad or not found.n == found.pairs == n * (n - 1) // 2:
        raise ValueError(f"{found.n} distances do not make a square matrix of {n} names")
    return dist


CIF_SCHEMA = "name string, formula string, sg int, lengths array<double>, angles array<double>, ordered boolean, sites array<struct<element:string,x:double,y:double,z:double,occupancy:double>>, operations array<string>, problem string"


def _number(text: str) -> float:
    """A number of a CIF, whose uncertainty in parentheses does not count."""
    return float(text.split("(")[0])


def parse_cif(text: str) -> dict:
    """Formula, space group, cell and sites of the first structure of a CIF. Missing cells or sites are a ValueError."""
    words = re.findall(r"(?m)^;[\s\S]*?^;|'[^'\n]*'(?=\s|$)|\"[^\"\n]*\"(?=\s|$)|[^\s]+", re.sub(r"(?m)(^|\s)#.*$", r"\1", text))
    single: dict[str, str] = {}
    loops: list[tuple[list[str], list[str]]] = []
    at, started = 0, False
    while at < len(words):
        word = words[at]
        at += 1
        if word.lower().startswith("data_"):
            if started:
                break
            started = True
        elif word.lower() == "loop_":
            names, values = [], []
            while at < len(words) and words[at].startswith("_"):
                names.append(words[at].lower())
                at += 1
            while at < len(words) and not words[at].startswith("_") and not words[at].lower().startswith(("loop_", "data_")):
                values.append(words[at].strip("'\""))
                at += 1
            loops.append((names, values))
        elif word.startswith("_") and at < len(words):
            single.setdefault(word.lower(), words[at].strip("'\"; \n"))
            at += 1
    lengths = [_number(single[f"_cell_length_{a}"]) for a in "abc"]
    angles = [_number(single.get(f"_cell_angle_{a}", "90")) for a in ("alpha", "beta", "gamma")]
    sites = []
    for names, values in loops:
        if "_atom_site_fract_x" in names:
            column = {n: k for k, n in enumerate(names)}
            kind = column.get("_atom_site_type_symbol", column.get("_atom_site_label", 0))
            for k in range(0, len(values) - len(names) + 1, len(names)):
                row = values[k : k + len(names)]
                element = re.match(r"[A-Z][a-z]?", row[kind])
                filled = _number(row[column["_atom_site_occupancy"]]) if "_atom_site_occupancy" in column else 1.0
                sites.append({"element": element[0] if element else row[kind], **{a: _number(row[column[f"_atom_site_fract_{a}"]]) for a in "xyz"}, "occupancy": filled})
    if not sites:
        raise ValueError("no sites")
    symmetry = ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz")
    operations = [v for names, values in loops for k, v in enumerate(values) if names[k % len(names)] in symmetry]
    group = next((single[k] for k in ("_space_group_it_number", "_symmetry_int_tables_number") if k in single), None)
    formula = single.get("_chemical_formula_sum")
    return {
        "formula": re.sub(r"(?<=[A-Za-z])1(?=$|[A-Z])", "", formula.replace(" ", "")) if formula else None,
        "sg": int(group) if group and group.isdigit() else None,
        "lengths": lengths, "angles": angles, "ordered": all(s["occupancy"] >= 1 - 1e-8 for s in sites), "sites": sites, "operations": operations,
    }


def read_cifs(spark: SparkSession, folder: str, tolerance: float = 1.5) -> DataFrame:
    """Structures of all CIF files of a folder, one row per file; ``problem`` says why a file could not be read (its other columns are null).

    Space group and formula are the file's own statements, the name's suffix (``_123``) stands in for a missing group; see
    ``structures.primitive_cells`` for primitive cells. A site filled beyond ``tolerance`` is a problem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cif").load(folder).select(F.expr("url_decode(element_at(split(path, '/'), -1))").alias("file"), "content")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in re.split(r",\s+(?![a-z]+:)", CIF_SCHEMA)]
        for part in parts:
            rows = []
            for file, content in zip(part["file"], part["content"], strict=True):
                row = dict.fromkeys(names) | {"name": file.removesuffix(".cif")}
                try:
                    found = parse_cif(content.decode("utf-8", "replace"))
                    if max(s["occupancy"] for s in found["sites"]) > tolerance:
                        raise ValueError("a site is filled beyond the tolerance")
                    row |= found
                except (ValueError, KeyError, IndexError) as error:
                    row["problem"] = f"{type(error).__name__}: {error}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    read = files.mapInPandas(decode, CIF_SCHEMA)
    return read.withColumn("sg", F.coalesce("sg", chemistry.suffix_group(F.col("name"))))
