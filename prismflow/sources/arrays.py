"""Array files as a Spark data source: ``spark.read.format("array_files")`` after ``register(spark)``.

Reading: a folder's files with a suffix, each an array (n, length[, 1]), (length, 1) or (length,) as ``patterns.read_arrays`` takes them, give rows
(compound, sample_idx, spectrum). Partitions are planned from the files' headers alone: pieces of up to ``rows`` rows, so a large file is read by several tasks
and a task never holds a whole one. Filters on ``compound`` (=, in, starts with) leave files unopened; comparisons of ``sample_idx`` with numbers leave
rows unread. Pickled or misshapen files are an error.

Writing: each task writes its rows as part files of up to ``rows`` rows, one array of spectra and, if there is a column ``label``, one of labels, under names that
readers ignore; the commit gives them their names, an abort removes them. ``overwrite`` removes what was there before at the commit.

Files are reached through Arrow's file systems: a local or mounted path, or a URI that Arrow knows. Pushed filters need
``spark.sql.python.filterPushdown.enabled``, which ``register`` sets.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "compound string, sample_idx int, spectrum array<double>"
SUFFIX, ROWS = "_aug.npy", 256
PART = "_part-"


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def header(file: pa.NativeFile) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type of an array file, which is left at its first value."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(file)
    if kind.hasobject:
        raise ValueError("pickled arrays are refused")
    return shape, fortran, kind


def rows_and_length(shape: tuple[int, ...]) -> tuple[int, int]:
    if len(shape) not in (1, 2, 3) or 0 in shape or (len(shape) > 1 and shape[-1] != 1 and len(shape) == 3):
        raise ValueError(f"unexpected shape {shape}")
    if len(shape) == 3:
        return shape[0], shape[1]
    return (1, shape[0]) if len(shape) == 1 or shape[1] == 1 else shape


@dataclass
class Piece(InputPartition):
    path: str
    compound: str
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.rows = options["path"], options.get("suffix", SUFFIX), int(options.get("rows", ROWS))
        self.names: set[str] | None = None
        self.starts: list[str] = []
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("compound",) and isinstance(f, (EqualTo, In)):
                names = {value} if isinstance(f, EqualTo) else set(value)
                self.names = names if self.names is None else self.names & names
            elif column == ("compound",) and isinstance(f, StringStartsWith):
                self.starts.append(value)
            elif column == ("sample_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def _wanted(self, compound: str) -> bool:
        return (self.names is None or compound in self.names) and all(compound.startswith(s) for s in self.starts)

    def partitions(self) -> list[Piece]:
        files, root = place(self.path)
        pieces, opened = [], 0
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.base_name.endswith(self.suffix) or info.base_name.startswith(("_", ".")):
                continue
            compound = info.base_name.removesuffix(self.suffix)
            if not self._wanted(compound):
                continue
            with files.open_input_file(info.path) as file:
                try:
                    n, _ = rows_and_length(header(file)[0])
                except ValueError as error:
                    raise ValueError(f"{info.base_name}: {error}") from error
            opened += 1
            end = n if self.high is None else min(n, self.high)
            pieces += [Piece(info.path, compound, a, min(a + self.rows, end)) for a in range(self.low, end, self.rows)]
        return pieces or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        files, _ = place(self.path)
        with files.open_input_file(partition.path) as file:
            shape, fortran, kind = header(file)
            n, length = rows_and_length(shape)
            if fortran and n > 1 and length > 1:
                x = np.frombuffer(file.read(n * length * kind.itemsize), kind).reshape(length, n).T[partition.first : partition.last]
            else:
                file.seek(file.tell() + partition.first * length * kind.itemsize)
                x = np.frombuffer(file.read((partition.last - partition.first) * length * kind.itemsize), kind).reshape(-1, length)
        edges = np.arange(len(x) + 1, dtype=np.int32) * length
        spectra = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))
        index = pa.array(np.arange(partition.first, partition.last, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([partition.compound] * len(x)), index, spectra], ["compound", "sample_idx", "spectrum"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite
        if "spectrum" not in schema.fieldNames():
            raise ValueError("array files need a column spectrum")
        self.columns = schema.fieldNames()
        files, root = place(self.path)
        files.create_dir(root, recursive=True)

    def _save(self, files: fs.FileSystem, root: str, x: np.ndarray, kind: str) -> str:
        name = f"{PART}{uuid.uuid4().hex}{kind}.npy"
        with files.open_output_stream(posixpath.join(root, name)) as out:
            np.lib.format.write_array(out, np.ascontiguousarray(x), allow_pickle=False)
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = place(self.path)
        names: list[str] = []
        for batch in iterator:
            spectra = batch.column(self.columns.index("spectrum"))
            for a in range(0, batch.num_rows, self.rows):
                part = spectra.slice(a, self.rows)
                sizes = set(np.asarray(part.value_lengths()).tolist()) if part.null_count == 0 else {None}
                if len(sizes) != 1 or None in sizes:
                    raise ValueError("spectra of one file must have one length and no nulls")
                x = np.asarray(part.flatten()).reshape(len(part), -1)
                names.append(self._save(files, root, x[:, :, None], ""))
                if "label" in self.columns:
                    labels = np.asarray(batch.column(self.columns.index("label")).slice(a, self.rows))
                    label_name = self._save(files, root, labels, "-labels")
                    wanted = names[-1].removesuffix(".npy") + "-labels.npy"
                    files.move(posixpath.join(root, label_name), posixpath.join(root, wanted))
                    names.append(wanted)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = place(self.path)
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File and info.base_name.startswith("part-") and info.base_name.endswith(".npy"):
                    files.delete_file(info.path)
        for message in messages:
            for name in message.names if message else []:
                files.move(posixpath.join(root, name), posixpath.join(root, name.removeprefix("_")))

    def abort(self, messages: list[Written | None]) -> None:
        files, root = place(self.path)
        for message in messages:
            for name in message.names if message else []:
                files.delete_file(posixpath.join(root, name))


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayFiles)
