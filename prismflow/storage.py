"""Where intermediate tables live.

Everything that has to outlive a stage goes to the folder named by ``spark.checkpoint.dir``,
which all executors share. Only a local master may do without: it gets a temporary folder, removed at exit.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A session on a cluster without one is an error."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='prismflow-')}")
        configured = context.getCheckpointDir()
        atexit.register(shutil.rmtree, urlparse(configured).path, ignore_errors=True)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame, rows: int | None = None, per_task: int = 250_000) -> DataFrame:
    """``df`` computed once and read back from the shared folder.

    With a bound on its ``rows`` known, small tables are written as few files of up to ``per_task`` rows each. The files
    stay until ``drop``, ``Scratch.close`` or, with ``spark.cleaner.referenceTracking.cleanCheckpoints``, until the table is unused.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_task)))
    made = df.checkpoint(eager=True)
    # A checkpoint keeps the optimiser's estimate of its size, a product over all joins before it; over rounds of joins the
    # number's digits multiply until they fill the driver.
    absurd = int(str(made._jdf.queryExecution().logical().stats().sizeInBytes())) > 1 << 80
    table = unsized(made) if absurd else made
    table._checkpoint = made
    return table


def drop(df: DataFrame) -> None:
    """Delete the files of ``df``, the result of ``cut``."""
    where = df._checkpoint._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if where.isDefined():
        remove(df.sparkSession, where.get())


class Scratch:
    """The cut tables of one computation, deleted together once its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, rows: int | None = None, per_task: int = 250_000) -> DataFrame:
        self.tables.append(cut(df, rows, per_task))
        return self.tables[-1]

    def close(self) -> None:
        for table in self.tables:
            drop(table)
        self.tables = []


def unsized(df: DataFrame) -> DataFrame:
    """``df``, the result of a checkpoint, without the optimiser's estimate of its size (and what it knows of its partitioning)."""
    session = df.sparkSession
    plain = session._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return DataFrame(plain, session)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_transient: dict[str, list[str]] = {}


def transient(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``clean`` removes."""
    path = fresh_path(spark, name)
    _transient.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_later: dict[str, list[Callable[[], None]]] = {}


def later(spark: SparkSession, work: Callable[[], None]) -> None:
    """Let ``clean`` do ``work``, such as forgetting a table that a result still reads."""
    _later.setdefault(spark.sparkContext.applicationId, []).append(work)


def clean(spark: SparkSession) -> None:
    """Remove the transient paths of this application and do what was put off; results that read them must have been written."""
    for work in _later.pop(spark.sparkContext.applicationId, []):
        work()
    for path in _transient.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def _place(spark: SparkSession, path: str) -> tuple:
    """``path`` for the JVM, and the file system that owns it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system that owns it."""
    target, files = _place(spark, path)
    files.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete from the moment it has its name."""
    target, files = _place(spark, path)
    draft, _ = _place(spark, f"{path}.draft")
    out = files.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None if there is none."""
    target, files = _place(spark, path)
    if not files.exists(target):
        return None
    source = files.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    target, files = _place(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


def in_bytes(size: str | int) -> int:
    """A size as Spark's settings write it: a number with an optional unit (k, m, g, t, with or without b)."""
    found = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", str(size).lower())
    if not found:
        raise ValueError(f"not a size: {size!r}")
    return int(found[1]) * UNITS[found[2]]


def bounded_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Lower the size of Arrow batches handed to Python workers to ``limit`` bytes, if it is larger.

    Spark reads the setting when a plan runs, so it is left lowered for the session: plans are returned before they run.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or in_bytes(now) > limit:
        spark.conf.set(key, str(limit))


def scan_bytes(df: DataFrame, text_col: str | None = None) -> int:
    """The optimiser's size of ``df``, used only to choose how many parts work is dealt into. Where it has none, the
    bytes of ``text_col`` are counted; without that column the size is taken for 1 GiB."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    if text_col is None:
        return 1 << 30
    return int(df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """``df`` dealt to all cores if its scan is too small to occupy them (under ``least`` bytes a core); otherwise unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan_bytes(df) < cores * least else df
