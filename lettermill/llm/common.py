"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: the session's spark.checkpoint.dir.

    Where no such setting exists, a session in one process (tests) takes a temporary folder and sets
    it; on a cluster that is an error, for executors don't see one another's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/lettermill-{uuid.uuid4().hex}"


def written(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """df, stored as a table in the shared folder and read again: later reads don't compute it
    anew, and a lost executor loses nothing of it. Its path is added to scratch, if given."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes stored tables that nothing reads any more, and empties the list. What `written` stores
    without a list stays until the shared folder is cleared: results read from it."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, scratch):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


Step = Callable[[dict[str, list]], dict[str, Iterable]]


def _names(fields: T.StructType) -> set[str]:
    return {f.name.lower() for f in fields}


def _parts(batch: pa.RecordBatch, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes at most, which keeps small what is in Python at once. A batch
    without rows is one slice."""
    each = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for at in range(0, max(batch.num_rows, 1), each):
        yield batch.slice(at, each)


#: What this Python worker keeps from task to task of one stage; that stage, and the tasks so far.
_KEPT: dict = {}
_NOW: dict = {"stage": None, "tasks": 0}
IDLE_SECONDS = 3


def _same_stage() -> None:
    """Forgets what was kept when the worker's stage is another than before: workers outlive stages."""
    stage = TaskContext.get().stageId() if TaskContext.get() else None
    _NOW["tasks"] += 1
    if stage != _NOW["stage"]:
        _drop_kept()
        _NOW["stage"] = stage


def _drop_kept() -> None:
    """Frees what is kept, also where it refers to itself, which only a collection finds."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        _trim()


def _forget(tasks: int) -> None:
    if _NOW["tasks"] == tasks:
        _drop_kept()


def kept(name: tuple, make: Callable):
    """make(), once for each worker and stage."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _give_back() -> None:
    """Returns freed memory to the system when a task ends; and what is kept, if the worker then has
    nothing to do for a while."""
    _trim()
    if _KEPT:
        later = threading.Timer(IDLE_SECONDS, _forget, (_NOW["tasks"],))
        later.daemon = True
        later.start()


def with_columns(df: DataFrame, reads: list[str], fields: T.StructType, start: Callable[[], Step], lists: bool = True, without: Sequence[str] = ()) -> DataFrame:
    """df with columns computed from Arrow batches.

    start() runs once for each task and returns a function from the read columns' values to
    those of the new fields: lists of values, or Arrow arrays if not `lists`. A column of df whose
    name a new field has is replaced; those in `without` are read at most, and not returned.
    """
    kept = [f for f in df.schema if f.name.lower() not in _names(fields) | set(without)]
    names = [f.name for f in kept]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]
    read_at = {c.lower(): c for c in df.columns}
    need = {c: read_at[c.lower()] for c in reads}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _same_stage()
        step = start()
        for batch in batches:
            for part in _parts(batch):
                new = step({c: part.column(real).to_pylist() if lists else part.column(real) for c, real in need.items()})
                columns = [part.column(c) for c in names]
                columns += [new[c] if isinstance(new[c], pa.Array) else pa.array(new[c], kind) for c, kind in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=names + [c for c, _ in kinds])
        _give_back()

    return df.mapInArrow(run, T.StructType(kept + list(fields)))


def rows_from(df: DataFrame, reads: list[str], fields: T.StructType, start: Callable[[], Callable]) -> DataFrame:
    """Any number of new rows from each batch: start() returns a function from the read columns'
    values to those of the fields, all lists of one length."""
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _same_stage()
        step = start()
        for batch in batches:
            for part in _parts(batch):
                new = step({c: part.column(c).to_pylist() for c in reads})
                columns = [pa.array(new[c], kind) for c, kind in kinds]
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, names=[c for c, _ in kinds])
        _give_back()

    return df.select(*reads).mapInArrow(run, fields)
