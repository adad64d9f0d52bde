"""Shared plumbing: where intermediate tables go, and how workers find this package."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that Spark sends a Python worker at once: texts are long, and the JVM, too, holds a whole batch.
ARROW_ROWS = 2_000


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver has it on its path, and get
    rows in batches of ARROW_ROWS at most. That is a setting of the session, as plans read it when
    they run; it is made only in sessions that don't set it themselves."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows not in spark.conf.getAll:
        spark.conf.set(rows, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in a local test without one, a new folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="deltaview-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage ends here,
    and a lost executor costs at most the tasks that read it. Tables of an application share
    a folder, so that what a caller still reads can be removed when the application is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deltaview-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._deltaview_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._deltaview_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def held_out_py(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: of one operator at a time, as workers outlive
    stages and their memory is shared by all of them."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def _allocator() -> Any:
    """The C library, where it can give memory back to the system."""
    found = ctypes.CDLL(None)
    return found if hasattr(found, "malloc_trim") else None


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches; once one is worked off, memory that is free but held goes back to the system:
    workers outlive tasks, and what they hold counts against the executor."""
    library = _allocator()
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if library is not None:
            library.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so many rows: texts become Python objects piece by piece."""
    for batch in tidied(batches):
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most `most`, or single items."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
