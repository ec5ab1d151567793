"""What the operators share: table access, the shared scratch folder, and packed shuffles."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import words

PACKED = "_bucket int, _blob binary"
_PACKED_SCHEMA = pa.schema([("_bucket", pa.int32()), ("_blob", pa.binary())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A temporary one of this machine only in local mode, where all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="joinery-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_made: dict[str, SparkSession] = {}


def remove(path: str) -> None:
    """Delete a scratch folder, as soon as nothing reads it any more."""
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
        return


atexit.register(lambda: [remove(path) for path in list(_made)])


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when this Python process ends or by ``remove``."""
    path = f"{shared_dir(spark).rstrip('/')}/joinery-{what}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation, and the write does
    not evaluate the plan twice as an eager checkpoint does.  ``rows`` bounds the Arrow batches of this
    write (Spark bounds them by rows only, and holds each twice outside the heap): for wide rows.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    before = spark.conf.get(_BATCH)
    if rows is not None and not 0 < int(before) < rows:
        spark.conf.set(_BATCH, rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing will read again."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            remove(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps."""
    gc.collect()  # Python's handles first
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that is free back to the system: idle Python workers stay for a while beside the next ones."""
    words._powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        return


#: What a task leaves in its Python worker for the next ones (an encoder's tables).
kept: dict = {}


def forget() -> None:
    """Drop what earlier tasks left in this worker: idle workers are used in turn, so it would stay in all of them."""
    if kept:
        kept.clear()
        gc.collect()
        release()


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, with memory released at the end of a task, and at its beginning what others left, unless it ``keeps`` that."""

    def own(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        yield from run(batches)
        release()

    return own


def parts_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for a shuffle of about the size of ``df``'s files: the session's number, or more where a partition would be over ``each`` bytes.

    The size is the optimizer's estimate; where it has none (tables held by the driver) the session's number stands.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_parts(df.sparkSession), -(-size // each) if size < 1 << 60 else 1)


def pack(buckets: np.ndarray, n: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, bytes of its records): one row a bucket instead of one a record."""
    if not len(records):
        return
    order = np.argsort(buckets, kind="stable")
    records = records[order]
    ends = np.cumsum(np.bincount(buckets, minlength=n))
    ids, blobs, at = [], [], 0
    for b, end in enumerate(ends.tolist()):
        if end > at:
            ids.append(b)
            blobs.append(records[at:end].tobytes())
        at = end
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], schema=_PACKED_SCHEMA)


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of this partition's blobs."""
    parts = [np.frombuffer(b, dtype) for batch in batches for b in batch.column("_blob").to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
