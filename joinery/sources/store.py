"""Files that driver and executors share: scratch tables, an object store, catalogs, archives, saved statistics."""

from __future__ import annotations

import atexit
import hashlib
import io
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, removed when this Python process ends; a folder of this machine only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="joinery-")
    path = f"{folder.rstrip('/')}/joinery-{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
        return


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame as a table of its own, so that what reads it twice reads the same rows."""
    path = scratch(frame.sparkSession, what)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_made: dict[tuple[str, str], str] = {}


def cached(spark: SparkSession, source: str, policy: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` of a source file, written once an application for each state of the file (length and time) and policy."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    state = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength(), at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    key = spark.sparkContext.applicationId, pin(policy | {"source": source, "state": list(state)})
    frame = make()
    if key not in _made or not Store(spark, _made[key]).exists("_SUCCESS"):
        path = scratch(spark, "cached")
        frame.write.option("compression", "zstd").parquet(path)
        _made[key] = path
    return spark.read.schema(frame.schema).parquet(_made[key])


class Store:
    """Objects under a folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self._conf)

    def put(self, name: str, content: bytes, exclusive: bool = False) -> None:
        """Write whole, under another name first; ``exclusive`` fails if the object is there."""
        path, fs = self._at(name)
        if exclusive and fs.exists(path):
            raise FileExistsError(name)
        own, _ = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(own, True)
        out.write(bytearray(content))
        out.close()
        if not exclusive and fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(own, path):
            fs.delete(own, False)
            raise FileExistsError(name)

    def get(self, name: str) -> bytes:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def list(self, name: str = "") -> list[str]:
        path, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def etag(self, name: str) -> str:
        return hashlib.sha256(self.get(name)).hexdigest()


def pin(policy: dict) -> str:
    return hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()


def write_catalog(records: DataFrame, path: str, policy: dict) -> DataFrame:
    """Normalised records by country and source, written once a policy: a finished catalog of the same policy is not written again."""
    spark, own = records.sparkSession, Store(records.sparkSession, path)
    if not (own.exists("pin.json") and json.loads(own.get("pin.json"))["policy"] == pin(policy)):
        records.write.mode("overwrite").option("compression", "zstd").partitionBy("country", "src").parquet(f"{path}/records")
        own.put("pin.json", json.dumps({"policy": pin(policy)}).encode())
    return read_catalog(spark, path, records.schema)


def read_catalog(spark: SparkSession, path: str, schema: StructType, country: str | None = None) -> DataFrame:
    """The catalog, or one country's folders of it."""
    own = spark.read.schema(schema).parquet(f"{path}/records")
    return own if country is None else own.filter(F.col("country") == country)


def only_rows(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of a list of ids."""
    return records.join(ids.select("id"), "id", "left_semi")


def saved_idf(make, path: str, policy: dict, spark: SparkSession) -> DataFrame:
    """An IDF table kept under its policy's pin; made by ``make()`` if it is not there."""
    at, own = f"{path}/{pin(policy)}", Store(spark, path)
    if not own.exists(f"{pin(policy)}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def read_zip(spark: SparkSession, path: str, member: str, schema: StructType) -> DataFrame:
    """Tab-separated rows of a member of ZIP archives; lines are read one by one, archives side by side."""
    names = schema.fieldNames()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as raw:
                    lines = io.TextIOWrapper(raw, encoding="utf-8", newline="\n")
                    if next(lines, "").rstrip("\r\n").split("\t") != names:
                        raise ValueError(f"columns of {member}")
                    held: list[list[str]] = []
                    for line in lines:
                        cells = line.rstrip("\r\n").split("\t")
                        held.append((cells + [""] * len(names))[: len(names)])
                        if len(held) == 10_000:
                            yield _rows(held, names)
                            held = []
                    if held:
                        yield _rows(held, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def _rows(held: list[list[str]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
