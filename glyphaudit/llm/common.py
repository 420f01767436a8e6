"""Shared pieces of the training-data operators: scratch tables and word splitting."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``.

    Only a local session has a temporary one where that is unset; a cluster must name it.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="glyphaudit-")
    return _LOCAL["dir"]


def trim() -> None:
    """Gives memory that a finished task has freed back to the system; workers are used again by later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables that cut lineage: written once as Parquet in the shared folder and read back.

    A lost executor costs a task, never the table. ``drop`` frees a table that is no longer
    needed; what is left goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._at(self.root, "deleteOnExit")

    def _at(self, where: str, what: str, *more) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(jsc.hadoopConfiguration())
        if what == "deleteOnExit":
            fs.mkdirs(path)
        getattr(fs, what)(path, *more)

    def put(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Arrow batches hold 1000 rows at most meanwhile, as long texts make larger ones heavy."""
        conf = self.spark.conf
        was = conf.get(_BATCH)
        conf.set(_BATCH, str(min(1000, int(was)) if int(was) > 0 else 1000))
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(f"{self.root}/{name}")
        finally:
            conf.set(_BATCH, was)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._at(f"{self.root}/{name}", "delete", True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size in bytes, from file sizes; where it knows none, the texts are measured."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 55:
        return known
    size = F.octet_length("text") if "text" in df.columns else F.lit(256)
    return int(df.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(0)) + 16), F.lit(0)).cast("long")).first()[0])


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``most_bytes`` of one text column, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if len(sizes) > at:
            yield batch.slice(at)
    trim()


def release(spark: SparkSession, rounds: int = 1, wait: float = 0.0) -> None:
    """Lets Spark delete the shuffle files of finished queries now instead of at some later collection.

    What the first round frees may hold more, and files go some time after what named them: large
    shuffles are worth a second round and a wait.
    """
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)
