"""Small shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master alone may leave it unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that ``saved`` wrote; nothing may read it any more."""
    context = df.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables inside iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of an Arrow batch; its buffers stand outside the heap, once in the JVM and once in Python.
ARROW_BYTES = 8 << 20


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends, not when the driver forgets the table.

    For steps whose results are written or checkpointed: nothing reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, and bound Arrow batches by bytes."""
    context = spark.sparkContext
    if not getattr(context, "_hirelake_sent", False):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        root = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(), "hirelake.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in root.rglob("*.py"):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(archive)
        context._hirelake_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project to the operator's own column names, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


_held: dict = {}


def held(key: tuple, make):
    """What a worker process remembers between tasks, for one operator at a time.

    Python workers outlive their tasks and serve every operator in turn; asking for another key
    gives the former one's memory back first.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def let(value, body):
    """``body(value)`` with ``value`` computed once, as a lambda variable of one expression."""
    return F.transform(F.array(value), body)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
