"""What the operators of this subpackage share: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder that holds the package; Python workers import the operators from it.
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch that a Python worker gets; rows of any length then fit its memory.
BATCH_BYTES = "4m"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> SparkSession:
    """Ready ``spark`` for Python operators: workers started from another working directory
    import this package, and Arrow batches are bounded by bytes, not by rows alone."""
    spark.conf.set(BATCH_KEY, BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset a local one is set under a local
    master (tests), and a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files,
    so a lost executor never recomputes what stands before the cut."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_folder = path
    return out


def cut_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """``cut`` in buckets of ``key``, as many as shuffle partitions: ``dealt_by`` rows join it and it stays where it is."""
    session, path = df.sparkSession, new_folder(df.sparkSession, name)
    bucketed = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    (df.write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(_partitions(session), key).saveAsTable(bucketed))
    out = session.table(bucketed)
    out.cut_folder, out.cut_table = path, bucketed
    return out


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled as the buckets of ``cut_by`` are."""
    return df.repartition(_partitions(df.sparkSession), key)


def _partitions(session: SparkSession) -> int:
    return int(session.conf.get("spark.sql.shuffle.partitions"))


def drop(table: DataFrame) -> None:
    """Delete the files of a table that ``cut`` or ``cut_by`` returned, once nothing reads them any more."""
    session = table.sparkSession
    if hasattr(table, "cut_table"):
        session.sql(f"DROP TABLE {table.cut_table}")
    path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(table.cut_folder)
    path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the map of documents that a stage looks at again: a bound on what tasks are sent, whatever the corpus.
MAP_BITS = 1 << 23


def in_map(keys: DataFrame, doc_id: Column, text_key: Column) -> Column:
    """Whether (doc_id, text_key) may be among ``keys``: never false for one that is, seldom true for another.

    The keys become one row, a map of MAP_BITS bits in longs, that a scan looks into; what
    is true has to be held against the keys themselves.
    """
    at = lambda d, t: F.pmod(F.xxhash64(d, t), F.lit(MAP_BITS))
    place = at(F.col("doc_id"), F.col("text_key"))
    found = (keys.select(F.floor(place / 64).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
             .groupBy("id").agg(F.bit_or("bit").alias("bits")))
    every = keys.sparkSession.range(MAP_BITS // 64).join(found, "id", "left")
    longs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    words = every.agg(F.transform(longs, lambda x: x["bits"]).alias("map"))
    place = at(doc_id, text_key)
    word = F.get(words.scalar(), F.floor(place / 64).cast("int"))
    return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


class Places(dict):
    """Numbers keys in the order they come; ``new`` lists those not yet worked on."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list = []

    def __missing__(self, key) -> int:
        place = self[key] = len(self)
        self.new.append(key)
        return place


@contextmanager
def no_collection():
    """Without the cycle collector, which would walk large caches again and again; for code
    that makes no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_HELD: dict = {}
#: Returns freed memory to the system, which glibc else keeps for this process; absent from other C libraries.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def held(key, make):
    """What a Python worker keeps between tasks: one thing at a time, so that the caches of one
    stage are gone when the next one needs the memory."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give back what earlier tasks of this worker hold."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
