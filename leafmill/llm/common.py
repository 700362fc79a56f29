"""What the operators of this subpackage share: staging in the shared folder, text batches and hashing.

Executors may be lost at any time, so results that are read more than once are written as Parquet
in the folder that the session names in ``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # no such library on this system
    _libc = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session or its context names it; a temporary one only where neither does and all runs on this machine (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex[:12]}-{name}"


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once and return a scan of it. It cuts the lineage and survives lost executors; the shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stage``, in buckets of ``key``: joins on it don't deal these rows anew. The catalog keeps no entry; ``drop_stage`` deletes the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"spark_catalog.default.{path.rsplit('/', 1)[1].replace('-', '_')}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    buckets = spark.conf.get("spark.sql.shuffle.partitions")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.insertInto(table)
        return spark.table(table)
    finally:
        spark.conf.set(_CLEANUP, before)
        spark.sql(f"DROP TABLE {table}")  # its files are elsewhere than the warehouse and stay


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any longer."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def key_of(column: str) -> Column:
    """A column as text that is never null: joins and groups on it deal rows alike, which ``eqNullSafe`` and ``dropDuplicates`` don't."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for inner columns that no column in ``taken`` has, whatever its case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while (name := f"{name}_").lower() in used:
            pass
        used.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give freed memory back to the system: workers are reused, and what one task has taken would stay with it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; Python then neither decodes nor encodes it."""
    return F.col(column).cast("binary")


def values(array: pa.Array) -> list[bytes]:
    """The byte strings of an Arrow column, null as empty."""
    return [x or b"" for x in array.to_pylist()]


def groups_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive slices whose sizes sum to ``most`` at most (a single larger item is alone)."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class BoundedCache(dict):
    """A dict that fills missing keys by ``make`` and starts anew beyond ``most`` entries."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
