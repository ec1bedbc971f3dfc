"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
WORD_BREAKS = "\x20\x09-\x0d"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def whole_text(col: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def id_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one in /tmp only where it is unset and the master is local, as in tests.

    Without a shared folder on a cluster this raises: executors could not read what others wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="quarryweb-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_FOLDERS: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """The application's folder in the shared one; it is removed when the driver's Python ends with its session still there."""
    path = f"{shared_dir(spark)}/quarryweb/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and then so may its folder
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Shuffle files of a written table go when it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of whole texts get at most so many rows and, but for a single longer text, bytes.

    The settings are lowered for the session, as the plans that need them run when the caller asks for their rows.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: idle workers stay beside their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: The most bits of a Bloom filter.
BLOOM_BITS = 1 << 25


def bloom(hashed: DataFrame, n: int) -> Callable[[Column], Column]:
    """Tests two bits of a hash in a filter of 16 bits a hash, but BLOOM_BITS at most; nothing in `hashed` fails."""
    size = max(64, min(BLOOM_BITS, 1 << math.ceil(math.log2(16 * max(n, 1)))))
    bits = lambda h: (h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 32).bitwiseAND(size - 1))
    words = hashed.select(F.explode(F.array(*bits(F.col("hash")))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    every = hashed.sparkSession.range(size // 64).join(words, F.col("id") == F.col("at"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table_ = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))

    def may(h: Column) -> Column:
        one, two = bits(h)
        bit = lambda b: F.get(table_.scalar(), F.shiftright(b, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63).cast("int"))) != 0
        return bit(one) & bit(two)

    return may


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted
