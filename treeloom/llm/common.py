"""Helpers shared by the corpus operators: the shared folder, written stages, size-checked broadcasts, text hashing.

Nothing here keeps state on one machine.  Stages are cut by writing Parquet into the folder that
``spark.checkpoint.dir`` names, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only in a local session that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="treeloom-"))
    return "file://" + _own_dir[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/treeloom/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write a stage to the shared folder and read it back: cuts the lineage, survives lost executors.

    files: as many at most, for stages known to be small; fewer tasks then read the shuffle.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete stages that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            delete(df.sparkSession, path)


_left: list[Callable[[], None]] = []


def at_exit(spark: SparkSession, path: str) -> None:
    """A result that is still to be read stands on these files: they go when the driver's program ends."""
    _left.append(lambda: delete(spark, path))


def _delete_left() -> None:
    for done in _left:
        with contextlib.suppress(Exception):  # the session may have been stopped before: its files go with the shared folder
            done()


atexit.register(_delete_left)


def write_rows(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """df as a table bucketed by ``key``: joins on it move the other side only.  It stays until the program ends."""
    spark = df.sparkSession
    path, name = fresh_path(spark, tag), f"treeloom_{tag}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stash_path = path
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are not the catalog's
    at_exit(spark, path)
    return out


def bucket_count(spark: SparkSession, size: int, each: int = 8 << 20) -> int:
    """Buckets of so many bytes each; no fewer than a shuffle has partitions, or Spark would shuffle the table again."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // each)


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of jobs that are done: it finds them when it collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a broadcast table at most.
BROADCAST_BYTES = 16 << 20


def weight(df: DataFrame) -> int:
    """Bytes that the rows of a written stage take as a broadcast: fixed columns, texts and arrays by their length."""
    fixed, parts = 16, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif kind == "array":
            inner = f.dataType.elementType.typeName()
            length = lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("long") + 16
            parts.append(F.coalesce(F.aggregate(f.name, F.lit(0).cast("long"), lambda a, x: a + length(x)), F.lit(0)) if inner in ("string", "binary") else F.coalesce(F.size(f.name), F.lit(0)) * 16)
        else:
            fixed += 16 if kind == "struct" else 8
    return df.agg(F.sum(sum(parts, F.lit(fixed).cast("long")))).first()[0] or 0


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written stage only behind a check of its bytes; beyond it the join shuffles."""
    return F.broadcast(df) if weight(df) <= most else df.hint("merge")


def text_size(docs: DataFrame) -> tuple[int, int]:
    """UTF-8 bytes of all texts and the number of rows: what partition and file counts are sized from."""
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return size or 0, rows


def file_count(rows: int, each: int = 50_000) -> int:
    """Files for so many rows: in proportion, twelve at least."""
    return max(12, rows // each)


def prepare(spark: SparkSession) -> None:
    """Texts are long: Arrow batches bounded in bytes keep the workers' memory small.  Settings of the caller that are tighter stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


# ---------------------------------------------------------------- numpy side


def tidy(run):
    """The same function over batches or a group; when it is done, the worker gives unused memory back."""

    def give_back():
        import ctypes
        import ctypes.util

        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    def batches_done(batches):
        yield from run(batches)
        give_back()

    return batches_done


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, null as empty, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (between ASCII white space, A-Z lower-cased) and its row.

    A word's value is a polynomial over random byte values, taken at absolute positions and divided by the
    power at its start, so that the whole batch is hashed in a few passes.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data]
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = space[:-1]
    cuts = offsets[:-1]
    first[cuts[cuts < len(data)]] = True
    first &= ~space
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(data))
    value = _BYTE[data] * up
    value[space] = 0
    sums = np.add.reduceat(value, starts) * down[starts]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return mix(sums), rows


def row_slices(offsets: np.ndarray, most: int = 1 << 19):
    """Row ranges of at most ``most`` bytes each (one row at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
