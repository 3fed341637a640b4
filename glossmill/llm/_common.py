"""What the operators share: scratch tables in the shared folder, word kernels."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every operator here: tab to carriage return, and space.
SPACE_BYTES = b"\t\n\x0b\x0c\r "
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.frombuffer(LOWER_TABLE, np.uint8)
#: By application: paths of scratch tables, with their names in the catalog where they have one.
_SCRATCH: dict[str, list[tuple[str, str | None]]] = {}
DATABASE = "glossmill_scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if all tasks run in this process; on any other
    master that is an error, since executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='glossmill-')}")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered for :func:`drop_scratch`."""
    path = f"{shared_dir(spark)}/glossmill/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append((path, None))
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None, root: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation.  With a ``root`` the table is no scratch and stays there."""
    path = f"{root}/{name}-{uuid.uuid4().hex}" if root else scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, by: list[str], sort: bool = False, root: str | None = None) -> DataFrame:
    """``df`` as a bucketed table whose files are in the shared folder; a join on ``by`` does not shuffle it.

    Spark knows buckets from its catalog only, so the table is in a database of its own until it is dropped.
    With a ``root`` the files are no scratch and stay there.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    table = f"{DATABASE}.{name}_{uuid.uuid4().hex}"
    path = f"{root}/{table.rpartition('.')[2]}" if root else scratch_path(spark, name)
    writer = df.write.format("parquet").bucketBy(buckets, *by)
    (writer.sortBy(*by) if sort else writer).option("path", path).option("compression", "zstd").saveAsTable(table)
    if not root:
        _SCRATCH[spark.sparkContext.applicationId][-1] = (path, table)
    out = spark.table(table)
    out._scratch = path
    return out


def registered(spark: SparkSession, path: str, schema: str, buckets: int, by: list[str]) -> DataFrame:
    """The files that :func:`bucketed` left at ``path`` in another session, known to this one's catalog."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    table, keys = f"{DATABASE}.{path.rpartition('/')[2]}", ", ".join(by)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(table)
    out._scratch = path
    return out


def drop_scratch(spark: SparkSession, *frames: DataFrame, since: int = 0) -> None:
    """Delete scratch tables: those of ``frames``, or all of this application from the ``since``-th on.

    Call it once all that reads them is written.
    """
    held = _SCRATCH.get(spark.sparkContext.applicationId, [])
    named = {getattr(f, "_scratch", None) for f in frames}
    gone = [x for i, x in enumerate(held) if (x[0] in named if frames else i >= since)]
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path, table in gone:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        held.remove((path, table))
    if not any(table for _, table in held) and any(table for _, table in gone):
        with contextlib.suppress(Exception):  # another session may have tables in it
            spark.sql(f"DROP DATABASE IF EXISTS {DATABASE} RESTRICT")


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Drops at its end the scratch tables written within it, but for those of the frames appended to the list it gives."""
    held = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before, kept = {x[0] for x in held}, list(keep)
    try:
        yield kept
    finally:
        stay = before | {getattr(f, "_scratch", None) for f in kept}
        for path, _ in [x for x in held if x[0] not in stay]:
            drop_scratch(spark, types.SimpleNamespace(_scratch=path))


def thrifty(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows``, after which freed memory goes back to the system: a Python worker serves later tasks, too, and would keep the most that any took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def hash_sample(df: DataFrame, key: str, most: int, salt: str = "sample") -> DataFrame:
    """All rows, or where there are over ``most``, those whose hash of ``key`` falls below the share of ``most`` in all: about ``most``, the same ones each time.

    A row is taken by its own hash alone, so there is no sort and no gathering in one task.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def row_slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: numpy's unique hashes where it is asked for nothing else, which is far slower for many."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd constant, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(8, (n - 1).bit_length())
        out = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts, xors and odd multiplications)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a few texts.

    ``data`` holds the bytes of rows ``offsets[0]..offsets[-1]``.  Returns hashes,
    starts and ends of the words (in ``data``, from ``offsets[0]``), and the first
    word of each row (one entry more than rows).
    """
    base, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    part = data[base : base + total]
    edges = (offsets - base).astype(np.int64)
    if total == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    if lower:
        part = _LOWER[part]
    solid = ~_SPACE[part]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = edges[:-1][edges[:-1] < total]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = edges[1:][edges[1:] > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    lens = ends - starts
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
    codes = _BYTE_CODE[part[solid]] * powers(int(lens.max()))[at]
    hashes = np.add.reduceat(codes, np.cumsum(lens) - lens)
    return mix(hashes ^ lens.astype(np.uint64)), starts, ends, np.searchsorted(starts, edges)
