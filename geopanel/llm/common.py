"""Helpers that several operators share: word columns, lineage cuts and vectorised word hashing of Arrow text."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null text."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def trimmed(text: Column) -> Column:
    """The text without ASCII white space at its ends; '' for null."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))


def group_key(c: Column) -> Column:
    """A non-null key for a nullable string group: null and the text of null stay apart."""
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows, which are few, by way of Arrow: a plain list would start Python workers beside those of Arrow stages."""
    if not rows:
        return spark.createDataFrame([], schema)
    arrow = to_arrow_schema(DataType.fromDDL(schema))
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, schema)


#: Rows of a narrow work table that go to one checkpoint file at least, if there are as many.
FILE_ROWS = 20_000


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder named by spark.checkpoint.dir.

    Every partition is a file, empty or not, and on a local file system without Hadoop's native library each file starts
    processes that set its mode. most, where the caller knows it, bounds the rows of a table of a few narrow columns:
    FILE_ROWS of them share a partition. A folder of our own is set only where the session names none, as in tests.
    """
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), "geopanel-checkpoints"))
    return df.checkpoint(eager=True)


def own_prefix(columns: list[str]) -> str:
    """A prefix for columns of an operator's own that no column of a table has, in capitals or not."""
    p = "__"
    while any(c.lower().startswith(p) for c in columns):
        p += "_"
    return p


#: Rows of a table of groups that are broadcast together, at a few hundred bytes each.
TABLE = 20_000


def meet(rows: DataFrame, table: DataFrame, key: str, groups: int, weight: str, how: str = "inner") -> DataFrame:
    """rows with the columns of table, which has `groups` values of key and their numbers of rows in `weight`.

    Rows of large groups stay where they are: a table of up to TABLE groups is broadcast, and beyond that its groups with
    a thousandth of all rows are, which are at most a thousand; the rows of the others meet it in a join.
    """
    if groups <= TABLE:
        return rows.join(F.broadcast(table), key, how)
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * 1000 >= total)
    mark = F.broadcast(hot.select(key, F.lit(True).alias("__hot")).distinct())
    rows = rows.join(mark, key, "left")
    large = rows.where("__hot").drop("__hot").join(F.broadcast(hot), key)
    return large.unionByName(rows.where("__hot IS NULL").drop("__hot").join(table, key, how).select(large.columns))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- memory of Python workers --------------------------------------------------------------------------------------

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # a C library without it
    _trim = None


def give_back() -> None:
    """Return to the system what this process has freed but its allocators keep."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with give_back() at the end of each task: the worker lives on, idle, through stages
    in which the executor's JVM needs the memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


# --- vectorised word hashing -------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _MULT, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(1024)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and each row's bounds in them; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string()).fill_null("")
    bufs = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], none of them empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    lead = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(lead, size)
    power = _POW if size.max() <= len(_POW) else _powers(int(size.max()))
    h = np.add.reduceat(_BYTE[data[np.repeat(start, size) + pos]] * power[pos], lead)
    return mix64(h ^ size.astype(np.uint64))


def hash_words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): a 64-bit hash and byte bounds for each word; first[i]:first[i+1] are the words of row i.

    lower folds A-Z only. Words never cross rows.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = off[:-1][(off[:-1] < n) & (off[:-1] < off[1:])]
    begin[inner] = solid[inner]
    stop = solid.copy()
    stop[:-1] &= begin[1:] | ~solid[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, off)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, first
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    return hash_spans(data, start, end), start, end, first


def blocks(off: np.ndarray, most: int):
    """Row ranges that hold at most `most` bytes each, one row at least: bounds the memory of vectorised passes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j
