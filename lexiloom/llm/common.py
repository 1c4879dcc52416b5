"""Helpers that the operators of this subpackage share.

Conventions of every operator here:

* input columns are picked by name, so further columns (also ones whose names
  clash with an operator's own) never matter; results hold the documented columns only;
* a null text counts as the empty text;
* rows that agree in id *and* text are the same document.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
_own_dir: list[str] = []
_files: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, only where that is unset and driver and executors are one process (as in
    tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lexiloom-"))
    return _own_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors. The files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _files[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` or ``numbered`` returned and that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_files.pop(df))
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``at``, a row's place (from 0) among the rows of its group (columns that may be null), and ``group_rows``. A group's rows may lie in many
    partitions: rows are dealt by ranges of group and order, and counts by partition and group give each stretch its first place."""
    keys = [*group, *order]
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("m", F.monotonically_increasing_id()), label)
    names = [f"g{i}" for i in range(len(group))]
    runs = placed.groupBy(F.shiftright("m", 33).alias("p"), *[F.col(c).alias(g) for c, g in zip(group, names)]).agg(F.min("m").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(*(names or [F.lit(0)]))
    before = F.sum("rows").over(whole.orderBy("p")) - F.col("rows")
    runs = runs.withColumn("before", before).withColumn("group_rows", F.sum("rows").over(whole))
    same = F.shiftright("m", 33) == F.col("p")
    for c, g in zip(group, names):
        same = same & F.col(c).eqNullSafe(F.col(g))
    out = placed.join(runs, same).select(*df.columns, (F.col("before") + F.col("m") - F.col("first")).alias("at"), "group_rows")
    _files[out] = _files.pop(placed)
    return out


def joined(df: DataFrame, key: str, sums: DataFrame, rows: str) -> DataFrame:
    """``df`` with the columns of ``sums`` (one row for each value of ``key``, null among them), which counts the rows of ``df`` by key as ``rows``. Keys with more than a thousandth
    of all rows, at most a thousand of them, are broadcast, so their rows stay where they are; the others' are shuffled."""
    least = sums.agg(F.sum(rows)).first()[0] or 0
    heavy, k = F.col(rows) > least / 1000, free([*df.columns, *sums.columns], "of_key")
    add = [c for c in sums.columns if c != key]
    side = sums.withColumnRenamed(key, k)
    there = F.col(key).eqNullSafe(F.col(k))
    first = df.join(F.broadcast(side.where(heavy)), there, "left").drop(k)
    done = first.where(F.col(rows).isNotNull())
    rest = first.where(F.col(rows).isNull()).drop(*add).join(side.where(~heavy), there).drop(k)
    return done.unionByName(rest)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder in ``buckets`` buckets of ``key`` and read it back: aggregates and joins by the key don't shuffle it again."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # leaves the catalog; the files stay
    return out


def named(column: str) -> Column:
    """The column of this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free(columns: list[str], name: str) -> str:
    """A name made from ``name`` that none of ``columns`` has, in capitals or not."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def remainder(doc_id: str | Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")), F.lit(of))


def text_key(text: str | Column) -> Column:
    """16 bytes that stand for a whole text (null: the empty text)."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def utf8(text: object) -> bytes:
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def sizes(texts) -> list[int]:
    """Characters of each text."""
    return [len(t) if isinstance(t, str) else 0 for t in texts]


def slices(pdf: pd.DataFrame, sizes: list[int], limit: int) -> Iterator[slice]:
    """Cut a batch into runs of rows of about ``limit`` bytes, whole rows only."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    return ((x >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_KEY = mix64(np.arange(256, dtype=U64) + U64(1 << 20))
_PLACE_KEY = mix64(np.arange(4096, dtype=U64) + U64(1 << 30)) | U64(1)


class Words:
    """The words (runs of bytes other than ASCII white space) of some texts, as arrays."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        space = _SPACE[self.data]
        before = np.concatenate([[True], space[:-1]])
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(~before & space)
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, U64)
        size = (self.ends - self.starts).astype(np.int32)
        first = (np.cumsum(size) - size).astype(np.int32)
        n = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first, size)
        at = np.repeat(self.starts.astype(np.int32), size) + n
        parts = _BYTE_KEY[self.data[at]] * _PLACE_KEY[n & 4095]
        if int(size.max()) > 4096:
            parts += (n >> 12).astype(U64)
        return mix64(np.add.reduceat(parts, first) ^ size.astype(U64))
