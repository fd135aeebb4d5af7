"""Shared pieces of the training-data operators: work tables, columns, hashes.

Work tables are written below the folder that ``spark.checkpoint.dir`` names, so a lost
executor never takes data with it; only where the setting is absent and the master is local
(tests) a folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []
_ENDS = False


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder for work tables and files.

    It is the session's ``spark.checkpoint.dir``; a path without a scheme lies on the default file
    system, as Spark itself reads it. Where the setting is absent a local master (whose tasks run in
    this very process) gets a folder of its own; any other master is an error, as executors
    elsewhere couldn't read what lies on the driver's machine.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        context.setCheckpointDir(at)  # the setting itself can't be changed in a running session
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path)
    return re.sub(r"^file:/(?!/)", "file:///", path.toString()).rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; removed when the driver ends, if not before."""
    global _ENDS
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _ENDS:
        _ENDS = True
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`fresh_dir` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[:] = [x for x in _MADE if x[1] != path]


def _clean() -> None:
    for spark, path in list(_MADE):
        try:
            remove_dir(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read again."""
    for t in tables:
        remove_dir(t.sparkSession, t._stored_at)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, so that no column has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text (nulls are values of their own)."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    return F.unhex(F.md5(F.concat(part(doc_id.cast("string")), F.lit("\n"), part(text.cast("string"))).cast("binary")))


def told_apart(table: DataFrame, high: str, low: str) -> Column:
    """A 64-bit name for each pair of hashes (high, low), distinct for distinct pairs.

    ``table`` has one row a pair. The name is ``high``; where two pairs share that (at 10^10 rows
    a few do) the pair's own hash takes its place. Such values are collected: their expected
    number is n^2 / 2^65, and more than 100 000 of them are an error.
    """
    twice = table.groupBy(high).agg(F.count("*").alias("n")).filter("n > 1").select(high).limit(100_001).collect()
    if len(twice) > 100_000:
        raise RuntimeError("the hashes of classes collide too often")
    if not twice:
        return F.col(high)
    return F.when(F.col(high).isin([r[0] for r in twice]), F.xxhash64(low, high)).otherwise(F.col(high))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


# --- vectorised hashing -------------------------------------------------------------------

_RNG = np.random.default_rng(0x51AB1E)
BYTE_CODE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
OTHER_CODE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def chunk_sums(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A keyed polynomial of each byte range, from prefix sums; equal ranges have equal sums.

    Sums by ``OTHER_CODE`` are independent: with both, 128 bits tell ranges apart.
    """
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code[raw] * up[: len(raw)], out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)


def word_ranges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of bytes that are not ASCII white space."""
    edge = np.flatnonzero(np.diff((~_SPACE[raw]).view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word (see :func:`word_ranges`); equal words have equal hashes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    begin, end = word_ranges(raw)
    return mix64(chunk_sums(raw, begin, end)) if len(begin) else np.zeros(0, np.uint64)
