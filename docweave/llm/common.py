"""Shared pieces: work tables in the shared folder and byte-level text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case, all other bytes as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Text handled at once in one Python worker, which bounds its memory.
CHUNK_BYTES = 2 << 20
#: Bytes of a batch on its way to a Python worker; a row that is larger makes a batch of its own.
BATCH_BYTES = 4 << 20


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where everything runs in one process may it be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='docweave-')}"
        base = _OWN[app]
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and sizes are known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._work_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few longs each, 16 to 64 bytes, that may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if its rows are counted and few; else joined by a shuffle."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bound_batches(spark: SparkSession) -> None:
    """From now on batches to Python workers are bounded in bytes, so that long texts don't add up to large ones.

    The setting stays, as plans read it when they run, which is after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """(start, stop) ranges of texts of about limit bytes each; a longer text is a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a linear combination can be used."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width consecutive words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n] if n > 0 else out
    return mixed(out)
