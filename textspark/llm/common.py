"""Shared helpers: shared-folder tables, size-checked broadcasts, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space and U+0009 to U+000D (fixed by the query contracts).
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
BREAK_PATTERN = r"[\x20\x09-\x0D]+"
#: Rows of one long that may be broadcast (32 MB); above it joins shuffle.
BROADCAST_ROWS = 4_000_000
#: Bytes of rows that the pipeline lets Spark hand to a Python worker at a time; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where it names none and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="textspark-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and reads it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before the table.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/textspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textspark_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_textspark_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its row count is checked to be small, else as it is."""
    return F.broadcast(df) if at_most(df, rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about ``BATCH_BYTES``; a lower limit of the session stays.

    An executor holds the batches of all its tasks, in the JVM and again in the
    workers. Frames read the limit when they run, so it is not set back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: What each operator keeps in a Python worker between tasks; anything with ``clear``.
_kept: dict[str, list] = {}


def keeps(operator: str, *caches) -> None:
    _kept.setdefault(operator, []).extend(caches)


_last: list[str] = []


def focus(operator: str) -> None:
    """Drops what other operators have kept in this worker, so that a pipeline's memory is that of one stage."""
    if _last == [operator]:
        return
    _last[:] = [operator]
    for name, caches in _kept.items():
        if name != operator:
            for c in caches:
                c.clear()
    gc.collect()
    # Large buffers go back to the system as soon as they are free.
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # a C library without these calls
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)
        libc.malloc_trim(0)


class Kept(dict):
    """``make(key)`` of each key asked for, the latest ``2 * limit`` of them kept, in two generations."""

    def __init__(self, make, limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.before = self.copy()
            super().clear()
        self[key] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.before = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive word hashes."""
    x = mix(h[: len(h) - n + 1])
    for j in range(1, n):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a lower-cased text.

    Fewer than ``n`` words make one shingle; no words make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), n))
