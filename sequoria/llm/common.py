"""What the training-data operators share: tables, shared storage, words and hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test-data table; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable_on_workers(spark: SparkSession) -> None:
    """Puts the folder of this package on the Python workers' path (needed if the driver runs elsewhere)."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(x for x in (root, paths.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session may do without: it gets a folder of its
    own; elsewhere a folder of one machine would lose what others need, so that is an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sequoria-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


#: What this driver has materialised and not discarded.
_WRITTEN: list[str] = []


def discard(spark: SparkSession, keep: DataFrame) -> None:
    """Deletes what was materialised so far but for the files that `keep` reads. Other tables over them can't be read
    any more."""
    held = {x.rsplit("/", 1)[0].split("/sequoria/")[-1] for x in keep.inputFiles()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in [p for p in _WRITTEN if p.split("/sequoria/")[-1] not in held]:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes Parquet to the shared folder and reads it again, so lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sequoria/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that are broadcast at most, some 16 MB.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it is counted to be small; else it is joined by a shuffle. df is materialised."""
    return F.broadcast(df) if df.count() <= rows else df


def output_schema(df: DataFrame, more: str) -> StructType:
    """df's columns and further ones; those of df that have such a name are an error, not an overwrite."""
    extra = StructType.fromDDL(more)
    if clash := {f.name.lower() for f in extra} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    return StructType([*df.schema.fields, *extra.fields])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; one empty string for null or no word (it saves testing the text first)."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), SPACE_CLASS + "+")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the text 'null'."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % n


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, kept up to a bounded number of words."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


_HASHES = WordHashes()
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Frees what this worker keeps between tasks: words, Arrow's pool, free C memory."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(run: Batches) -> Batches:
    """run, then give_back. Workers serve one stage after another; else each stage's leavings add to the next one's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()  # by name: the worker's own module is meant, not a copy sent along

    return wrapped


_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased; with fewer words the whole
    sequence is one shingle; empty for null or no word. bytes.lower and bytes.split follow the word rule."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    with np.errstate(over="ignore"):
        if len(parts) < size:
            got = np.uint64(len(parts))
            for x in h:
                got = mixed(np.atleast_1d(got * _STEP + x))[0]
            return np.atleast_1d(got)
        n = len(parts) - size + 1
        got = h[:n].copy()
        for i in range(1, size):
            got = mixed(got * _STEP + h[i : n + i])
    return np.unique(got)
