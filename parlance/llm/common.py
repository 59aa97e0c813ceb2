"""What the operators share: words, hashes, text blocks and the shared folder."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the space and the five ASCII controls 0x09-0x0D.
#: ``bytes.split()`` splits at exactly these six bytes.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset in local mode (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = _own_folder()
    return root.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="parlance-")


class Scratch:
    """Tables written to the shared folder inside a ``with`` go at its end, but for those kept.

    What is kept goes at the end of the block around it, if there is one.  The tables that go must
    not be part of a plan that is still to run.  Blocks nest within a thread; those of other threads are their own.
    """

    innermost: ContextVar[Scratch | None] = ContextVar("innermost", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Scratch:
        self._before = Scratch.innermost.set(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.innermost.reset(self._before)
        for path in self.paths:
            discard(self.spark, path)
        around = Scratch.innermost.get()
        if around:
            around.paths += self.kept


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark finds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; ``keep``: it outlives the innermost :class:`Scratch`."""
    path = f"{shared_root(spark)}/parlance/{name}-{uuid.uuid4().hex}"
    block = Scratch.innermost.get()
    if block:
        (block.kept if keep else block.paths).append(path)
    return path


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    for_session(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def for_session(spark: SparkSession, path: str) -> None:
    """A written folder that is still to be read goes with the driver, if nothing has deleted it before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def id_text(column: str = "doc_id") -> Column:
    """The id as a string: pandas would turn whole numbers beside a null into floats and round them."""
    return F.col(column).cast("string").alias(column)


def id_again(df: DataFrame, kind: str, column: str = "doc_id") -> DataFrame:
    """The id in its own type again."""
    return df.withColumn(column, F.col(column).cast(kind))


Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def release() -> None:
    """Give the memory that this worker no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def thrifty(run: Batches) -> Batches:
    """``run``, releasing memory at the end of each task.

    Spark keeps a task's Python worker for later tasks, also those of other operators that need
    further workers; without this each stays as large as it has ever been.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        release()

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def encoded_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """Word (bytes) to its 128-bit XXH3, remembered for the commonest words in bounded memory."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_128_digest(word)
        return value

    def both(self, words: list[bytes]) -> np.ndarray:
        """Two rows: the halves of each word's hash."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8").reshape(-1, 2).T

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.both(words)[0].copy()


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A second, independent-looking 64-bit value of each 64-bit value (SplitMix64's finisher)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of every run of ``width`` values, in log2(width) passes.

    Hashes of adjacent runs a and b join as hash(a) * base**len(b) + hash(b), so the hash of any
    width follows from those of the powers of two in it.
    """
    if len(values) < width:
        return np.zeros(0, np.uint64)
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    done, have, piece, size = None, 0, values, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if done is None:
                    done, have = piece, size
                else:
                    n = len(values) - have - size + 1
                    done = done[:n] * power(size) + piece[have : have + n]
                    have += size
            if have == width:
                return done
            n = len(piece) - size
            piece = piece[:n] * power(size) + piece[size : size + n]
            size *= 2


def in_blocks(docs: DataFrame, columns: list, blocks: int) -> DataFrame:
    """``columns`` of ``docs`` laid out by ``block``, a hash of id and text.

    The passes of an operator each group this same DataFrame by ``block`` within one plan; Spark
    then makes the exchange once and reuses its files.  Block numbers depend on the rows alone, so
    a task that runs again after a lost executor finds the same rows.
    """
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(blocks)).cast("int").alias("block")
    return docs.select(key, *columns).repartition(blocks, "block")


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def packed_flags(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpacked_flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each; 255 stands for the next of the four-byte counts at the end."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype(np.uint32).tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, n)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(data, np.uint32, -1, n)
    return out
