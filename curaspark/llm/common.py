"""Shared plumbing of the text operators: tables, words, stored intermediates and packed integers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes between words in every contract of this package: space, \t, \n, \v, \f, \r.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode only, a temporary folder where it is unset.

    That temporary folder goes when the Python process ends.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="curaspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Tables written once to the shared folder: they cut lineage and outlive a lost executor.

    A table that a returned plan reads has to stay as long as the plan may run, so a store's folder goes when the
    application ends; operators drop what no later plan reads as soon as it is of no use.
    """

    def __init__(self, spark: SparkSession, what: str, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
        if root is None:
            files, path = self._files(self.root)
            files.mkdirs(path)
            files.deleteOnExit(path)

    def _files(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def writing(self, write: Callable[[], None]) -> None:
        """Runs a write whose shuffle files are removed as soon as it is done: no other plan can read them."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            write()
        finally:
            self.spark.conf.set(_CLEANUP, before)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back."""
        path = f"{self.root}/{name}"
        self.writing(lambda: df.write.option("compression", "zstd").parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads."""
        for name in names:
            files, path = self._files(f"{self.root}/{name}")
            files.delete(path, True)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes: planes of zeros then shrink to nothing in shuffle compression."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for a Python worker that hands freed memory back at its end: workers stay for stages that need none."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: nothing to hand back by name

    return whole
