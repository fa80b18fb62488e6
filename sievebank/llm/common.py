"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space, the only separators between words in this subpackage.
ASCII_WS = " \t\n\x0b\x0c\r"

#: A null document id compares after every real id.
NULL_ID = (1 << 63) - 1


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: rows of this subpackage may hold megabytes each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("bB")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named Parquet table below ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``, or the checkpoint folder set on the context. Only a
    local session without either gets a temporary one of its own; a cluster must name it.
    """
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sievebank-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage with a copy that outlives executors, and freezes whatever in
    ``df`` depends on how its rows were dealt out.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Python tuples of the named columns."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of large values, one at a time, with freed memory going back to the system at once.

    The C library otherwise keeps freed blocks of up to 32 MB for the worker's next ones.
    """
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def scratch_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column in ``taken`` has that name."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file, found on whichever machine this runs."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


class Memory:
    """What a Python worker remembers about strings: two generations of at most ``most`` each.

    ``young`` serves look-ups. When it is full it becomes the old generation, from which
    whatever is asked for again returns, so frequent strings stay.
    """

    def __init__(self, most: int = 300_000, longest: int = 64):
        self.most, self.longest = most, longest
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, missing: set, learn) -> dict:
        """Values for strings that ``young`` lacks, from the old generation or from ``learn``."""
        old = self.old
        new = {m: x for m in missing if (x := old.get(m)) is not None}
        if len(new) < len(missing):
            new |= learn(missing - new.keys())
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
        self.young.update(islice(((m, x) for m, x in new.items() if len(m) <= self.longest), self.most))
        return new


@contextmanager
def no_collector():
    """Without Python's cycle collector, which costs much where many small objects are kept."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def portions(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` characters or bytes, or of one longer text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def persist_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like ``persist``, with the rows laid out by ``key``: joins on it do not deal them anew.

    There should be at least as many buckets as shuffle partitions, or Spark prefers to deal
    both sides of a join anew.
    """
    name = f"sievebank_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(df.sparkSession)}/{name}")
    writer.bucketBy(buckets, key).saveAsTable(name)
    return df.sparkSession.table(name)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: first bytes together, then second ones, as neighbours are alike there."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T))


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()
