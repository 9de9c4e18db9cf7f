"""Shared helpers: reading tables, staging results in the shared folder, walking Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: The session's bound on an Arrow batch, what it is if nobody has set it, and what the operators then set.
ARROW_BOUND, ARROW_UNSET, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ARROW_BYTES at most, so that long texts do not fill a Python worker; a session's own bound stands."""
    if spark.conf.get(ARROW_BOUND, ARROW_UNSET) == ARROW_UNSET:
        spark.conf.set(ARROW_BOUND, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="leadloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    bound_batches(spark)
    path = stage_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; what was made of them must have been written."""
    for df in staged:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with its columns of these names called otherwise, and what gives a frame made of it their names back."""
    own = {n.lower() for n in names}
    clashing = [c for c in df.columns if c.lower() in own]
    other = dict(zip(clashing, fresh([*df.columns, *names], *clashing)))
    return df.withColumnsRenamed(other), lambda out: out.withColumnsRenamed({v: k for k, v in other.items()})


def map_bits(rows: int) -> int:
    """Bits of a map for so many entries: sixteen for each, a power of two between 2^16 and 2^27 (16 MB)."""
    return 1 << min(27, max(16, (16 * rows).bit_length()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch holding about `limit` bytes of text: the slice, its bytes, the offsets of its rows.

    A row is never cut; one row larger than `limit` makes a slice by itself. Nulls count as empty.
    """
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    n, base = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[base : base + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes, modulo 2^64, of any substrings of a byte buffer, by prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    _pow = np.ones(1, np.uint64)
    _inv = np.ones(1, np.uint64)

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._pow) < n:
            n = max(n, 1 << 16)
            cls._pow, cls._inv = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (cls.BASE, cls.INVERSE))
        return cls._pow, cls._inv

    def __init__(self, data: np.ndarray):
        powers, self.inv = self._tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.CODES[data] * powers[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bitmap(df: DataFrame, column, bits: int):
    """Which of `bits` positions occur in an integer column, as a bool array: at most bits / 8 bytes reach the driver."""
    from pyspark.sql import functions as F

    rows = df.select((F.pmod(column, F.lit(bits)) + 1).alias("p")).groupBy(F.bitmap_bucket_number(F.col("p")).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p"))).alias("b")).collect()
    out = np.zeros(bits, bool)
    for k, b in rows:
        # Bucket k has the values from (k - 1) * 32768 + 1 on.
        at = (k - 1) * 32768
        piece = np.unpackbits(np.frombuffer(bytes(b), np.uint8), bitorder="little")[: bits - at]
        out[at : at + len(piece)] |= piece.astype(bool)
    return out
