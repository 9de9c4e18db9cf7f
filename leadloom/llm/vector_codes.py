"""Short codes of vectors: product quantisation whose codebooks are integer means, refined in rounds of treeAggregate.

Vectors become integers, laid out in blocks: one row of bytes for each part, a column of the block's components per
dimension. A round is one treeAggregate over the blocks: squared distances to the entries of a codebook grow dimension
by dimension, np.add.at adds the components and counts of each entry's parts to int64 tensors, and the tensors
of tasks meet in a tree. What reaches the driver is one pair of tensors, whatever the number of vectors.
All arithmetic is on integers, so the result does not depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import bound_batches, fresh, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block at most.
BLOCK = 4096
#: Largest integer component: errors of vectors of 1,024 such components fit 64 bits.
LARGEST = 1 << 25
#: Levels of the tree in which tensors meet.
DEPTH = 3


@dataclass
class Codebooks:
    """Entries of all parts: an int64 array (parts, entries, dimensions of a part)."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    x = F.col(column)
    return vectors.filter(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))


def integers(flat: np.ndarray) -> np.ndarray:
    return np.floor(flat.astype(np.float64) * SCALE)


def blocks(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(rows, dimensions, data, and all other columns as arrays): up to BLOCK vectors a row, their integer components column by column.

    Vectors of another length than their block's first, of a length that PARTS does not divide, or with components
    beyond LARGEST stop the job.
    """
    others = [f for f in vectors.schema.fields if f.name != column]
    schema = T.StructType([T.StructField("rows", T.IntegerType()), T.StructField("dimensions", T.IntegerType()), T.StructField("data", T.BinaryType()), *(T.StructField(f"x_{i}", T.ArrayType(f.dataType)) for i, f in enumerate(others))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held = part.column(part.schema.get_field_index(column))
                n, flat = part.num_rows, held.flatten().to_numpy(zero_copy_only=False)
                d = len(held[0])
                if d == 0 or d % PARTS or any(x != d for x in held.value_lengths().to_pylist()):
                    raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
                whole = integers(flat)
                if np.abs(whole).max() > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST // SCALE}")
                columns = whole.astype("<i4").reshape(n, d).T
                rest = [part.column(part.schema.get_field_index(f.name)) for f in others]
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in rest]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([d], pa.int32()), pa.array([np.ascontiguousarray(columns).tobytes()], pa.binary()), *lists], names=schema.names)

    return vectors.select(column, *(F.col(f"`{f.name}`") for f in others)).mapInArrow(each, schema)


def unpacked(data: bytes, dimensions: int) -> np.ndarray:
    """(parts, dimensions of a part, rows) of a block's bytes."""
    return np.frombuffer(data, "<i4").reshape(PARTS, dimensions // PARTS, -1)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each column of one part (dimensions, rows), and its squared distance; ties go to the lower entry."""
    distances = np.zeros((part.shape[1], len(entries)), np.int64)
    for dimension, column in enumerate(part):
        off = column.astype(np.int64)[:, None] - entries[None, :, dimension]
        off *= off
        distances += off
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(best)), best]


def first_entries(vectors: DataFrame, column: str, key: str) -> np.ndarray | None:
    """The codebooks to begin with: the parts of the ENTRIES vectors of smallest key. Null keys come last; of equal keys the smaller vector."""
    rows = vectors.select(F.col(key).alias("k"), F.col(column).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not rows:
        return None
    if len({len(r["v"]) for r in rows}) > 1 or len(rows[0]["v"]) % PARTS or not len(rows[0]["v"]):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    return integers(np.array([r["v"] for r in rows])).astype(np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()


def refine(held: DataFrame, entries: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after some rounds over staged blocks: each entry becomes the floor of the mean of its parts; unused ones stay."""
    context = held.sparkSession.sparkContext
    packed = held.select("data", "dimensions").rdd
    for _ in range(rounds):
        known = context.broadcast(entries)

        def add(into, row, known=known):
            sums, counts = into
            if row["dimensions"] != known.value.shape[2] * PARTS:
                raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
            for i, part in enumerate(unpacked(row["data"], row["dimensions"])):
                best, _ = nearest(part, known.value[i])
                np.add.at(counts[i], best, 1)
                for dimension, column in enumerate(part):
                    np.add.at(sums[i, :, dimension], best, column.astype(np.int64))
            return into

        zero = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
        sums, counts = packed.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), DEPTH)
        entries = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], entries)
        known.destroy()
    return Codebooks(entries)


def coded(held: DataFrame, others: list[T.StructField], books: Codebooks) -> DataFrame:
    """(code, error, and the other columns) of each vector of staged blocks: two hex digits for each part; squared distances in all."""
    known = held.sparkSession.sparkContext.broadcast(books.entries)
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), *(T.StructField(f"x_{i}", f.dataType) for i, f in enumerate(others))])
    digits = np.array([f"{i:02x}" for i in range(256)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                found = [nearest(part, known.value[i]) for i, part in enumerate(unpacked(batch.column(0)[r].as_py(), batch.column(1)[r].as_py()))]
                codes = digits[found[0][0]]
                for best, _ in found[1:]:
                    codes = np.char.add(codes, digits[best])
                rest = [batch.column(2 + i).slice(r, 1).flatten() for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([pa.array(codes.tolist(), pa.string()), pa.array(sum(error for _, error in found), pa.int64()), *rest], names=schema.names)

    return held.select("data", "dimensions", *(f"x_{i}" for i in range(len(others)))).mapInArrow(each, schema)


def compress(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(the rows with code and error in place of the vector, codebooks), staged in the shared folder.

    Rows whose vector is null, or has null or non-finite components, are left out. Rows that repeat count as often as
    they occur. With fewer usable vectors than ENTRIES the codebooks have as many entries as there are; with none
    there are no rows and no codebooks. Vectors that differ in length, of a length that PARTS does not divide, or with components
    beyond 2^13 stop the job. Further columns, nulls in them included, go along; those called code or error get underscores behind their names.
    """
    bound_batches(vectors.sparkSession)
    kept = usable(vectors, column)
    others = [f for f in vectors.schema.fields if f.name != column]
    names = fresh(["code", "error"], *(f.name for f in others))
    entries = first_entries(kept, column, key)
    if entries is None:
        empty = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), *(T.StructField(n, f.dataType) for n, f in zip(names, others))])
        return vectors.sparkSession.createDataFrame([], empty), None
    held = stage(blocks(kept, column), "vector-blocks")
    books = refine(held, entries, rounds)
    out = coded(held, others, books).withColumnsRenamed({f"x_{i}": n for i, n in enumerate(names)})
    return stage(out, "vector-codes"), books


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """The rows with label_error: the errors of all rows of an equal label, nulls together, summed before they are dealt."""
    own, total = fresh(codes.columns, "own_label", "label_error")
    sums = codes.groupBy(F.col(label).alias(own)).agg(F.sum("error").alias(total))
    return codes.join(sums, codes[label].eqNullSafe(sums[own])).drop(own)
