"""Packing documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import chunks, partitions
from leadloom.llm.tokenize import encoder

#: Tokens of a sequence.
SEQUENCE = 2048
#: The id that ends each document.
END_ID = 1
#: Bytes of text of a packing group, on average; a document counts for DOCUMENT_BYTES more.
GROUP_BYTES, DOCUMENT_BYTES = 8 << 20, 16


class BinTree:
    """A tournament tree over the room left in bins: finds the first bin that an item fits."""

    def __init__(self, bins: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [SEQUENCE] * (2 * self.leaves)

    def take(self, length: int) -> tuple[int, int]:
        """Put an item into the first bin with room; the bin and the item's offset there."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < length:
                k += 1
        offset = SEQUENCE - room[k]
        room[k] -= length
        found = k - self.leaves
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return found, offset


def first_fit_decreasing(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item; items are taken longest first, ties in the given order."""
    tree = BinTree(max(1, len(lengths)))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], offsets[i] = tree.take(int(lengths[i]))
    return bins, offsets


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, doc_crc long, copy long"
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Documents whose copies a task tells apart at once.
MOST_SEEN = 1 << 18


def pieces(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Token pieces of each document, cut every SEQUENCE ids; ids are little-endian, two or four bytes wide.

    A null or empty text has the end id alone. `doc_crc` is the checksum of all ids of the document, `copy`
    the number of equal rows (by doc_id and ids) before it in its partition.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary_path)
        seen: Counter = Counter()
        for batch in batches:
            for part, data, offsets in chunks(batch):
                ids, at = tokens.encode(data, offsets)
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[a:b], tokens.dtype.type(END_ID))
                    crc = zlib.crc32(own.tobytes())
                    copy = seen[doc, crc]
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen[doc, crc] = copy + 1
                    for k in range(0, len(own), SEQUENCE):
                        piece = own[k : k + SEQUENCE]
                        for column, value in zip(out, (doc, k, len(piece), len(own), piece.tobytes(), crc, copy)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 4 else pa.int64()) for k, x in enumerate(out)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary_path: str, seed: int = 17) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each goes to.

    Pieces are dealt at random, by a hash of their document, its checksum and their place, into groups of
    about GROUP_BYTES of text; each group packs its pieces by first-fit decreasing alone, so that no task sees
    more than a group and a lost group can be packed again with the same result. Rows that repeat a
    doc_id are packed as documents of their own; very many equal rows, and the pieces of a very long text, are spread
    over the groups. Ties are settled by document, checksum and place. Other columns are not looked at. An empty table gives no rows.
    """
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + DOCUMENT_BYTES)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = pieces(docs, vocabulary_path).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "doc_crc", "copy", "start", F.lit(seed)), F.lit(groups)))
    shuffled = dealt.repartition(min(groups, partitions(docs.sparkSession)), "pack_group")

    def fit(group: pa.Table) -> pa.Table:
        # Arrival order depends on the shuffle.
        group = group.sort_by([("doc_id", "ascending"), ("doc_crc", "ascending"), ("start", "ascending")])
        lengths = group.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(lengths)
        first = int(group.column("pack_group")[0].as_py()) << 32
        wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(group.column("ids").to_pylist(), lengths.tolist())]
        return pa.table(
            [group.column("doc_id"), group.column("start"), group.column("length"), pa.array(wide, pa.binary()), group.column("doc_tokens"), pa.array(first + bins, pa.int64()), pa.array(offsets, pa.int64())],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    return shuffled.groupBy("pack_group").applyInArrow(fit, PACKED)


def checksums(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
