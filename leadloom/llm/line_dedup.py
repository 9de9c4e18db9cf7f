"""Dropping lines that many documents share."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import fresh, partitions, stage

#: Code points from which a key counts, and documents from which its lines go.
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
#: What a key ignores at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"

LINES = "key_high long, key_low long, doc_id long, text_hash long, line int, first boolean"
BITMAPS = "doc_id long, text_hash long, n_lines int, keep binary"


def line_keys(docs: DataFrame) -> DataFrame:
    """A row for each line whose key is long enough: 128 bits of the key's hash, the document and the place.

    `first` marks the first such line of a key in its document.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs_, hashes, places, firsts = [], [], [], [], []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()):
                seen = set()
                for place, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip(BLANKS).lower()
                    if len(key) < LEAST_CHARS or (len(key) < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS):
                        continue
                    digest = hashlib.blake2b(key, digest_size=16).digest()
                    digests.append(digest), docs_.append(doc), hashes.append(text_hash), places.append(place), firsts.append(digest not in seen)
                    seen.add(digest)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs_, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(firsts, pa.bool_())],
                names=["key_high", "key_low", "doc_id", "text_hash", "line", "first"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(keys, LINES)


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line) of the lines that go.

    Key hashes are dealt by range and sorted by document, largest first, and place; a pass over
    each range keeps the first document's lines and drops the others of a key that has enough
    documents. A key with more lines than a fair share of one range (there are at most 4 such
    keys for each range) is spread by document over many ranges; its count and first document,
    found beforehand by partial sums, are sent along.
    """
    n = partitions(lines.sparkSession)
    share = max(1000, lines.count() // (4 * n))
    heavy = (
        lines.groupBy("key_high", "key_low")
        .agg(F.count("*").alias("rows"), F.count_if("first").alias("documents"), F.max("doc_id").alias("largest"))
        .filter(F.col("rows") > share)
        .select("key_high", "key_low", "documents", "largest")
        .collect()
    )
    known = {(a, b): (c, d) for a, b, c, d in heavy}
    spread = F.lit(0)
    if known:
        hot = F.broadcast(lines.sparkSession.createDataFrame([(a, b, True) for a, b in known], "key_high long, key_low long, hot boolean"))
        lines = lines.join(hot, ["key_high", "key_low"], "left")
        spread = F.when(F.col("hot"), F.xxhash64("doc_id")).otherwise(F.lit(0))
    ranges = lines.withColumn("spread", spread.cast("long")).repartitionByRange(n, "key_high", "key_low", "spread").sortWithinPartitions("key_high", "key_low", "spread", F.desc("doc_id"), "line")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the key in hand: the key, its largest document, documents so far, lines that wait for a third one.
        key, largest, documents, waiting = None, None, 0, []
        for batch in batches:
            out = []
            for high, low, doc, text_hash, line, first in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (high, low) != key:
                    key, largest, documents, waiting = (high, low), doc, 0, []
                    if key in known:
                        documents, largest = known[key]
                        first = False
                elif key in known:
                    first = False
                documents += first
                if doc == largest:
                    continue
                if documents < LEAST_DOCUMENTS:
                    waiting.append((doc, text_hash, line))
                    continue
                if waiting:
                    out += waiting
                    waiting = []
                out.append((doc, text_hash, line))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["doc_id", "text_hash", "line"])

    return ranges.select("key_high", "key_low", "doc_id", "text_hash", "line", "first").mapInArrow(stream, "doc_id long, text_hash long, line int")


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """For each document that loses lines, a compressed bitmap with a set bit for each line that stays."""
    lost = dropped_lines(stage(line_keys(docs), "lines")).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lost"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, maps = [], []
            for lines in batch.column(2).to_pylist():
                bits = np.ones((max(lines) // 8 + 1) * 8, np.uint8)
                bits[lines] = 0
                sizes.append(len(bits))
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "keep"])

    return lost.mapInArrow(pack, BITMAPS)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents' columns with `text` cut to the lines that stay, and n_lines and n_dropped.

    A bitmap ends with the byte of the last line that goes; lines behind it stay.
    """
    docs = docs.drop("n_lines", "n_dropped")
    doc, text_hash, keep = fresh(docs.columns, "mark_doc", "mark_hash", "mark_keep")
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("keep").alias(keep))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks[doc]) & (F.xxhash64(docs["text"]) == marks[text_hash]), "left").drop(doc, text_hash)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, drops = [], [], []
            for text, keep in zip(batch.column(at).cast(pa.large_string()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = (text or "").split("\n")
                totals.append(len(lines))
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
                    lines = [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]
                    text = "\n".join(lines)
                drops.append(totals[-1] - len(lines))
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(drops, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines whose key occurs in LEAST_DOCUMENTS documents or more, but for the largest doc_id's.

    A key is the line stripped of blanks with A-Z lower-cased, LEAST_CHARS code points at least.
    A null or empty text is one empty line and stays as it is; rows that repeat a doc_id count as
    documents of their own; a null doc_id is the smallest; very long texts are taken whole. Other columns
    stay as they are, but for n_lines and n_dropped, which are replaced. An empty table gives no rows.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs))
