"""A content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash of the last ids says so, so that equal
passages give equal chunks wherever they stand. A chunk is known by its digest. A store has

- documents/: Parquet in ascending doc_id order, one row per document: its part and place there, its
  first id's place among its part's ids, its recipe (the digests of its chunks in order), which of these others
  may have too, and its Merkle root;
- chunks/: Parquet, every chunk, stored once: digest and ids, and as its home the Merkle root of the document that
  alone has it, so that reading need not look such chunks up one by one;
- manifest/: Parquet, one row per part: rows, ids, ids of all parts before, the Merkle root of its rows.

Reading recomputes all of it: chunks from their bytes, documents from their chunks, parts from their
documents. Ids are little-endian, two bytes wide if the vocabulary allows it and four bytes else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import bitmap, chunks, discard, map_bits, mix, partitions, stage
from leadloom.llm.tokenize import encoder

#: The id that ends each document.
END_ID = 1
#: Ids that the rolling hash sees; a cut comes after about 1 of CUT places; ids of a chunk at least and at most.
WINDOW, CUT, LEAST, MOST = 16, 256, 64, 4096
#: Bytes of a digest.
DIGEST = 16


def cuts(ids: np.ndarray) -> np.ndarray:
    """Where the chunks of an id stream end. They depend on the ids alone: an edit moves only cuts near it."""
    return all_cuts(ids, np.array([0, len(ids)]))[0]


def all_cuts(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The cuts of each stream ids[at[i]:at[i+1]], counted from its start: one pass of the rolling hash over all."""
    n = len(ids)
    codes = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    powers = np.full(n + 1, 0xD6E8FEB86659FD93, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    inverse = np.full(n + 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:n])])
    ends = np.arange(WINDOW, n + 1)
    rolling = mix((sums[ends] - sums[ends - WINDOW]) * inverse[ends - WINDOW])
    hits = ends[rolling % np.uint64(CUT) == 0]
    # Those whose window lies within one stream: an end belongs to the stream of the id before it.
    owner = np.searchsorted(at, hits, "left") - 1
    hits = hits[hits - WINDOW >= at[owner]]
    bounds = np.searchsorted(hits, at, "right").tolist()
    found, places, made = hits.tolist(), at.tolist(), []
    for i, (start, end) in enumerate(zip(places[:-1], places[1:])):
        out, last, size = [], 0, end - start
        for cut in [*found[bounds[i] : bounds[i + 1]], end]:
            cut -= start
            while cut - last > MOST:
                last += MOST
                out.append(last)
            if cut - last >= LEAST or cut == size:
                if cut > last:
                    out.append(cut)
                last = cut
        made.append(np.array(out, np.int64))
    return made


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd last node goes up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


ENCODED = "doc_id long, text_hash long, ids binary, sizes array<int>, recipe array<binary>, root binary"


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Each document's ids with the end id, and its chunks' sizes and digests; a null text has the end id alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary_path)
        for batch in batches:
            for part, data, offsets in chunks(batch, limit=1 << 20):
                ids, at = tokens.encode(data, offsets)
                # The end id goes behind every text's ids.
                ids, at = np.insert(ids, at[1:], tokens.dtype.type(END_ID)), at + np.arange(len(at))
                streams, sizes, recipes = [], [], []
                raw, width = ids.tobytes(), ids.itemsize
                for a, b, ends in zip(at[:-1].tolist(), at[1:].tolist(), all_cuts(ids, at)):
                    own = raw[a * width : b * width]
                    marks = [0, *(ends * width).tolist()]
                    streams.append(own)
                    sizes.append(np.diff(ends, prepend=0).astype(np.int32))
                    recipes.append([digest(own[x:y]) for x, y in zip(marks[:-1], marks[1:])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(streams, pa.binary()), pa.array(sizes, pa.list_(pa.int32())), pa.array(recipes, pa.list_(pa.binary())), pa.array(map(merkle, recipes), pa.binary())],
                    names=["doc_id", "text_hash", "ids", "sizes", "recipe", "root"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(each, ENCODED)


def width(vocabulary_path: str) -> int:
    """Bytes of a stored id."""
    return encoder(vocabulary_path).dtype.itemsize


PLACED = "part int, place long, doc_id long, start long, n_tokens long, recipe array<binary>, common array<boolean>, root binary"
#: Rows of a table that one node of a part's Merkle tree covers, and nodes that one node above covers.
FAN = 4096


@dataclass
class Store:
    """The tables of a store, and the bytes of an id there."""

    documents: DataFrame
    chunks: DataFrame
    manifest: DataFrame
    id_bytes: int


def slots(recipe: list[bytes], bits: int) -> np.ndarray:
    """Places of digests in a map."""
    return (np.frombuffer(b"".join(recipe), "<u8")[:: DIGEST // 8] % np.uint64(bits)).astype(np.int64)


def part_roots(documents: DataFrame) -> DataFrame:
    """rows, n_tokens and root of each part, from the places and the roots of its documents.

    The tree has FAN children to a node, so that no task gathers more than that.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle([r["root"] for r in listed]) for listed in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(roots, pa.binary())], names=["part", "place", "rows", "n_tokens", "root"])

    nodes = documents.select("part", "place", F.lit(1).cast("long").alias("rows"), "n_tokens", "root")
    size = documents.agg(F.max("place")).first()[0]
    size = 1 if size is None else size + 1
    while True:
        size = -(-size // FAN)
        grouped = nodes.groupBy("part", F.floor(F.col("place") / FAN).alias("place")).agg(F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "root"))).alias("roots"))
        nodes = grouped.mapInArrow(top, "part int, place long, rows long, n_tokens long, root binary")
        if size == 1:
            return nodes.select("part", "rows", "n_tokens", "root")


def write(docs: DataFrame, vocabulary_path: str, known: DataFrame | None = None) -> Store:
    """Write all documents into a new store in the shared folder.

    Documents are dealt by ranges of doc_id (null first), ties by a hash of the text; a part is one
    range. Rows that repeat a doc_id are documents of their own; very long texts are taken whole; other
    columns are not looked at. `known` are the chunks of a store before: they are not stored again.
    An empty table makes an empty store. Only the manifest's rows and a map of at most 2^27 bits reach the driver.
    """
    spark = docs.sparkSession
    # Written once, as dealing by range reads its input twice.
    coded = stage(encode(docs, vocabulary_path), "encoded")
    id_bytes = encoder(vocabulary_path).dtype.itemsize

    # Only chunks that may occur more than once have to meet; a clash in the map only lets one more through.
    again = stage(coded.select(F.explode("recipe").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "again")
    bits = map_bits(again.count())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slots(batch.column(0).to_pylist(), bits))], names=["slot"])

    shared = bitmap(again.mapInArrow(mark, "slot long"), F.col("slot"), bits)

    def apart(common: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: dict[bytes, tuple] = {}
                for ids, sizes, recipe, root in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    own = shared[slots(recipe, bits)] == common
                    if not own.any():
                        continue
                    stream, end = ids.as_py(), 0
                    for n, name, wanted in zip(sizes, recipe, own.tolist()):
                        if wanted:
                            found.setdefault(name, (stream[end : end + n * id_bytes], root))
                        end += n * id_bytes
                ids, homes = ([x[i] for x in found.values()] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(ids, pa.binary()), pa.array(homes, pa.binary())], names=["digest", "ids", "home"])

        out = coded.select("ids", "sizes", "recipe", "root").mapInArrow(each, "digest binary, ids binary, home binary")
        # Chunks of a store before may come again in any document: none has a home then.
        out = out if known is None else out.join(known.select("digest"), "digest", "left_anti")
        return out if known is None and not common else out.withColumn("home", F.lit(None).cast("binary"))

    met = apart(True).groupBy("digest").agg(F.first("ids").alias("ids")).withColumn("home", F.lit(None).cast("binary"))
    chunks_ = stage(met, "chunks").unionByName(stage(apart(False), "chunks"))
    discard(again)
    if known is not None:
        chunks_ = known.select("digest", "ids", F.lit(None).cast("binary").alias("home")).unionByName(chunks_)
    light = coded.select("doc_id", "text_hash", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"), "recipe", "root")
    dealt = light.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "text_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash").withColumn("part", F.spark_partition_id())
    every = known is not None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, before = 0, 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            starts = before + np.cumsum(n) - n
            common = [[True] * len(recipe) if every else shared[slots(recipe, bits)].tolist() for recipe in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(5), pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(starts, pa.int64()), batch.column(2), batch.column(3), pa.array(common, pa.list_(pa.bool_())), batch.column(4)],
                names=[x.split()[0] for x in PLACED.split(", ")],
            )
            row, before = row + len(n), before + int(n.sum())

    documents = stage(dealt.mapInArrow(place, PLACED), "documents")
    discard(coded)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each part: few.
    manifest = stage(part_roots(documents).withColumn("before", before), "manifest")
    return Store(documents, chunks_, manifest, id_bytes)


READ = "doc_id long, start long, n_tokens long, ids binary"


def verify(store: Store) -> None:
    """Compare the parts' rows, ids and roots, from the documents as they are, with the manifest; a difference is an error."""
    stated = store.manifest.select("part", F.struct("rows", "n_tokens", "root").alias("stated"))
    there = part_roots(store.documents).select("part", F.struct("rows", "n_tokens", "root").alias("there"))
    wrong = stated.join(there, "part", "full").filter(~F.col("stated").eqNullSafe(F.col("there"))).select("part").limit(5).collect()
    if wrong:
        raise ValueError(f"the documents do not match the manifest in parts {[r['part'] for r in wrong]}")


def read(store: Store) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (32 bits wide) of every document, from the files of a store.

    Documents are checked against the manifest at once, chunks and recipes as the rows are made; a mismatch is an error.
    """
    verify(store)
    id_bytes = store.id_bytes
    placed = store.documents.join(F.broadcast(store.manifest.select("part", "before")), "part")
    # A document is known by its root if it has a chunk of its own, no other has that root then, else by its place.
    alone = F.exists("common", lambda c: ~c)
    key = F.when(alone, F.col("root")).otherwise(F.concat_ws(":", "part", "place").cast("binary"))
    chunk, no_doc = F.struct("digest", "ids"), F.lit(None).cast("struct<doc_id:bigint,start:bigint,n_tokens:bigint,recipe:array<binary>,root:binary>")
    documents = placed.select(key.alias("key"), F.struct("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "recipe", "root").alias("doc"), F.lit(None).cast("struct<digest:binary,ids:binary>").alias("chunk"))
    named = placed.select(key.alias("key"), F.explode(F.array_distinct(F.filter(F.arrays_zip("recipe", "common"), lambda x: x["common"])["recipe"])).alias("digest"))
    fetched = named.join(store.chunks.filter("home IS NULL").select("digest", "ids"), "digest").select("key", no_doc.alias("doc"), chunk.alias("chunk"))
    own = store.chunks.filter("home IS NOT NULL").select(F.col("home").alias("key"), no_doc.alias("doc"), chunk.alias("chunk"))
    whole = documents.unionByName(fetched).unionByName(own).groupBy("key").agg(F.first("doc", ignorenulls=True).alias("doc"), F.collect_list("chunk").alias("chunks"))
    whole = whole.filter("doc IS NOT NULL").select("doc.doc_id", "doc.start", "doc.n_tokens", "doc.recipe", "doc.root", "chunks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, recipe, root, listed in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), batch.column(5)):
                found = {c["digest"]: c["ids"] for c in listed.as_py()}
                parts = [found.get(name) for name in recipe]
                # The root is that of the recipe, so chunks of other bytes, or in another order, do not give it.
                if any(x is None for x in parts) or merkle([digest(x) for x in parts]) != root:
                    raise ValueError("a document's chunks do not match its recipe")
                stream = np.frombuffer(b"".join(parts), f"<u{id_bytes}")
                if len(stream) != n:
                    raise ValueError("a document's chunks do not match its length")
                out.append(stream.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return whole.mapInArrow(build, READ)
