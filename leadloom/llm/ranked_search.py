"""Ranked lexical search: the k best documents of each query text, by a quantised index of two levels.

The index is cut by documents, so that nothing of it is shuffled: each block of texts has inverted lists of its own for the
terms that the queries hold. The first level has a byte for each posting, its impact rounded up; the second its exact
count. A first pass reads the bytes alone and sums them to a lower and an upper bound of each document's score;
the k-th largest lower bound of a query over all documents is its threshold. A second pass scores every document
whose upper bound reaches the threshold, in integers, from the second level. Since a lower bound never is
above the score and an upper bound never below it, no document of the first k is missed.

A task keeps k bounds, then k documents, for each query, so what is shuffled is some rows for each task and query. Queries
are taken with about SHARD_BYTES of text at a time, one pass after another; equal texts are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import Rolling, bound_batches, chunks, discard, fresh, stage

#: Documents of a query.
K = 20
#: A posting's score is weight * (ONE * tf div (1000 * tf + 12 * m)), m = 75 + 25 * n * N div L; impacts stay below ONE / 1000.
ONE = 1_000_000_000
#: What a step of the byte stands for: 255 steps reach the largest impact.
STEP = -(-ONE // 1000 // 255)
#: Bytes of the query texts that one search has at hand, and of a block's texts; one longer text makes a block by itself.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Parts that the rows of one query are dealt into before they meet.
SALTS = 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each term: a run of ASCII letters and digits and of bytes beyond ASCII, with A-Z lower-cased."""
    data = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    term = (data >= 128) | ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(term & (edge[:-1] | ~np.concatenate([[False], term[:-1]])))
    last = np.flatnonzero(term & (edge[1:] | ~np.concatenate([term[1:], [False]]))) + 1
    return np.searchsorted(offsets, first, "right") - 1, Rolling(data).hashes(first, last)


@dataclass
class Queries:
    """Some query texts: their distinct terms' hashes, ascending, and for each query its terms' numbers and how often it has them."""

    terms: np.ndarray
    at: np.ndarray  # where each query's terms begin in `term` and `often`
    term: np.ndarray
    often: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1


def parsed(texts: list[str]) -> Queries:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    row, hashes = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    terms, number = np.unique(hashes, return_inverse=True)
    pairs, often = np.unique(row * max(1, len(terms)) + number, return_counts=True)
    at = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(terms)))
    return Queries(terms, at, pairs % max(1, len(terms)), often.astype(np.int64))


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Inverted lists of these terms, a row for each block of texts.

    Documents that hold a term count from 0; `terms` are the numbers of the terms that occur, `list_at` says where each one's
    postings begin in `docs` and `counts`. n_docs and n_terms are of all documents of the block with any term.
    """
    known = docs.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), *(T.StructField(n, T.BinaryType()) for n in ("lengths", "terms", "list_at", "docs", "counts")), *(T.StructField(n, T.LongType()) for n in ("n_docs", "n_terms"))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        for batch in batches:
            for part, data, offsets in chunks(batch, limit=BLOCK_BYTES):
                row, hashes = words(data, offsets)
                length = np.bincount(row, minlength=part.num_rows).astype(np.int64)
                place = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
                hit = terms[place] == hashes if len(terms) else np.zeros(len(hashes), bool)
                pair, count = np.unique(place[hit] * part.num_rows + row[hit], return_counts=True)
                term, row = pair // part.num_rows, pair % part.num_rows
                there, doc = np.unique(row, return_inverse=True)
                own, first = np.unique(term, return_index=True)
                ids = part.column(0).take(pa.array(there, pa.int64()))
                held = (length[there], own, np.append(first, len(term)), doc, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(held, ("<i8", "<i4", "<i4", "<i4", "<i8"))),
                     pa.array([int((length > 0).sum())], pa.int64()), pa.array([int(length.sum())], pa.int64())],
                    names=schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def document_frequencies(blocks: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term is: summed in each task, then by term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for own, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.frombuffer(own, "<i4")] += np.diff(np.frombuffer(at, "<i4"))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    found = blocks.select("terms", "list_at").mapInArrow(each, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return ONE * counts // (1000 * counts + 12 * m)


def index(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index of two levels: `bytes` beside `docs` is the first, `counts` and `m` the second."""
    schema = T.StructType([*(f for f in blocks.schema.fields if f.name not in ("lengths", "n_docs", "n_terms")), T.StructField("m", T.BinaryType()), T.StructField("bytes", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ms, levels = [], []
            for lengths, docs, counts in zip(rows["lengths"].to_pylist(), rows["docs"].to_pylist(), rows["counts"].to_pylist()):
                m = 75 + 25 * np.frombuffer(lengths, "<i8") * n_docs // max(1, n_terms)
                impact = impacts(np.frombuffer(counts, "<i8"), m[np.frombuffer(docs, "<i4")])
                ms.append(m.astype("<i8").tobytes())
                levels.append((-(-impact // STEP)).astype(np.uint8).tobytes())
            kept = [name for name in schema.names if name in rows]
            yield pa.RecordBatch.from_arrays([*(rows[n] for n in kept), pa.array(ms, pa.binary()), pa.array(levels, pa.binary())], names=schema.names)

    return blocks.mapInArrow(each, schema)


class Block:
    """A block's inverted lists as a query meets them."""

    def __init__(self, row: dict, terms: int):
        own = np.frombuffer(row["terms"], "<i4")
        at = np.frombuffer(row["list_at"], "<i4")
        self.begin, self.size = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        self.begin[own], self.size[own] = at[:-1], np.diff(at)
        self.docs = np.frombuffer(row["docs"], "<i4")
        self.bytes = np.frombuffer(row["bytes"], np.uint8)
        self.n = int(self.docs.max()) + 1 if len(self.docs) else 0

    def met(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of these terms' postings, and the weight each counts with."""
        size = self.size[terms]
        before = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.begin[terms] - before, size), np.repeat(weights, size)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of each document's score. Sums of weights and bytes stay far below 2^53, so they are exact."""
        place, weight = self.met(terms, weights)
        docs, level = self.docs[place], self.bytes[place]
        steps = np.bincount(docs, weight * level, self.n).astype(np.int64)
        # A byte b above 0 stands for an impact of more than STEP * (b - 1).
        heavy = np.bincount(docs, weight * (level > 0), self.n).astype(np.int64)
        return STEP * (steps - heavy) + heavy, STEP * steps

    def scores(self, row: dict, terms: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted documents, from the second level."""
        place, weight = self.met(terms, weights)
        number = np.full(self.n, -1)
        number[wanted] = np.arange(len(wanted))
        doc = self.docs[place]
        inside = number[doc] >= 0
        place, weight, doc = place[inside], weight[inside], doc[inside]
        counts, m = np.frombuffer(row["counts"], "<i8")[place], np.frombuffer(row["m"], "<i8")[doc]
        out = np.zeros(len(wanted), np.int64)
        np.add.at(out, number[doc], weight * impacts(counts, m))
        return out


@dataclass
class Weighted:
    """Queries with their terms' weights, each times how often the query has the term; those of weight 0 are left out."""

    terms: int
    at: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.term[self.at[i] : self.at[i + 1]], self.weight[self.at[i] : self.at[i + 1]]


def weighted(queries: Queries, df: np.ndarray, n_docs: int) -> Weighted:
    one = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    weight = one[queries.term] * queries.often
    kept = (weight > 0) & (df[queries.term] > 0)
    at = np.concatenate([[0], np.cumsum(kept)])[queries.at]
    return Weighted(len(queries.terms), at, queries.term[kept], weight[kept])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names) if name != "doc_ids"}


def largest(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, len(values) - k)[len(values) - k :] if len(values) > k else values


def thresholds(held: DataFrame, known, queries: int, k: int) -> np.ndarray:
    """The k-th largest lower bound of each query over all documents, 0 where fewer have one above 0; reads the first level alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = known.value, [np.zeros(0, np.int64)] * queries
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, asked.terms)
                for i in range(queries):
                    lower = block.bounds(*asked.of(i))[0]
                    least = best[i].min() if len(best[i]) >= k else 0
                    lower = lower[lower > least]
                    if len(lower):
                        best[i] = largest(np.concatenate([best[i], lower]), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(queries), [len(b) for b in best]), pa.int64()), pa.array(np.concatenate([*best, np.zeros(0, np.int64)]), pa.int64())], names=["query", "low"])

    low = held.select("terms", "list_at", "docs", "bytes").mapInArrow(each, "query long, low long")
    last = best_rows(low, k, [F.desc("low")]).filter(F.col("rank") == k).toArrow()
    out = np.zeros(queries, np.int64)
    out[last.column("query").to_numpy()] = last.column("low").to_numpy()
    return out


def best_rows(rows: DataFrame, k: int, order: list) -> DataFrame:
    """The first k rows of each query with their rank: first of each of SALTS parts, then of all, so that no task gets all rows of a query."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def rescored(held: DataFrame, known, least: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): in each task the k best documents of a query among all whose upper bound reaches its threshold."""
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", held.schema["doc_ids"].dataType.elementType), T.StructField("score", T.LongType())])
    queries, first_ids = len(least), [f.name for f in held.schema.fields].index("doc_ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value
        best: list[list[tuple]] = [[] for _ in range(queries)]
        for batch in batches:
            for r, row in enumerate(rows_of(batch)):
                block, ids = Block(row, asked.terms), batch.column(first_ids)[r].values
                for i in range(queries):
                    terms, weights = asked.of(i)
                    upper = block.bounds(terms, weights)[1]
                    floor = max(least[i], -best[i][-1][0][0] if len(best[i]) >= k else 1, 1)
                    wanted = np.flatnonzero(upper >= floor)
                    if not len(wanted):
                        continue
                    scores = block.scores(row, terms, weights, wanted)
                    good = np.flatnonzero(scores >= floor)
                    if len(good) > k:
                        # Ties of the k-th stay: which of them come first is up to their doc_ids.
                        good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
                    found = [((-int(s), d is None, d), d) for s, d in zip(scores[good], ids.take(pa.array(wanted[good])).to_pylist())]
                    best[i] = sorted(best[i] + found, key=lambda x: x[0][:2] if x[0][1] else x[0])[:k]
        flat = [(i, d, -key[0]) for i, some in enumerate(best) for key, d in some]
        columns = list(zip(*flat)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], ids_type), pa.array(columns[2], pa.int64())], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    ids_type = to_arrow_type(schema["doc_id"].dataType)
    return held.mapInArrow(each, schema)


def search_texts(docs: DataFrame, texts: list[str], k: int = K) -> DataFrame:
    """(query, rank, doc_id, score), staged: the k best documents for each of some distinct texts, whose number in the list is `query`."""
    spark = docs.sparkSession
    asked = parsed(texts)
    raw = stage(postings(docs, asked.terms), "postings")
    n_docs, n_terms = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = document_frequencies(raw, len(asked.terms))
    held = stage(index(raw, n_docs, n_terms), "index")
    discard(raw)
    known = spark.sparkContext.broadcast(weighted(asked, df, n_docs))
    least = thresholds(held, known, len(asked), k)
    best = best_rows(rescored(held, known, least, k), k, [F.desc("score"), F.col("doc_id").asc_nulls_last()])
    out = stage(best.select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    discard(held)
    known.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of highest score above 0, equal scores by ascending doc_id.

    Null and empty texts have no terms: such a document is never found and counts nowhere, such an item finds nothing.
    Items with equal texts are searched once and have rows each, repeated items as well; rows of documents
    that repeat count, and are found, each by itself, null doc_ids after all others. Long texts are taken whole.
    Other columns, of whatever name, are not looked at. Without documents or items there are no rows.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    asked = items.select("item_id", "text").filter("text IS NOT NULL")
    texts = asked.select("text").distinct()
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards, out = -(-size // SHARD_BYTES), None
    for i in range(shards):
        # Dealt by hash: their number grows as the texts do, so a shard stays of one size.
        some = sorted(r[0] for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == i).collect())
        if not some:
            continue
        numbers = spark.createDataFrame(list(enumerate(some)), "query long, text string")
        found = search_texts(docs, some, k).join(numbers, "query").drop("query")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())]))
    return asked.join(out, "text").select("item_id", "rank", "doc_id", "score")
