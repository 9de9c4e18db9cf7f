"""Toxicity scores learnt from confirmed toxic examples and unlabelled text.

The training risk is the non-negative positive-unlabelled one: with the class prior p,
p * loss(toxic, +) + max(0, loss(unlabelled, -) - p * loss(toxic, -)). Features say whether a text
has a word, or a word with one of several beginnings (so inflected forms count together).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import Rolling, chunks, discard, fresh, stage

#: Documents of the training sample at most: confirmed toxic ones, and unlabelled ones.
SAMPLE_TOXIC, SAMPLE_UNLABELLED = 3000, 9000
#: Hash buckets of features, and how many of them a model keeps at most.
BUCKETS, KEPT = 1 << 20, 1024
#: Toxic examples in which a kept feature occurs, at least.
LEAST = 3
#: Bytes of a word's beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 8)
#: Classifiers whose scores are averaged; each leaves a part of the sample out.
CLASSIFIERS = 5
STEPS, RATE = 300, 0.1
#: Weight decay, divided by the number of toxic examples.
DECAY = 0.15


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of the texts data[offsets[i]:offsets[i + 1]], by row; only buckets in the mask `wanted`.

    A word is a run of letters, digits or non-ASCII bytes; A-Z are lower-cased.
    """
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    word = (low >= 128) | (low - np.uint8(97) < 26) | (low - np.uint8(48) < 10)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    last = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    row = np.searchsorted(offsets, first, "right") - 1
    rolling, keys = Rolling(low), []
    for size in (0, *BEGINNINGS):
        if size:
            long = last - first > size
            buckets, rows = rolling.hashes(first[long], first[long] + size), row[long]
        else:
            buckets, rows = rolling.hashes(first, last), row
        buckets = (buckets % np.uint64(BUCKETS)).astype(np.int64)
        if wanted is not None:
            inside = wanted[buckets]
            buckets, rows = buckets[inside], rows[inside]
        keys.append(rows * BUCKETS + buckets)
    pairs = np.unique(np.concatenate(keys))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Model:
    """Kept buckets, ascending, and the weights and bias of each classifier."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Mean score of n rows, given their (row, bucket) pairs of kept buckets."""
        if not len(self.bias):
            return np.zeros(n)
        place = np.searchsorted(self.buckets, bucket)
        total = np.zeros(n)
        for w, b in zip(self.weights, self.bias):
            total += 1 / (1 + np.exp(-np.clip(np.bincount(row, w[place], n) + b, -30, 30)))
        return total / len(self.bias)


def risk(z: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative positive-unlabelled risk of scores z, and the slope that a step follows.

    With logistic losses: prior * (toxic as toxic) + max(0, unlabelled as clean - prior * (toxic as clean)). Where
    the second part is negative the step goes up it, so that it does not fit what is not there.
    """
    p, u = prior / max(1, toxic.sum()), 1 / max(1, (~toxic).sum())
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = u * np.logaddexp(0, z[~toxic]).sum() - p * np.logaddexp(0, z[toxic]).sum()
    slope = np.where(toxic, -p * s, u * s)
    slope = slope + np.where(toxic, p * (s - 1), 0) if clean > 0 else -slope
    return p * np.logaddexp(0, -z[toxic]).sum() + max(0.0, clean), slope


def fit_one(rows: tuple[np.ndarray, np.ndarray], toxic: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier with the non-negative risk, by Adam; `rows` are (row, feature) pairs."""
    row, feature = rows
    n = len(toxic)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = -1.0
    for step in range(1, STEPS + 1):
        _, slope = risk(np.bincount(row, theta[feature], n) + theta[-1], toxic, prior)
        grad = np.append(np.bincount(feature, slope[row], size), slope.sum())
        grad[:-1] += DECAY / max(1, toxic.sum()) * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


NOTHING = Model(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))


def choose(in_toxic: np.ndarray, in_other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """The buckets to keep, ascending, from the documents of each kind that have each bucket."""
    p, u = in_toxic / n_toxic, in_other / n_other
    # How far a bucket's share of toxic texts exceeds its share of all, in standard errors.
    worth = np.where(in_toxic >= LEAST, (p - u) / np.sqrt((u + 1 / (n_toxic + n_other)) / n_toxic), 0)
    best = np.argsort(-worth, kind="stable")[:KEPT]
    return np.sort(best[worth[best] > 3])


def train(kept: np.ndarray, bucket: np.ndarray, at: np.ndarray, toxic: np.ndarray, prior: float) -> Model:
    """A model of the kept buckets, from those of them that each sample document has, bucket[at[i]:at[i + 1]], and whether it is confirmed toxic."""
    row, feature = np.repeat(np.arange(len(toxic)), np.diff(at)), np.searchsorted(kept, bucket)
    fold = np.random.default_rng(29).integers(0, CLASSIFIERS, len(toxic))
    weights, bias = [], []
    for k in range(CLASSIFIERS):
        part = fold != k if (toxic & (fold != k)).any() and (~toxic & (fold != k)).any() else np.ones(len(toxic), bool)
        index = np.cumsum(part) - 1
        own = part[row]
        w, b = fit_one((index[row[own]], feature[own]), toxic[part], len(kept), prior)
        weights.append(w), bias.append(b)
    return Model(kept, np.array(weights), np.array(bias))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from `labels` (doc_id, toxic): toxic = 1 confirms, all else is unlabelled text.

    The sample has at most SAMPLE_TOXIC and SAMPLE_UNLABELLED documents, those with the smallest
    hashes of their doc_id, each once; the class prior is the labels' share of toxic rows. A null doc_id or label
    teaches nothing; of labels that repeat a doc_id the larger counts. Without a toxic label all scores are 0.
    """
    order = F.xxhash64("doc_id", F.lit(41))
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, marked = labels.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not marked:
        return NOTHING
    # Bounded: at most SAMPLE_TOXIC ids.
    confirmed = F.broadcast(labels.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(SAMPLE_TOXIC))
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")

    def single(some: DataFrame, known: bool) -> DataFrame:
        # Of rows that repeat a doc_id one is learnt from, so that ids bound the sample.
        one = some.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
        return one.select("doc_id", "one.text", F.lit(known).alias("known"))

    share = min(1.0, SAMPLE_UNLABELLED / max(1, docs.count()))
    below = int(-(1 << 63) + share * ((1 << 64) - 1))
    sampled = rows.filter(F.xxhash64("doc_id", F.lit(43)) <= F.lit(min(below, (1 << 63) - 1)))
    known = single(rows.join(confirmed, "doc_id"), True).unionByName(single(sampled, False))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                row, bucket = features(data, offsets)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["doc_id", "known", "buckets"])

    sample = stage(known.mapInArrow(buckets, "doc_id long, known boolean, buckets array<int>"), "sample")
    n_toxic, n_other = sample.agg(F.count_if("known"), F.count_if(~F.col("known"))).first()
    if not n_toxic or not n_other:
        return NOTHING
    # Of BUCKETS counts only those of buckets that may be kept come to the driver, then only the kept buckets of each document.
    each = sample.select("known", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count_if("known").alias("toxic"), F.count_if(~F.col("known")).alias("other"))
    counts = each.filter(F.col("toxic") >= LEAST).toArrow()
    of = counts.column("bucket").to_numpy()
    in_toxic, in_other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    in_toxic[of], in_other[of] = counts.column("toxic").to_numpy(), counts.column("other").to_numpy()
    kept = choose(in_toxic, in_other, n_toxic, n_other)
    wanted = np.zeros(BUCKETS, bool)
    wanted[kept] = True

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            own = wanted[flat]
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[own], minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat[own], pa.int32()))], names=["doc_id", "known", "buckets"])

    rows = sample.mapInArrow(narrow, "doc_id long, known boolean, buckets array<int>").toArrow().sort_by([("known", "descending"), ("doc_id", "ascending")])
    discard(sample)
    lists = rows.column("buckets").combine_chunks()
    return train(kept, lists.flatten().to_numpy(), lists.offsets.to_numpy(), rows.column("known").to_numpy(), marked / total)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents' columns and `column`, a score from 0 to 1 of every whole text; a column of that name is replaced.

    Null and empty texts count as texts without words; very long ones are scored whole; equal texts get equal scores.
    An empty table gives no rows.
    """
    docs = docs.drop(column)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        wanted = np.zeros(BUCKETS, bool)
        wanted[model.buckets] = True
        for batch in batches:
            for part, data, offsets in chunks(batch):
                row, bucket = features(data, offsets, wanted)
                scores = model.scores(row, bucket, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, column])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: all but the fifth held out by the checksum of the doc_id."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that do not score as toxic (0.5 or more), with their columns as they were."""
    (name,) = fresh(docs.columns, "toxicity_score")
    return score(docs, fit(docs, learnable(labels)), name).filter(F.col(name) < 0.5).drop(name)
