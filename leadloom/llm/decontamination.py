"""Finding training documents that hold benchmark items: BM25 with block-max WAND, then an overlap check.

An inverted index over the test items has weights BM25(term, item) / BM25(item, item), so that a
passage with all terms of an item scores 1 whatever its length. Every training passage is a query.
Passages are windows of 2 * reach words, one beginning each `reach` words, so every run of
`reach` words lies in one; items are indexed by their length's power of two, which is the reach.
Statistics of terms and lengths are those of all items, in whatever index these are.

All passages of a slice of text move through the index together, each by its own pivots. A passage's cursors
stand on blocks of items; in the order of these blocks the terms' largest weights are summed until the
threshold can be reached: that cursor's block is the pivot, and all cursors before it jump there. The block
is looked into if the block maxima of the terms that stand on it reach the threshold too. An item's
lightest terms, which together weigh less than half the threshold, have no cursors but
count with every bound. Items that remain are scored in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import Rolling, chunks, fresh, stage

#: BM25's term saturation and length share.
K1, B = 1.2, 0.75
#: Part of an item's own score that a passage must reach.
THRESHOLD = 0.5
#: Items of a block of postings.
BLOCK = 64
#: Bytes of items' texts in the indexes that one pass over the documents has at hand (what is broadcast at once is some
#: four times as much); an item counts for ITEM_BYTES more. Larger benchmarks take more passes.
SHARD_BYTES, ITEM_BYTES = 8 << 20, 64
#: Words of the shortest reach.
LEAST_REACH = 64
#: Words of a shingle for the question's overlap, least words of an answer, and what parts must be found.
SHINGLE, ANSWER_WORDS = 3, 5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.6

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each word of lower-cased text: a run of letters, digits or non-ASCII bytes."""
    word = (data >= 128) | (data - np.uint8(97) < 26) | (data - np.uint8(48) < 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    last = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    return np.searchsorted(offsets, first, "right") - 1, Rolling(data).hashes(first, last)


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-cased texts: items and documents alike go through this one function."""
    return pc.utf8_lower(texts)


def text_words(text: str) -> np.ndarray:
    raw = np.frombuffer(lowered(pa.array([text]))[0].as_py().encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[1]


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and of its answer: the last sentences that have ANSWER_WORDS words.

    Without a sentence break that leaves a question, the last quarter is the answer.
    """
    whole = text_words(text)
    for cut in reversed([m.end() for m in _SENTENCE.finditer(text)]):
        n = len(text_words(text[cut:]))
        if ANSWER_WORDS <= n <= len(whole) // 2:
            return whole[: len(whole) - n], whole[len(whole) - n :]
    n = min(len(whole), max(1, len(whole) // 4))
    return whole[: len(whole) - n], whole[len(whole) - n :]


def shingles(hashes: np.ndarray) -> set:
    size = min(SHINGLE, len(hashes))
    return {tuple(hashes[i : i + size].tolist()) for i in range(len(hashes) - size + 1)} if size else set()


def overlap(hashes: np.ndarray, question: np.ndarray, answer: np.ndarray) -> tuple[float, float]:
    """Parts of the question's shingles and of the answer's distinct words that a run of words holds; an empty part is found."""
    wanted = shingles(question)
    size = min(SHINGLE, len(question))
    there = {tuple(hashes[i : i + size].tolist()) for i in range(len(hashes) - size + 1)} if wanted else set()
    own = set(answer.tolist())
    return (len(wanted & there) / len(wanted) if wanted else 1.0), (len(own & set(hashes.tolist())) / len(own) if own else 1.0)


@dataclass
class Index:
    """An inverted index over items of one reach; items count from 0 in order of their ids."""

    reach: int
    item_ids: list
    parts: list  # (question, answer) of each item
    terms: np.ndarray  # distinct term hashes, ascending
    item_at: np.ndarray  # where each item's terms begin in item_terms, item_weights
    item_terms: np.ndarray
    item_weights: np.ndarray
    list_at: np.ndarray  # where each term's followed postings begin in list_items, list_weights
    list_items: np.ndarray
    list_weights: np.ndarray
    block_at: np.ndarray  # where each term's blocks begin in block_ids, block_max
    block_ids: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray  # largest weight of each term's followed postings
    rest: np.ndarray  # weight of the terms that open no candidates, of each item and of each block at most
    block_rest: np.ndarray


@dataclass
class Statistics:
    """Of all items: how many, their mean length, and for some term hashes, ascending, in how many items they are."""

    items: int
    mean_length: float
    terms: np.ndarray
    df: np.ndarray


def build(items: list[tuple[int, str]], reach: int, known: Statistics) -> Index:
    """The index of items with a word, by statistics that know all their terms."""
    hashes = [text_words(text) for _, text in items]
    lengths = np.array([len(h) for h in hashes], float)
    owner = np.repeat(np.arange(len(items)), lengths.astype(int))
    terms, term = np.unique(np.concatenate(hashes), return_inverse=True)
    pairs, tf = np.unique(owner * len(terms) + term, return_counts=True)
    item, term = pairs // len(terms), pairs % len(terms)
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / known.mean_length))
    weight /= np.bincount(item, weight)[item]
    # Lightest terms of each item whose weights sum to less than half the threshold.
    order = np.lexsort((weight, item))
    start = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(items)))])
    running = np.cumsum(weight[order])
    before = np.concatenate([[0], running])[start[:-1]]
    light = np.zeros(len(item), bool)
    light[order] = running - before[item[order]] < THRESHOLD / 2
    rest = np.bincount(item[light], weight[light], len(items))
    kept = np.flatnonzero(~light)
    kept = kept[np.lexsort((item[kept], term[kept]))]
    list_at = np.concatenate([[0], np.cumsum(np.bincount(term[kept], minlength=len(terms)))])
    block = item[kept] // BLOCK
    blocks = -(-len(items) // BLOCK)
    key, first = np.unique(term[kept] * blocks + block, return_index=True)
    block_max = np.maximum.reduceat(weight[kept], first)
    block_at = np.searchsorted(key, np.arange(len(terms) + 1) * blocks)
    block_rest = np.maximum.reduceat(rest, np.arange(0, len(items), BLOCK))
    term_max = np.zeros(len(terms))
    np.maximum.at(term_max, term[kept], weight[kept])
    return Index(reach, [i for i, _ in items], [question_and_answer(t) for _, t in items], terms, start, term, weight, list_at, item[kept], weight[kept], block_at, key % blocks, block_max, term_max, rest, block_rest)


def term_counts(items: DataFrame) -> DataFrame:
    """(item_id, n_words, terms): the words of each item, and its distinct term hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([np.unique(x).view(np.int64) for x in found], pa.list_(pa.int64()))], names=["item_id", "n_words", "terms"])

    return items.mapInArrow(each, "item_id long, n_words long, terms array<long>")


def indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Indexes over all items with a word, those of about SHARD_BYTES of items at a time; null ids and texts make no item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + ITEM_BYTES)).first()[0]
    if not size:
        return
    counted = stage(term_counts(rows).filter("n_words > 0"), "items")
    n, mean = counted.agg(F.count("*"), F.avg("n_words")).first()
    df = stage(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    shards = -(-size // SHARD_BYTES)
    for k in range(shards):
        # Dealt by hash: their number grows as the items do, so a shard stays of one size.
        own = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k
        shard = rows.filter(own).collect()
        terms = counted.filter(own).select(F.explode("terms").alias("term")).distinct().join(df, "term").toArrow()
        hashes = terms.column("term").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        known = Statistics(n, mean or 1.0, hashes[order], terms.column("df").to_numpy()[order])
        by_reach: dict[int, list] = {}
        for item, text in sorted(map(tuple, shard)):
            words_ = len(text_words(text))
            if words_:
                by_reach.setdefault(max(LEAST_REACH, 1 << (words_ - 1).bit_length()), []).append((item, text))
        yield [build(items, reach, known) for reach, items in sorted(by_reach.items())]


def spread(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, the places of its run at[key]:at[key + 1]; with the number of the key they belong to."""
    sizes = at[keys + 1] - at[keys]
    who = np.repeat(np.arange(len(keys)), sizes)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[keys][who]


def pivots(index: Index, window: np.ndarray, term: np.ndarray) -> np.ndarray:
    """window * blocks + block, ascending, of the blocks that may hold an item at the threshold, from distinct (window, term) pairs."""
    blocks, out = len(index.block_rest), []
    # All postings' blocks in one ascending array: a cursor is a place there.
    ends = index.block_at[1:]
    every = np.repeat(np.arange(len(ends)), np.diff(index.block_at)) * blocks + index.block_ids
    least, most_rest = THRESHOLD - 1e-9, index.block_rest.max()
    cursor = index.block_at[term]
    alive = cursor < ends[term]
    while alive.any():
        window, term, cursor = window[alive], term[alive], cursor[alive]
        block = index.block_ids[cursor]
        order = np.lexsort((block, window))
        window, term, cursor, block = window[order], term[order], cursor[order], block[order]
        begins = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        sums = np.cumsum(index.term_max[term])
        own = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(window))))
        reached = sums - (sums[begins] - index.term_max[term[begins]])[own] + most_rest >= least
        # The pivot of each passage: its first cursor at which the threshold can be reached; without one it is done.
        at = np.minimum.reduceat(np.where(reached, np.arange(len(window)), len(window)), begins)
        goes_on = at < len(window)
        pivot = block[np.minimum(at, len(window) - 1)][own]
        alive = goes_on[own]
        window, term, cursor, block, pivot = window[alive], term[alive], cursor[alive], block[alive], pivot[alive]
        behind = block < pivot
        cursor[behind] = np.searchsorted(every, term[behind] * blocks + pivot[behind])
        there = cursor < ends[term]
        window, term, cursor, pivot = window[there], term[there], cursor[there], pivot[there]
        on = index.block_ids[cursor] == pivot
        key, back = np.unique(window[on] * blocks + pivot[on], return_inverse=True)
        bound = np.bincount(back, index.block_max[cursor[on]], len(key)) + index.block_rest[key % blocks]
        out.append(key[bound >= least])
        cursor = cursor + on
        alive = cursor < ends[term]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def retrieve(index: Index, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) of all that reach the threshold, from distinct (window, term) pairs in order."""
    blocks = len(index.block_rest)
    live = pivots(index, window, term)
    if not len(live):
        return live, live, np.zeros(0)
    who, place = spread(index.list_at, term)
    own = window[who] * blocks + index.list_items[place] // BLOCK
    at = np.minimum(np.searchsorted(live, own), len(live) - 1)
    inside = live[at] == own
    who, place = who[inside], place[inside]
    n = len(index.item_ids)
    key, back = np.unique(window[who] * n + index.list_items[place], return_inverse=True)
    most = np.bincount(back, index.list_weights[place], len(key)) + index.rest[key % n]
    key = key[most >= THRESHOLD - 1e-9]
    # In full: an item's terms that the window has.
    who, place = spread(index.item_at, key % n)
    have = window * len(index.terms) + term
    asked = (key // n)[who] * len(index.terms) + index.item_terms[place]
    found = have[np.minimum(np.searchsorted(have, asked), len(have) - 1)] == asked if len(have) else np.zeros(len(asked), bool)
    score = np.bincount(who, np.where(found, index.item_weights[place], 0), len(key))
    good = score >= THRESHOLD
    return key[good] // n, key[good] % n, score[good]


def matches(index: Index, row: np.ndarray, hashes: np.ndarray, n: int) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item number) of the items that the passages of n rows of words hold: best score, question and answer overlap."""
    place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[place] == hashes)
    if not len(hit):
        return {}
    first = np.searchsorted(row, np.arange(n + 1))
    # Steps of `reach` words within each row; window k covers steps k and k + 1.
    base = np.concatenate([[0], np.cumsum((first[1:] - first[:-1]) // index.reach + 2)])
    step = base[row[hit]] + (hit - first[row[hit]]) // index.reach + 1
    keys = np.unique(np.concatenate([step, step - 1]) * len(index.terms) + np.tile(place[hit], 2))
    window, item, score = retrieve(index, keys // len(index.terms), keys % len(index.terms))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for w, i, s in zip(window.tolist(), item.tolist(), score.tolist()):
        r = int(np.searchsorted(base, w, "right")) - 1
        k = first[r] + (w - base[r] - 1) * index.reach
        run = hashes[max(first[r], k) : min(first[r + 1], k + 2 * index.reach)]
        question, answer = overlap(run, *index.parts[i])
        if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP:
            found[r, i] = max(found.get((r, i), (0.0, 0.0, 0.0)), (s, question, answer))
    return found


LEAKS = T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("score", "question_overlap", "answer_overlap"))])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row (doc_id, item_id, score, question_overlap, answer_overlap) for each item that a document's text holds.

    Every passage of every whole text is a query. The score is the best passage's; ties of scores go to the
    larger overlaps. Null and empty texts hold nothing; rows that repeat a doc_id are judged each by itself; items
    that repeat an item_id are items of their own. Other columns are not looked at. Without items, or without
    documents, there are no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *LEAKS.fields])
    context, out = docs.sparkSession.sparkContext, None
    for some in indexes(benchmark):
        # Of about SHARD_BYTES of items.
        held = context.broadcast(some)

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.set_column(1, "text", lowered(batch.column(1)))
                for part, data, offsets in chunks(batch):
                    row, hashes = words(data, offsets)
                    for index in held.value:
                        found = matches(index, row, hashes, part.num_rows)
                        if found:
                            rows = [r for r, _ in found]
                            yield pa.RecordBatch.from_arrays(
                                [part.column(0).take(pa.array(rows)), pa.array([index.item_ids[i] for _, i in found], pa.int64()), *(pa.array(x, pa.float64()) for x in zip(*found.values()))],
                                names=schema.names,
                            )

        part = docs.select("doc_id", "text").mapInArrow(look, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their columns as they were, whose doc_id has no leak; a null doc_id stays only if no such row leaks."""
    (leaking,) = fresh(docs.columns, "leaking")
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias(leaking)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[leaking]), "left_anti")
