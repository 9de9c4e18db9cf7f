"""Removing long repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix array holds a batch's suffixes that start at anchors, in the order of their bytes. An anchor
is the position of the smallest hash among SPAN consecutive 8-byte strings, so equal strings of
LENGTH bytes have an anchor at the same place, less than SPAN bytes behind their start, with CORE equal
bytes from there on. These CORE bytes are what the array keeps of a suffix: order and common prefixes
are exact up to there, and no longer prefix is asked for.

The index is a list of levels, each a sorted array, of sizes 1, 2, 4... batches. A new batch is merged with
all levels in one sorted pass; neighbours with a common prefix of CORE bytes are matches. The batch then goes in
as a level of size 1, and levels of equal size become one, in the order of that same pass. Matches are then
extended to both sides, to whole strings, on the bytes around them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import Rolling, bitmap, chunks, discard, map_bits, mix, partitions, stage

#: Bytes of a repeated string that goes.
LENGTH = 400
#: 8-byte strings among which the one with the smallest hash is an anchor; all of them lie within a string.
SPAN = 305
#: Bytes from an anchor on that lie in every string that begins at most SPAN - 1 bytes before it.
CORE = LENGTH - SPAN + 1
#: Stands for a missing doc_id, which else is none.
NO_ID = -(1 << 63)
#: Bytes of text that a task works on at once.
SLICE = 1 << 18
#: Batches in which a table at hand is added to the index. Each addition reads the whole index once, so a bulk
#: load takes few; a batch is sorted by Spark and may be of any size.
BATCHES = 4
#: Surroundings of one core that a task compares at once; of a core with more, every string is a row of its own.
MOST_AROUND = 2048
#: Bits of a hash that decide between anchors, the rest are the place: the later of equal ones.
PLACE_BITS = 32


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` consecutive values (they are distinct), by block-wise running minima."""
    n = len(values) - span + 1
    if n <= 0:
        return values[:0]
    padded = np.concatenate([values, np.full(-len(values) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[span - 1 : span - 1 + n])


def eights(data: np.ndarray) -> np.ndarray:
    """The big-endian integer of the 8 bytes at each position that has them."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    wide = data.astype(np.uint64)
    pairs = wide[:-1] << np.uint64(8) | wide[1:]
    fours = pairs[:-2] << np.uint64(16) | pairs[2:]
    return fours[:-4] << np.uint64(32) | fours[4:]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first start, last start and anchor of each run of LENGTH-byte strings with one anchor.

    A string's anchor is the smallest of the SPAN hashes at its start, the later of equal ones; places count in `data`.
    """
    heads = eights(data)
    bits = np.uint64(PLACE_BITS)
    mixed = (heads * np.uint64(0x9E3779B97F4A7C15)) ^ (heads >> np.uint64(29))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    place = np.uint64((1 << PLACE_BITS) - 1) - np.arange(len(mixed), dtype=np.uint64)
    least = smallest((mixed >> bits << bits) | place, SPAN)
    at = ((1 << PLACE_BITS) - 1) - (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(at))
    inside = starts + LENGTH <= offsets[1:][doc_of[: len(at)]]
    starts, at, doc = starts[inside], at[inside], doc_of[: len(inside)][inside]
    if not len(starts):
        return doc, starts, starts, at
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], starts[first], starts[np.append(first[1:] - 1, len(starts) - 1)], at[first]


def binaries(rows: np.ndarray) -> pa.Array:
    """An Arrow array of the rows of a byte matrix."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def byte_rows(column: pa.Array) -> np.ndarray:
    """The CORE-byte values of an Arrow column as the rows of a byte matrix."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, CORE)


def cores(rows: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row; only brings together what may match."""
    start = np.arange(len(rows)) * CORE
    return Rolling(rows.ravel()).hashes(start, start + CORE).view(np.int64)


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each row but the first with the row before."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def suffixes(docs: DataFrame) -> DataFrame:
    """The suffix at each anchor of the texts."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch, limit=SLICE):
                anchor = anchors(data, offsets)[3]
                yield pa.RecordBatch.from_arrays([binaries(data[anchor[:, None] + np.arange(CORE)])], names=["suffix"])

    return docs.select("text").mapInArrow(entries, "suffix binary")


class SuffixIndex:
    """Levels of suffix arrays: (number of batches, table of suffix and n in the order of suffix).

    A level keeps one row for each suffix with the number of its places, so that a string that very
    many documents share is one entry.
    """

    def __init__(self, levels: list[tuple[int, DataFrame]] | None = None):
        self.levels = levels or []

    def add(self, entries: DataFrame) -> DataFrame:
        """Put a batch of suffixes in; the suffixes of the batch that now have more than one place, as a staged table."""
        batch = stage(entries.groupBy("suffix").agg(F.count("*").alias("n")), "batch")
        size, joined = 1, 0
        while joined < len(self.levels) and self.levels[-1 - joined][0] == size:
            size, joined = 2 * size, joined + 1
        arrays = [batch.withColumn("array", F.lit(0))]
        arrays += [level.withColumn("array", F.lit(1 if k < joined else 2)) for k, (_, level) in enumerate(reversed(self.levels))]
        # Array 0 is the batch, 1 what becomes one level with it, 2 what is only compared.
        together = reduce(DataFrame.unionByName, arrays)
        dealt = together.repartitionByRange(partitions(batch.sparkSession), "suffix").sortWithinPartitions("suffix", "array")
        passed = stage(dealt.mapInArrow(merge_scan, "suffix binary, n long, matched boolean, kept boolean"), "level")
        old = [level for _, level in self.levels[len(self.levels) - joined :]]
        matched = stage(passed.filter("matched").select("suffix"), "matches")
        self.levels = [*self.levels[: len(self.levels) - joined], (size, stage(passed.filter("kept").select("suffix", "n"), "level"))]
        discard(batch, passed, *old)
        return matched

    def save(self, folder: str) -> None:
        """Write all levels to a folder."""
        for k, (size, level) in enumerate(self.levels):
            level.write.option("compression", "zstd").parquet(f"{folder}/level={k}/batches={size}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "SuffixIndex":
        """The index in a folder, with levels of its own: the folder stays as it is."""
        stored = spark.read.parquet(folder)
        sizes = sorted(tuple(r) for r in stored.select("level", "batches").distinct().collect())
        return SuffixIndex([(size, stage(stored.filter(F.col("level") == k).select("suffix", "n"), "level")) for k, size in sizes])


def merge_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over merged arrays (suffix, n, array): neighbours with a common prefix of CORE bytes become one row.

    The row is `matched` if the batch (array 0) holds it and it has several places, `kept` if it belongs
    to the level that the batch goes into; n counts that level's places.
    """
    # The row in hand, which the next Arrow batch may add to: suffix, n there, n of all, whether in the batch, whether kept.
    held = None

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        suffix, own, every, new, kept = (np.concatenate(x) for x in zip(*parts))
        matched = new & (every > 1)
        wanted = matched | kept
        return pa.RecordBatch.from_arrays([binaries(suffix[wanted]), *(pa.array(x[wanted]) for x in (own, matched, kept))], names=["suffix", "n", "matched", "kept"])

    for batch in batches:
        if not batch.num_rows:
            continue
        suffix, n, array = byte_rows(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        first = np.flatnonzero(np.append(True, common_prefix(suffix) < CORE))
        own = np.add.reduceat(np.where(array < 2, n, 0), first)
        every = np.add.reduceat(n, first)
        new = np.logical_or.reduceat(array == 0, first)
        kept = np.logical_or.reduceat(array < 2, first)
        parts = [suffix[first].copy(), own, every, new, kept]
        if held is not None and (held[0][0] == parts[0][0]).all():
            for k, merge in ((1, np.add), (2, np.add), (3, np.logical_or), (4, np.logical_or)):
                parts[k][0] = merge(held[k][0], parts[k][0])
            held = None
        ready = [tuple(x[:-1] for x in parts)]
        if held is not None:
            ready.insert(0, held)
        held = tuple(x[-1:] for x in parts)
        yield rows(ready)
    if held is not None:
        yield rows([held])


ENTRY = "core long, whole binary, doc_id long, row_id long, low int, high int, anchor int"


def occurrences(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The places of the suffixes in `repeated` (and of few others, by a clash in a map).

    `low` and `high` are the first and the last start of the strings with this anchor, `whole` a
    128-bit digest of all bytes that they cover and of the anchor's place there.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cores(byte_rows(batch.column(0))) if batch.num_rows else [], pa.int64())], names=["core"])

    bits = map_bits(repeated.count())
    wanted = bitmap(repeated.mapInArrow(mark, "core long"), F.col("core"), bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, limit=SLICE):
                doc, low, high, anchor = anchors(data, offsets)
                core = Rolling(data).hashes(anchor, anchor + CORE).view(np.int64)
                own = wanted[core % bits]
                core, doc, low, high, anchor = (x[own] for x in (core, doc, low, high, anchor))
                raw = data.tobytes()
                whole = [hashlib.blake2b(raw[a : b + LENGTH], digest_size=16, salt=(c - a).to_bytes(4, "little")).digest() for a, b, c in zip(low.tolist(), high.tolist(), anchor.tolist())]
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core), pa.array(whole, pa.binary()), part.column(0).take(row), part.column(1).take(row), *(pa.array((x - offsets[doc]).astype(np.int32)) for x in (low, high, anchor))],
                    names=[x.split()[0] for x in ENTRY.split(", ")],
                )

    return docs.select("doc_id", "row_id", "text").mapInArrow(look, ENTRY)


def with_rows(docs: DataFrame, wanted: np.ndarray, there: bool = True) -> DataFrame:
    """The documents whose row_id is in a map (or, not `there`, the others), so that few texts are dealt out."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted[batch.column(batch.schema.get_field_index("row_id")).to_numpy() % len(wanted)] == there))

    return docs.mapInArrow(choose, docs.schema)


def row_map(marked: DataFrame) -> np.ndarray:
    """A map of the row_ids of a table."""
    return bitmap(marked, F.col("row_id"), map_bits(marked.select("row_id").distinct().count()))


AROUND = "core long, alone boolean, doc_id long, row_id long, low int, around binary"


def surroundings(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The bytes that the strings of each run in `kinds` cover."""
    runs = kinds.groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("core", "alone", "low", "high")).alias("runs"))
    asked = with_rows(docs, row_map(kinds)).join(runs, ["doc_id", "row_id"]).select("doc_id", "row_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, limit=SLICE):
                runs = part.column(3)
                flat = runs.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
                low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
                raw = data.tobytes()
                around = [raw[a:b] for a, b in zip((offsets[row] + low).tolist(), (offsets[row] + high + LENGTH).tolist())]
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0), flat.field(1), part.column(0).take(own), part.column(1).take(own), flat.field(2), pa.array(around, pa.binary())], names=[x.split()[0] for x in AROUND.split(", ")]
                )

    return asked.mapInArrow(cut, AROUND)


def repeated_starts(core: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each start in the surroundings: the number of these and whether its string is in others of the same core too.

    Equal hashes only propose partners; runs of starts with one partner are compared by their bytes.
    """
    sizes = np.array([len(x) for x in around])
    base, runs = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    raw = b"".join(around)
    owner = np.repeat(np.arange(len(around)), runs)
    place = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + base[owner]
    key = mix(Rolling(np.frombuffer(raw, np.uint8)).hashes(place, place + LENGTH) ^ core[owner].view(np.uint64))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    # The first of equal ones has the next for a partner.
    partner = np.where(first, np.minimum(np.arange(len(order)) + 1, len(order) - 1), head)
    twice = np.empty(len(order), bool)
    twice[order] = ~first | (np.append(ranked[1:] == ranked[:-1], False) if len(ranked) else first)
    shift = np.zeros(len(order), np.int64)
    shift[order] = place[order[partner]] - place[order]
    asked = np.flatnonzero(twice)
    new = np.append(True, (asked[1:] != asked[:-1] + 1) | (shift[asked[1:]] != shift[asked[:-1]]) | (owner[asked[1:]] != owner[asked[:-1]])) if len(asked) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    for x, y in zip(asked[starts].tolist(), asked[np.append(starts[1:] - 1, len(asked) - 1)].tolist() if len(asked) else []):
        a, b, d = int(place[x]), int(place[y]) + LENGTH, int(shift[x])
        if raw[a:b] != raw[a + d : b + d]:
            # Two strings of one hash: these starts are looked up among the strings themselves.
            for t in range(x, y + 1):
                mine = raw[place[t] : place[t] + LENGTH]
                same = np.flatnonzero(key == key[t])
                twice[t] = any(u != t and core[owner[u]] == core[owner[t]] and raw[place[u] : place[u] + LENGTH] == mine for u in same.tolist())
    return owner, twice


SPANS = "doc_id long, row_id long, low int, high int"


def extended(around: DataFrame) -> DataFrame:
    """The runs of starts (low to high) whose strings other surroundings of their core hold too; those not `alone` only serve as partners."""
    dealt = around.repartition(partitions(around.sparkSession), "core").sortWithinPartitions("core")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            owner, twice = repeated_starts(rows.column(0).to_numpy(), rows.column(5).to_pylist())
            offset = np.arange(len(owner)) - np.searchsorted(owner, owner)
            asked = np.flatnonzero(twice & rows.column(1).to_numpy()[owner])
            new = np.append(True, (asked[1:] != asked[:-1] + 1) | (owner[asked[1:]] != owner[asked[:-1]])) if len(asked) else np.zeros(0, bool)
            a = asked[new]
            b = asked[np.append(np.flatnonzero(new)[1:] - 1, len(asked) - 1)] if len(asked) else asked
            low = rows.column(4).to_numpy()[owner[a]]
            own = pa.array(owner[a])
            return pa.RecordBatch.from_arrays(
                [rows.column(2).take(own).combine_chunks(), rows.column(3).take(own).combine_chunks(), pa.array((low + offset[a]).astype(np.int32)), pa.array((low + offset[b]).astype(np.int32))],
                names=[x.split()[0] for x in SPANS.split(", ")],
            )

        # Whole cores, about SLICE bytes of them at once.
        kept: list[pa.RecordBatch] = []
        held, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            core = batch.column(0).to_numpy()
            begins = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
            for x, y in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
                if core[x] != last and held > 2 * SLICE:
                    yield runs(kept)
                    kept, held = [], 0
                last = core[x]
                kept.append(batch.slice(x, y - x))
                held += pa.compute.sum(pa.compute.binary_length(kept[-1].column(5))).as_py()
        if kept:
            yield runs(kept)

    return dealt.mapInArrow(extend, SPANS)


def string_digests(around: DataFrame) -> DataFrame:
    """(string, alone, doc_id, row_id, start): a 128-bit digest of every string of the surroundings."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(5)[k].as_py()
                n = len(text) - LENGTH + 1
                own = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(text[i : i + LENGTH], digest_size=16).digest() for i in range(n)], pa.binary()), *(batch.column(i).take(own) for i in (1, 2, 3)), pa.array((np.arange(n) + batch.column(4)[k].as_py()).astype(np.int32))],
                    names=["string", "alone", "doc_id", "row_id", "start"],
                )

    return around.mapInArrow(each, "string binary, alone boolean, doc_id long, row_id long, start int")


REMOVED = "doc_id long, row_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def repeated_runs(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, row_id, low, high), staged: the runs of starts whose strings start elsewhere too."""
    found = stage(occurrences(rows, repeated), "found")
    # A run whose every byte another run repeats is repeated throughout.
    place = ["doc_id", "row_id", "low", "high"]
    kinds = stage(found.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")), "kinds")
    marked = found.join(kinds.filter("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select(*place)
    # Where a core has several kinds of runs and one of them is alone, one of each kind is compared with the others.
    several = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1")
    open_kinds = stage(kinds.join(several, "core").select("core", (F.col("n") == 1).alias("alone"), "one.*", (F.col("kinds") > MOST_AROUND).alias("hot")), "open")
    around = surroundings(rows, open_kinds.filter("NOT hot"))
    parts = [marked, extended(around)]
    if not open_kinds.filter("hot").isEmpty():
        strings = stage(string_digests(surroundings(rows, open_kinds.filter("hot"))), "strings")
        again = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
        parts.append(strings.join(again, "string", "left_semi").filter("alone").select("doc_id", "row_id", F.col("start").alias("low"), F.col("start").alias("high")))
    out = stage(reduce(DataFrame.unionByName, parts), "covered")
    discard(found, kinds, open_kinds)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed and n_spans of every document.

    Each byte goes that a LENGTH-byte string covers which starts anywhere else too, in any document
    or in its own; strings never cross documents. Rows that repeat a doc_id are documents of their
    own. A null text is empty; short and empty texts stay whole; very long ones are taken whole.
    Other columns are not looked at. An empty table gives no rows.
    """
    # A row is known by its doc_id and a hash of both columns: rows equal in both get equal results.
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_id"), "text")
    index = SuffixIndex()
    matches = [index.add(suffixes(rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(BATCHES)) == k))) for k in range(BATCHES)]
    repeated = stage(reduce(DataFrame.unionByName, matches).distinct(), "repeated")
    discard(*matches, *(level for _, level in index.levels))
    covered = repeated_runs(rows, repeated)
    spans = covered.groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    some = row_map(covered)
    joined = with_rows(rows, some).join(spans, ["doc_id", "row_id"], "left").select("doc_id", "row_id", "text", "runs")
    whole = with_rows(rows, some, there=False).withColumn("runs", F.lit(None).cast("array<struct<low:int,high:int>>"))
    joined = joined.unionByName(whole.select(joined.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed, counts = [], [], [], []
            runs = batch.column(3)
            flat, at = runs.flatten(), runs.offsets.to_numpy()
            lows = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
            highs = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = at - at[0]
            for i, text in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
                text = text or b""
                a, b = at[i], at[i + 1]
                spans_, gone = 0, 0
                if b > a:
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, lows[a:b], 1)
                    np.add.at(edge, highs[a:b] + LENGTH, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    gone = int(covered.sum())
                    spans_ = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    total.append(len(text))
                    text = np.frombuffer(text, np.uint8)[~covered].tobytes()
                else:
                    total.append(len(text))
                kept.append(text), removed.append(gone), counts.append(spans_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())], names=[x.split()[0] for x in REMOVED.split(", ")])

    return joined.mapInArrow(cut, REMOVED).drop("row_id").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
