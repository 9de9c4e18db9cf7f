"""SentencePiece ids of whole texts for merge-type vocabularies, by an agenda of adjacent symbol pairs, and back.

A text is its characters with a mark for each blank and one mark in front. Every two neighbouring symbols whose
join is a piece stand on an agenda; the pair of highest score, the leftmost of equals, is joined, and the pairs that
the new symbol makes go on the agenda. What is a piece in the end has its id, other characters the ids of their bytes.

No pair spans two neighbouring characters that no piece has side by side, so a text falls into words there which
the agenda treats one by one. The words of an Arrow batch are found, hashed (64 bits) and told apart with numpy, and
only words that a worker has not met go on an agenda. All of these are checked against the sentencepiece library,
many in one call, and so is the first text of every batch as a whole; a difference stops the job.

Two of the million or so words that a worker knows have one hash with a chance of about 10^-7.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadloom.llm.common import Rolling, bound_batches, chunks

#: The vocabularies' mark of a blank.
BLANK = "▁"
#: Words, and ids of words, that a worker's cache holds at most; it is emptied when full.
CACHE_WORDS, CACHE_IDS = 1_500_000, 1 << 24
#: Characters of a text that is checked as a whole at most: what is longer is checked by its words.
CHECKED_CHARS = 1 << 16

#: Ids that are decoded in one call at most.
DECODED = 1 << 18

_MODELS: dict = {}


def model(path: str) -> "Pieces":
    """The worker's encoder of a model file, made once per process."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


class Pieces:
    """Ids as the library gives them without begin and end ids: of models of the merge type with byte pieces that leave texts as they are."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        if self.library.normalize("ﬁ  x ") != f"{BLANK}ﬁ{BLANK}{BLANK}x{BLANK}":
            raise ValueError(f"{path}: only models that change no character of a text but blanks, and put one in front, are supported")
        size = self.library.get_piece_size()
        kinds = [(self.library.id_to_piece(i), i) for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i))]
        self.bytes = {int(piece[1:-1], 16): i for piece, i in kinds if self.library.is_byte(i)}
        if len(self.bytes) != 256 or any(self.library.is_unused(i) for i in range(size)):
            raise ValueError(f"{path}: only models with a piece for every byte, and without unused pieces, are supported")
        self.ids = {piece: i for piece, i in kinds if not self.library.is_byte(i)}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # Whether some piece has a byte of one kind directly before a byte of another; all bytes beyond ASCII are one kind.
        side = np.zeros((129, 129), bool)
        side[128, 128] = True
        for piece in self.ids:
            codes = [min(ord(" " if c == BLANK else c), 128) for c in piece]
            side[codes[:-1], codes[1:]] = True
        kind = np.minimum(np.arange(256), 128)
        self.side_by_side = side[kind][:, kind]
        self.newline_apart = not side[10].any() and not side[:, 10].any()
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def merged(self, word: str) -> list[int]:
        """Ids of a word, in which marks stand for blanks, by the agenda."""
        symbols, scores = list(word), self.scores
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        joins = [a + b for a, b in zip(symbols, symbols[1:])]
        agenda = [(-scores[joined], i, i + 1, joined) for i, joined in enumerate(joins) if joined in scores]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            # A pair of which one symbol has gone into another since is no pair any more; symbols that are gone are empty.
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(joined):
                continue
            symbols[left], symbols[right] = joined, ""
            last, following = before[left], after[right]
            after[left] = following
            if following < n:
                before[following] = left
                pair = joined + symbols[following]
                if pair in scores:
                    heapq.heappush(agenda, (-scores[pair], left, following, pair))
            if last >= 0:
                pair = symbols[last] + joined
                if pair in scores:
                    heapq.heappush(agenda, (-scores[pair], last, left, pair))
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.ids.get(symbol)
                out.extend([known] if known is not None else [self.bytes[b] for b in symbol.encode()])
        return out

    def check(self, words: list[str], found: list[list[int]]) -> None:
        """Stop if the library gives other ids. It puts a mark in front of what it is given: a word without one goes behind a newline."""
        if not self.newline_apart:
            words, found = [w for w in words if w[0] == BLANK], [f for w, f in zip(words, found) if w[0] == BLANK]
        given = self.library.encode([w[1:] if w[0] == BLANK and len(w) > 1 else f"\n{w}" for w in words], num_threads=1)
        for word, own, ids in zip(words, found, given):
            if (ids if word[0] == BLANK and len(word) > 1 else ids[2:]) != own:
                raise RuntimeError(f"ids of {word!r} are {own}; the library gives {ids}")

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [self.merged(w) for w in words]
        self.check(words, found)
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), np.int64, total)
        where = np.searchsorted(self.hashes, hashes)
        at = self.used + np.cumsum(size) - size
        self.used += total
        self.hashes, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.hashes, hashes), (self.at, at), (self.size, size)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offsets[i]:offsets[i+1]], each with a blank in front unless empty; and the offsets of each text's ids."""
        n = len(offsets) - 1
        if len(self.hashes) > CACHE_WORDS or self.used > CACHE_IDS:
            self._forget()
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        begins = np.ones(len(data), bool)
        begins[1:] = ~self.side_by_side[data[:-1], data[1:]]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        text = np.searchsorted(offsets, starts, "right") - 1
        unique, first, back = np.unique(Rolling(data).hashes(starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != unique[inside]
        if new.any():
            raw, of = data.tobytes(), first[new]
            self._learn(unique[new], [raw[a:b].decode().replace(" ", BLANK) for a, b in zip(starts[of].tolist(), ends[of].tolist())])
            place = np.searchsorted(self.hashes, unique)
        size, at = self.size[place][back], self.at[place][back]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(at - before, size) + np.arange(int(size.sum()))]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(text, size, n).astype(np.int64))])


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name.lower() != name.lower()), T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, c in enumerate(batch.schema.names) if c.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], names=[*(batch.schema.names[i] for i in kept), name])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The rows with a column `ids`, array of int: the ids of the whole text, without begin and end ids.

    Null and empty texts have no ids. Texts of any length are taken whole. Rows that repeat stay as they are, each
    by itself, and so do nulls in other columns; a column that is called ids already is replaced. An empty table
    stays empty. `path` names a model file that all executors have.
    """
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null("")
            # The mark of a blank is the same as a blank.
            marked = pc.replace_substring(text, BLANK, " ")
            marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), marked, pa.scalar("", pa.large_string())))
            only, done = pa.RecordBatch.from_arrays([marked], names=["text"]), 0
            for part, data, offsets in chunks(only):
                ids, cut = pieces.encode(data, offsets)
                if not done and len(data) and offsets[1] <= CHECKED_CHARS:
                    given = pieces.library.encode(text[0].as_py())
                    if given != ids[: cut[1]].tolist():
                        raise RuntimeError("the ids of a text differ from the library's")
                yield _put(batch.slice(done, part.num_rows), "ids", pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
                done += part.num_rows

    return docs.mapInArrow(each, _with(docs.schema, "ids", T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """The rows with a text column `name`: what the library decodes from the column `ids`. Null ids give an empty text."""
    bound_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("ids"))
            ends = np.cumsum(held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # Some rows at a time, so that few ids are Python objects at once; one longer row goes by itself.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED, "right")))
                texts = pieces.library.decode([x or [] for x in held.slice(at, to - at).to_pylist()], num_threads=1)
                yield _put(batch.slice(at, to - at), name, pa.array(texts, pa.string()))
                at = to

    return rows.mapInArrow(each, _with(rows.schema, name, T.StringType()))
