"""Token ids of public tokenizers over whole Arrow batches, with a bounded cache of words.

A text is cut before every blank and newline, and between a letter and a comma or full stop: where the tokenizer's own
pre-tokenizer cuts, so a piece gets the ids it has inside its text. The pieces of a batch are
found, hashed (64 bits) and told apart with numpy; only pieces that a worker has not met go
through the tokenizers library, many in one call. Texts with other white space, with two
blanks together, or with one of the vocabulary's special tokens go through the library whole.

Two of the million or so pieces that a worker knows have one hash with a chance of about 10^-8.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from leadloom.llm.common import Rolling

#: Pieces that a worker's cache holds at most; it is emptied when full.
CACHE_PIECES = 1_500_000
#: Pieces given to the tokenizers library in one call.
TOGETHER = 2000

_ENCODERS: dict = {}


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """The worker's encoder of a vocabulary file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Gives the ids that the tokenizers library gives with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content.encode().lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        known = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(known.values()) < 1 << 16 else "<u4")
        # A vocabulary that drops blanks gives no ids for them, and lower-cases all text.
        self.drops_blanks = not self.whole(" \n")
        self.begins = np.zeros(max(known.values()) + 1, bool)
        for token, k in known.items():
            self.begins[k] = token.startswith("Ġ")
        self.mark = self.whole("\x01" if self.drops_blanks else "\n")
        self.bytes_of: list[bytes] | None = None
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces, each with its blank or newline in front if it has one."""
        out: list = [None] * len(pieces)
        single = []
        groups: dict[str, list[int]] = {" ": [], "\n": [], "": []}
        texts = [p.decode("utf-8", "replace") for p in pieces]
        for i, text in enumerate(texts):
            if "\x01" in text or not text.strip(" \n"):
                single.append(i)
            else:
                groups["" if self.drops_blanks or text[0] not in " \n" else text[0]].append(i)
        for blank, members in groups.items():
            for k in range(0, len(members), TOGETHER):
                some = members[k : k + TOGETHER]
                if self.drops_blanks:
                    joined, skip = " \x01 ".join(texts[i] for i in some), 1
                else:
                    joined, skip = ("" if blank else "\n") + ("" if blank else "\n").join(texts[i] for i in some), 0 if blank else 1
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
                cuts = np.flatnonzero(self.begins[ids] if blank == " " else ids == self.mark[0])
                if self.drops_blanks:
                    cuts = np.concatenate([[-1], cuts])
                if len(cuts) != len(some):
                    single += some
                    continue
                for i, a, b in zip(some, (cuts + skip).tolist(), [*cuts[1:].tolist(), len(ids)]):
                    out[i] = ids[a:b]
        for i in single:
            out[i] = self.whole(texts[i])
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids = self._each(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if total:
            self.flat[self.used : self.used + total] = np.concatenate([np.asarray(x, np.int64) for x in ids])
        at = self.used + np.cumsum(size) - size
        self.used += total
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.hashes, hashes), (self.at, at), (self.size, size)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offsets[i]:offsets[i+1]], one after another, and the offsets of each text's ids."""
        n = len(offsets) - 1
        if len(self.hashes) > CACHE_PIECES:
            self._forget()
        odd, whole = np.zeros(n, bool), data
        low = data.tobytes().lower()
        for token in self.special:
            at = low.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = low.find(token, at + 1)
        if self.drops_blanks:
            data = np.frombuffer(low, np.uint8)
        blank = (data == 32) | (data == 10)
        begins = blank.copy()
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        # A full stop or comma behind a letter is no part of the word in either kind of vocabulary.
        letter = (data | 32) - np.uint8(97) < 26
        begins[1:] |= ((data[1:] == 44) | (data[1:] == 46)) & letter[:-1]
        if not self.drops_blanks:
            # Other white space (Unicode's begins with C2, E1, E2 or E3), blanks at an edge or side by side.
            strange = (((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))) & (data != 10)
            strange |= (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
            strange[1:] |= blank[1:] & blank[:-1]
            full = np.flatnonzero(offsets[:-1] < offsets[1:])
            strange[offsets[full]] |= blank[offsets[full]]
            strange[offsets[full + 1] - 1] |= blank[offsets[full + 1] - 1]
            odd[np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offsets, starts, "right") - 1
        if odd.any():
            plain = ~odd[doc]
            starts, ends, doc = starts[plain], ends[plain], doc[plain]
        if self.drops_blanks:
            starts = starts + blank[starts]
            kept = starts < ends
            starts, ends, doc = starts[kept], ends[kept], doc[kept]
        hashes = Rolling(data).hashes(starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != unique[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place = np.searchsorted(self.hashes, unique)
        size = self.size[place][back]
        at = self.at[place][back]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(at - before, size) + np.arange(int(size.sum()))] if len(size) else np.zeros(0, self.dtype)
        counts = np.bincount(doc, size, n).astype(np.int64)
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(counts)])
        parts, cut = [], np.concatenate([[0], np.cumsum(counts)])
        for i in range(n):
            if odd[i]:
                parts.append(np.array(self.whole(whole[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")), self.dtype))
                counts[i] = len(parts[-1])
            else:
                parts.append(ids[cut[i] : cut[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids of a byte-level vocabulary, exactly as it was encoded."""
        if self.bytes_of is None:
            # Printable Latin-1 characters stand for their bytes, further code points for the other bytes in order.
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            codes = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
            known = self.tokenizer.get_vocab()
            self.bytes_of = [b""] * (max(known.values()) + 1)
            for token, k in known.items():
                self.bytes_of[k] = bytes(codes[c] for c in token) if all(c in codes for c in token) else token.encode()
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode()

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null as empty."""
        raw = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        ids, cut = self.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
