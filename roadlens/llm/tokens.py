"""Exact token ids by pre-tokens, with bounded tables in each Python worker.

The tokenizer lower-cases, drops white space and splits texts into runs of letters, single
digits and runs of other characters before it merges; nothing it does reaches across these
borders.  So the ids of a text are the ids of its pre-tokens in order, and a pre-token that
was encoded once need not be encoded again.

Plain texts (printable ASCII and Latin-1 letters, no apostrophe and no ``<``) are split here
by the same rule, many texts at a time, and their pre-tokens are looked up by a 64-bit hash.
In any other text only ASCII spaces, tabs and line breaks are taken as borders, and each piece
between them, special strings included, is left to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from roadlens.llm.common import word_hashes

BLOCK = 1 << 20          # characters of an odd text that are split at a time
LONG = 8 << 20           # bytes of one text from which on it is taken in parts
SLOTS = 1 << 21          # of the hash table; at most half of them are filled
PIECES = 100_000         # pieces of odd texts that a worker remembers

_SPACES = str.maketrans("\n\t\r", "   ")
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 13, 32]] = SPACE
_KIND[97:123] = _KIND[128:] = LETTER
_KIND[48:58] = DIGIT
_CUT = np.zeros(256, bool)
_CUT[[10, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[192:] = True
_ODD[[39, 60, 127]] = True
_ODD[[9, 10, 13, 0xC3]] = False


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # tasks are the unit of parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def blocks(text: str) -> Iterator[str]:
    """The text cut at ASCII white space into blocks of about BLOCK characters."""
    n, lo = len(text), 0
    while lo < n:
        hi = n
        if lo + BLOCK < n:
            cuts = [at for at in (text.find(c, lo + BLOCK) for c in " \n") if at >= 0]
            hi = min(cuts, default=n)
        yield text[lo:hi]
        lo = hi


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(folded bytes, starts, ends, row of each pre-token, odd rows); odd rows have no pre-tokens here."""
    x = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    second = data[after]
    upper = after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    x[upper] += 32
    odd_at = np.r_[np.flatnonzero(_ODD[data]), after[(second == 0x97) | (second == 0xB7)]]
    odd = np.unique(np.searchsorted(offsets, odd_at, side="right") - 1)
    kind = _KIND[x]
    for i in odd.tolist():
        kind[offsets[i]:offsets[i + 1]] = SPACE
    border = np.empty(len(x) + 1, bool)
    border[0] = border[-1] = True
    border[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    border[offsets] = True
    edges = np.flatnonzero(border)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != SPACE if len(x) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    return x, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, odd


def cut_at_spaces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bytes of a text in parts of about ``size``, cut before an ASCII space or line break."""
    lo = 0
    while lo < len(data):
        hi = len(data)
        for at in range(lo + size, len(data), size):
            found = np.flatnonzero(_CUT[data[at:at + size]])
            if len(found):
                hi = at + int(found[0])
                break
        yield data[lo:hi]
        lo = hi


class HashTable:
    """64-bit hash -> (start, length) of ids in a pool; open addressing, looked up many at a time."""

    def __init__(self, slots: int = SLOTS):
        self.mask, self.shift = slots - 1, np.uint64(64 - slots.bit_length() + 1)
        self.key, self.start, self.length = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.filled = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not in the table."""
        slot = (h >> self.shift).astype(np.int64)
        found = np.where(self.key[slot] == h, slot, -1)
        open_ = np.flatnonzero((found < 0) & (self.key[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.key[slot[open_]]
            hit = at == h[open_]
            found[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (at != 0)]
        return found

    def add(self, h: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """New distinct hashes."""
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)      # one for each slot
            put = free[one]
            self.key[slot[put]], self.start[slot[put]], self.length[slot[put]] = h[put], start[put], length[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask
        self.filled += len(h)


class Encoder:
    """Ids of texts, many at a time.  ``frequent``: (hash, number of ids) of pre-tokens whose ids are never
    asked for; with it the encoder only counts."""

    def __init__(self, tokenizer_path: str, frequent: tuple[np.ndarray, np.ndarray] | None = None, slots: int = SLOTS):
        self.tokenizer, self.slots, self.frequent = load_tokenizer(tokenizer_path), slots, frequent
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {"": b""}
        self.forget()

    def forget(self) -> None:
        self.table, self.pool, self.used = HashTable(self.slots), np.zeros(1 << 16, np.uint32), 0
        if self.frequent is not None and len(self.frequent[0]):
            self.table.add(self.frequent[0], np.full(len(self.frequent[0]), -1), self.frequent[1])

    def encoded(self, pieces: list[str], single: bool) -> list[np.ndarray]:
        """Ids of each piece; ``single``: each is one pre-token, which shows in its one word-end id."""
        out: list[np.ndarray] = []
        for lo in range(0, len(pieces), 256):
            part = pieces[lo:lo + 256]
            if single:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part):
                    out += np.split(ids, cuts[:-1])
                    continue
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def slots_of(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = np.maximum(word_hashes(x, starts, ends), np.uint64(1))
        slot = self.table.find(h)
        missing = np.flatnonzero(slot < 0)
        if not len(missing):
            return slot
        new, first = np.unique(h[missing], return_index=True)
        if self.table.filled + len(new) > self.slots // 2:
            self.forget()                        # all but the frequent ones; this batch is learnt again
            missing = np.flatnonzero(self.table.find(h) < 0)
            new, first = np.unique(h[missing], return_index=True)
            if len(new) > self.slots // 4:
                self.slots *= 4
                self.forget()
        at = missing[first]
        ids = self.encoded([x[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())], True)
        length = np.array([len(i) for i in ids], np.int64)
        start = np.full(len(ids), -1, np.int64)
        if self.frequent is None:
            flat = np.concatenate(ids)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.used:self.used + len(flat)] = flat
            start = self.used + np.cumsum(length) - length
            self.used += len(flat)
        self.table.add(new, start, length)
        return self.table.find(h)

    def odd_text(self, text: str) -> bytes:
        """Ids of any text, by white-space pieces."""
        out = []
        for block in blocks(text):
            parts = block.translate(_SPACES).split(" ")
            if len(self.pieces) > PIECES:
                self.pieces = {"": b""}
            new = list({p for p in parts if p not in self.pieces})
            for p, ids in zip(new, self.encoded(new, False)):
                self.pieces[p] = ids.astype("<u4").tobytes()
            out += [self.pieces[p] for p in parts]
        return b"".join(out)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each row."""
        if len(offsets) == 2 and len(data) > LONG:
            return np.array([sum(int(self._counts(p, np.array([0, len(p)]))[0]) for p in cut_at_spaces(data, LONG // 2))])
        return self._counts(data, offsets)

    def _counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, starts, ends, row, odd = pre_tokens(data, offsets)
        slot = self.slots_of(x, starts, ends)        # before the table is read: it may be a new one
        n = np.bincount(row, self.table.length[slot], minlength=len(offsets) - 1).astype(np.int64)
        for i in odd.tolist():
            n[i] = len(self.odd_text(data[offsets[i]:offsets[i + 1]].tobytes().decode())) // 4
        return n

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each row as little-endian unsigned 32-bit numbers."""
        if len(offsets) == 2 and len(data) > LONG:
            return [b"".join(self._ids(p, np.array([0, len(p)]))[0] for p in cut_at_spaces(data, LONG // 2))]
        return self._ids(data, offsets)

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        x, starts, ends, row, odd = pre_tokens(data, offsets)
        rows = len(offsets) - 1
        flat, upto = np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if len(starts):
            slot = self.slots_of(x, starts, ends)
            length = self.table.length[slot]
            total = np.cumsum(length)
            flat = self.pool[np.arange(total[-1]) + np.repeat(self.table.start[slot] - (total - length), length)]
            upto[1:] = np.cumsum(np.bincount(row, length, minlength=rows)).astype(np.int64)
        raw = memoryview(flat.astype("<u4").tobytes())
        out: list = [raw[4 * a:4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        for i in odd.tolist():
            out[i] = self.odd_text(data[offsets[i]:offsets[i + 1]].tobytes().decode())
        return out
