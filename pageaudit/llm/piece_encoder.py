"""Encoding by the tokenizers library, each distinct piece of text once.

A text is cut where the tokenizer's own pre-tokenizer cuts in any case: between something that is not
white space and white space, and between a letter (ASCII or Latin-1) and ASCII punctuation. The ids of a text are the
ids of its pieces, one after the other. Pieces repeat, so most are found in a bounded memory, by their
64-bit hashes (two of the pieces in memory fall together with a chance of one in ten million).
"""

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pageaudit.llm import textbatch as tb

#: Slots of a generation of a worker's memory (filled by half at most) and ids in it, before the next one begins; pieces given to the library at once.
SLOTS, MEMORY_IDS, PIECES_AT_ONCE = 1 << 19, 3_000_000, 4_000
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted positions at which pieces start; every row that has bytes starts one.

    Before ASCII white space the byte must be ASCII other than white space, or end a two-byte
    character other than U+0080 to U+00BF (which hold white space); elsewhere nothing is cut.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = tb.SEPARATOR[data]
    solid = (data < 0x80) & ~space
    solid[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    cut = np.zeros(n + 1, bool)
    letter = LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # U+00C0 to U+00FF but two signs
    cut[1:n] = (solid[:-1] & space[1:]) | (letter[:-1] & PUNCTUATION[data[1:]])
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Memory:
    """The ids of pieces by their hashes: open addressing, ids one after the other."""

    def __init__(self):
        self.hashes, self.start, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used, self.count = np.zeros(1 << 16, np.int32), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        held = self.hashes[slot]
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            now = self.hashes[slot[open_]]
            open_ = open_[(now != hashes[open_]) & (now != 0)]
        return np.where(self.hashes[slot] == hashes, slot, -1)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Takes a slot for each of the new, distinct hashes."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.hashes[slot[left]] == 0]
            self.hashes[slot[free]] = hashes[free]
            left = left[self.hashes[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return slot

    def add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(flat), np.int32)])
        slots = self.place(hashes)
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[slots], self.size[slots] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(flat), self.count + len(hashes)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[slots].astype(np.int64)
        return tb.gather(self.flat, self.start[slots].astype(np.int64), sizes), sizes

    def full(self, more: int) -> bool:
        return self.count + more > SLOTS // 2 or self.used > MEMORY_IDS


class PieceEncoder:
    """``library(list of str)`` gives the ids of each piece.

    Two generations of pieces are kept: what is found in the old one moves to the young one, and when that is full it becomes the old one.
    So frequent pieces are learnt once. ``marks``: strings that the tokenizer takes out of a text first; texts that hold one are not cut.
    ``bare``: the tokenizer gives no ids for white space and lowers A-Z, so pieces go without and in lower case.
    """

    def __init__(self, library, marks=(), bare: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.marks, self.bare = library, marks, bare
        self.young, self.old = Memory(), None

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        for k in range(0, len(pieces), PIECES_AT_ONCE):
            ids = self.library(pieces[k : k + PIECES_AT_ONCE])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.young.add(hashes[k : k + PIECES_AT_ONCE], np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes)

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the pieces, their starts and ends there, and the first piece of each row, with the total last."""
        data, offsets = tb.buffers(texts)
        at, whole = cuts(data, offsets), None
        for mark in self.marks:
            held = pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
            whole = held if whole is None else whole | held
        if whole is not None and whole.any():
            row = np.searchsorted(offsets, at, "right") - 1
            at = at[~whole[row] | (at == offsets[row])]
        first, edges = np.searchsorted(at, offsets), np.append(at, len(data))
        if self.bare and len(at):
            solid = ~tb.SEPARATOR[data]
            seen = np.cumsum(solid, dtype=np.int32)
            before = np.concatenate([np.zeros(1, np.int32), seen])[edges]
            kept = solid
            if (inner := ~solid & (seen > np.repeat(before[:-1], np.diff(edges)))).any():
                kept = solid | inner  # all but the white space that a piece starts with
                seen = np.cumsum(kept, dtype=np.int32)
                before = np.concatenate([np.zeros(1, np.int32), seen])[edges]
            lowered = tb.ASCII_LOWER[data]
            if whole is not None and whole.any():
                lowered = np.where(np.repeat(whole, np.diff(offsets)), data, lowered)
            data, edges = lowered[kept], before.astype(np.int64)
            full = edges[1:] > edges[:-1]
            first = np.concatenate([[0], np.cumsum(full)])[first]
            edges = np.append(edges[:-1][full], len(data))
        return data, edges[:-1], edges[1:], first

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and the number of ids of each; at most a quarter of the slots at a time."""
        hashes = tb.hash_spans(data, starts, ends) | np.uint64(1 << 63)
        slots = self.young.find(hashes)
        new = np.flatnonzero(slots < 0)
        if new.size and self.young.full(len(new)):
            self.young, self.old = Memory(), self.young
            new = np.arange(len(hashes))
        if new.size:
            unknown, where = np.unique(hashes[new], return_index=True)
            at = new[where]
            if self.old is not None:
                before = self.old.find(unknown)
                known = before >= 0
                self.young.add(unknown[known], *self.old.ids(before[known]))
                unknown, at = unknown[~known], at[~known]
            sizes = ends[at] - starts[at]
            column = pa.Array.from_buffers(pa.large_string(), len(at), [
                None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(tb.gather(data, starts[at], sizes)),
            ])
            self.learn(unknown, column.to_pylist())
            slots[new] = self.young.find(hashes[new])
        return self.young.ids(slots)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column, one row after the other, and the number of ids of each row; null counts as empty."""
        data, starts, ends, first = self.pieces(texts)
        parts = [self.look_up(data, starts[k : k + SLOTS // 4], ends[k : k + SLOTS // 4]) for k in range(0, len(starts), SLOTS // 4)]
        ids = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in parts)])
        total = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(x for _, x in parts)]))
        return ids, np.diff(total[first])


#: Letters that Unicode normalisation and lower-casing leave as they are.
PLAIN = re.compile("[a-z\\u00df-\\u00f6\\u00f8-\\u00ff]+")
#: The encoder of this worker and its memory of pieces.
_made: dict = {}


def word_encoder(definition: bytes) -> PieceEncoder:
    """Encoder for a word BPE definition whose normaliser lowers case and whose pre-tokenizer drops white space.

    Pieces of plain lower-case letters are one word for the pre-tokenizer and unchanged by the normaliser; they
    skip both. All others go through the library's whole tokenizer.
    """
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    key = hash(definition)
    if key not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        full, light = Tokenizer.from_buffer(definition), Tokenizer.from_buffer(definition)
        light.normalizer = normalizers.Sequence([])
        light.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def library(pieces):
            plain = [PLAIN.fullmatch(p) is not None for p in pieces]
            quick = iter(light.encode_batch([p for p, x in zip(pieces, plain) if x], add_special_tokens=False))
            slow = iter(full.encode_batch([p for p, x in zip(pieces, plain) if not x], add_special_tokens=False))
            return [next(quick if x else slow).ids for x in plain]

        marks = [t.content for t in full.get_added_tokens_decoder().values()]
        _made.clear()
        _made[key] = PieceEncoder(library, marks, bare=True)
    return _made[key]
