"""All occurrences of vocabulary pieces in many words at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_EMPTY = -1
DENSE = 1 << 16  # alphabets up to this size have a plain table of first steps
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def spread(keys: np.ndarray, shift: int) -> np.ndarray:
    """Slots for int64 keys: the upper ``64 - shift`` bits of a multiplicative hash."""
    return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(shift)).view(np.int64)


class HashTable:
    """Fixed map from non-negative int64 keys to int64 values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.shift = 64 - (size.bit_length() - 1)
        self.mask = size - 1
        self.keys = np.full(size, _EMPTY, np.int64)
        self.values = np.zeros(size, np.int64)
        slot, left = spread(keys, self.shift), np.arange(len(keys))
        while len(left):
            at = slot[left]
            taken = self.keys[at] != _EMPTY
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = left[~taken & first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[taken | ~first]
            slot[left] = (slot[left] + 1) & self.mask

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        slot = spread(keys, self.shift)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], np.int64(default))
        # most keys are found or missed at once
        open_ = np.flatnonzero(~hit & (found != _EMPTY))
        slot, keys = slot[open_], keys[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (found != _EMPTY)
            open_, slot, keys = open_[on], slot[on], keys[on]
        return out


class Pieces:
    """A trie over code sequences; ``match`` walks it from every position of many words together."""

    def __init__(self, sequences: dict[int, Sequence[int]], alphabet: int):
        self.alphabet = alphabet
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for piece, codes in sequences.items():
            node = 0
            for code in codes:
                node = steps.setdefault(node * alphabet + code, len(steps) + 1)
            ends[node] = piece
        self.table = HashTable(
            np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps))
        )
        # every place begins with a first step
        self.root = np.array([steps.get(code, _EMPTY) for code in range(alphabet)], np.int64) if alphabet <= DENSE else None
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        for node, piece in ends.items():
            self.piece[node] = piece

    def match(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, piece)`` of each occurrence.

        ``codes`` holds all words one after another, ``ends`` the end of the word that each
        position belongs to. Occurrences do not cross words.
        """
        start = np.arange(len(codes))
        at = start
        node = np.zeros(len(codes), np.int64)
        found = []
        while len(start):
            if self.root is not None and not found:
                node = self.root[codes]
            else:
                node = self.table.get(node * self.alphabet + codes[at])
            on = node >= 0
            start, at, node = start[on], at[on] + 1, node[on]
            piece = self.piece[node]
            whole = piece >= 0
            found.append((start[whole], at[whole], piece[whole]))
            more = at < ends[start]
            start, at, node = start[more], at[more], node[more]
        if not found:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found))


def by_step(start: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of occurrences by their offset in the word, and where each offset begins."""
    step = offset[start]
    order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 65536 else step, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(step))))
