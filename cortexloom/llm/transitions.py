"""Transitions of an automaton with a large or growing alphabet: one open-addressed table looked up for many lanes at once."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Keys are state << CLASS_BITS | class, so that neither the states nor the alphabet have to be known before.
CLASS_BITS = 21


def keys_of(states: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (states.astype(np.int64) << CLASS_BITS) | classes


class Transitions:
    """Maps non-negative 62-bit keys to int32 values; at most half of the cells are taken."""

    def __init__(self, bits: int = 14):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.zeros(1 << bits, np.int32)

    def _cells(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MUL) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._cells(keys)
        found = self.key[at]
        out = self.value[at]
        wrong = np.flatnonzero(found != keys)
        while len(wrong):
            out[wrong] = -1
            wrong = wrong[found[wrong] >= 0]  # an empty cell ends the search
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.key[at[wrong]]
            hit = found[wrong] == keys[wrong]
            out[wrong[hit]] = self.value[at[wrong[hit]]]
            wrong = wrong[~hit]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that are not there yet."""
        if 2 * (self.n + len(keys)) > len(self.key):
            taken = self.key >= 0
            old = self.key[taken], self.value[taken]
            self._make(max(self.bits + 1, (2 * (self.n + len(keys))).bit_length()))
            self._place(*old)
        self._place(keys, values)
        self.n += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._cells(keys)
        while len(keys):
            free = np.flatnonzero(self.key[at] < 0)
            self.key[at[free]] = keys[free]  # of several in one cell one stays
            done = self.key[at] == keys
            self.value[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask
