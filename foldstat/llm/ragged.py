"""Many short lists in one flat array, and dictionaries that make what they lack."""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np


class Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(key)
        return out


class Ragged:
    def __init__(self, code: str):
        self.flat, self.lengths = array(code), array("q")
        self.dtype = np.dtype({"I": np.uint32, "B": np.uint8}[code])
        self._starts = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.lengths)

    def extend(self, lists: list) -> None:
        self.lengths.extend(map(len, lists))
        self.flat.extend(chain.from_iterable(lists))

    @property
    def starts(self) -> np.ndarray:
        if len(self._starts) != len(self.lengths):
            sizes = np.frombuffer(self.lengths, np.int64)
            self._starts = np.cumsum(sizes) - sizes
        return self._starts

    def lists(self, index: list[int]) -> list[list[int]]:
        starts = self.starts
        return [self.flat[starts[i] : starts[i] + self.lengths[i]] for i in index]

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these numbers, one after the other, their ends with a leading 0)."""
        lengths = np.frombuffer(self.lengths, np.int64)[index] if len(index) else np.zeros(0, np.int64)
        ends = np.zeros(len(index) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        if not ends[-1]:
            return np.zeros(0, self.dtype), ends
        at = np.repeat(self.starts[index] - ends[:-1], lengths)
        at += np.arange(int(ends[-1]))
        return np.frombuffer(self.flat, self.dtype)[at], ends


class Lists:
    """A memo of lists by key, in two generations: the older one goes when the newer is full, but what was asked for since stays.

    ``make`` gives the lists of many keys at once."""

    def __init__(self, code: str, make, most: int):
        self.code, self.make, self.most = code, make, most
        self.index, self.store = {}, Ragged(code)
        self.old_index, self.old_store = {}, self.store

    def numbers(self, keys: list) -> np.ndarray:
        """The numbers in ``store`` of the lists of these keys."""
        new = set(keys).difference(self.index)
        if new:
            known = [k for k in new if k in self.old_index] if self.old_index else []
            fresh = list(new.difference(known)) if known else list(new)
            at = len(self.store)
            self.store.extend(self.old_store.lists([self.old_index[k] for k in known]))
            self.store.extend(self.make(fresh))
            self.index.update(zip(chain(known, fresh), range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def gather(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these keys, one after the other, their ends with a leading 0)."""
        return self.store.gather(self.numbers(keys))

    def turn(self) -> None:
        """Between batches only."""
        if len(self.index) > self.most:
            self.old_index, self.old_store = self.index, self.store
            self.index, self.store = {}, Ragged(self.code)
