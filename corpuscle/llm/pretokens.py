"""Ids of texts by way of their distinct pre-tokens: each is encoded once and then looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from corpuscle.llm import _arrays as A


class PretokenIds:
    """A bounded store of the ids of pre-tokens; encode gets those that are missing, all at once."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 250_000) -> None:
        self.encode, self.most = encode, most
        self.at: dict[str, int] = {}
        self.flat, self.ptr = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _keep(self, words: list[str]) -> None:
        """Forgets all but the stored words given."""
        place = np.fromiter((self.at[w] for w in words), np.int64, len(words))
        size = self.ptr[place + 1] - self.ptr[place]
        self.flat = self.flat[A.ragged(self.ptr[place], size)]
        self.ptr = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.at = dict(zip(words, range(len(words)), strict=True))

    def learn(self, rows: Iterable[list[str]]) -> None:
        """Makes sure that every pre-token of the rows is stored; a full store forgets those not in the rows."""
        wanted: set[str] = set()
        for row in rows:
            wanted.update(row)
        missing = [w for w in wanted if w not in self.at]
        if len(self.at) + len(missing) > self.most and self.at:
            self._keep([w for w in wanted if w in self.at])
        if missing:
            ids = self.encode(missing)
            self.at.update(zip(missing, range(len(self.at), len(self.at) + len(missing)), strict=True))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(sizes)])

    def all_ids(self, row: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of stored pre-tokens in one array, the number of each)."""
        at = np.fromiter(map(self.at.__getitem__, row), np.int64, len(row))
        start, size = self.ptr[at], self.ptr[at + 1] - self.ptr[at]
        return self.flat[A.ragged(start, size)], size

    def ids(self, row: list[str]) -> np.ndarray:
        """The ids of one row of stored pre-tokens."""
        return self.all_ids(row)[0]


class PartIds:
    """A bounded store of the ids of byte strings, held in arrays alone.

    Strings are told apart by two independent 64-bit hashes. One whose first hash
    is that of another string is encoded by itself and not stored.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known, self.at, self.check = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)  # hashes in order, and their parts
        self.flat, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts data[start:end], their number for each part).

        encode gets the places of parts that are new, and returns their ids in one
        array and the number of each. A full store starts anew.
        """
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        one, two = self._hashes(data, start, end)
        distinct, first, back = np.unique(one, return_index=True, return_inverse=True)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            new = self.known[place] != distinct
        if len(self.known) + int(new.sum()) > self.most and len(self.known):
            self._clear()
            new[:] = True
        if new.any():
            ids, counts = encode(first[new])
            part = len(self.ptr) - 1 + np.arange(len(counts))
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(counts)])
            place = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, place, distinct[new])
            self.at = np.insert(self.at, place, part)
            self.check = np.insert(self.check, place, two[first[new]])
        place = np.searchsorted(self.known, distinct)
        part = self.at[place][back]
        size = self.ptr[part + 1] - self.ptr[part]
        other = np.flatnonzero(self.check[place][back] != two)  # strings of one hash
        if not len(other):
            return self.flat[A.ragged(self.ptr[part], size)], size
        ids, size[other] = encode(other)
        out, ends = np.empty(int(size.sum()), np.int32), np.cumsum(size)
        plain = np.setdiff1d(np.arange(len(part)), other)
        out[A.ragged((ends - size)[plain], size[plain])] = self.flat[A.ragged(self.ptr[part[plain]], size[plain])]
        out[A.ragged((ends - size)[other], size[other])] = ids
        return out, size

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return A.span_identities(data, start, end)
