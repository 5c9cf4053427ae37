"""Texts as rows of units that a library encodes apart, handled as whole Arrow and NumPy arrays.

A text's ids are those of its units in a row. The different units of many texts are looked up once each
in a bounded store; new ones are encoded by the library, and the ids of all texts are put together by
one gather. Python objects are made for different units only, not for each word.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np

#: Bytes of text that are handled at once.
PORTION = 4 << 20


class Store:
    """Rows of unsigned 32-bit integers in one growing array; some are known by a key. Row 0 is empty."""

    def __init__(self, most: int):
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_flat, self.n = 0, 1

    def trim(self) -> None:
        """Forget everything once too much is held; to be called while no row is in use."""
        if len(self.known) > self.most or self.n_flat > 16 * self.most:
            self.reset()

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of new rows, given in a row."""
        n, k = self.n_flat + len(flat), self.n + len(sizes)
        if n > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n_flat], np.empty(max(n, 2 * self.n_flat) - self.n_flat, np.uint32)])
        if k > len(self.sizes):
            more = max(k, 2 * self.n) - self.n
            self.starts, self.sizes = (np.concatenate([x[: self.n], np.empty(more, np.int64)]) for x in (self.starts, self.sizes))
        self.flat[self.n_flat : n] = flat
        self.sizes[self.n : k] = sizes
        self.starts[self.n : k] = self.n_flat + np.cumsum(sizes) - sizes
        places = np.arange(self.n, k)
        self.n_flat, self.n = n, k
        return places

    def add_lists(self, rows: list) -> np.ndarray:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return self.add(np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes)

    def find(self, keys: list[str]) -> np.ndarray:
        """The places of the keys; 0 for what is not known."""
        return np.fromiter(map(self.known.get, keys, repeat(0)), np.int64, len(keys))

    def counts(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many integers the rows at ``places[offsets[k]:offsets[k + 1]]`` have."""
        return np.diff(np.concatenate([[0], np.cumsum(self.sizes[places])])[offsets])

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The integers of all the rows at ``places``, in a row."""
        n = self.sizes[places]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[places] - ends + n, n)
        return self.flat[at]


def as_array(texts):
    """An Arrow string array without nulls, of an Arrow array or a list."""
    import pyarrow as pa

    got = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return got.fill_null("") if got.null_count else got


def at_spaces(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different parts, the part at each place, the offsets of each text's places) of texts cut at every space."""
    import pyarrow.compute as pc

    cut = pc.split_pattern(texts, " ")
    offsets = cut.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def owners(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The different texts that the places belong to."""
    return np.unique(np.searchsorted(offsets, places, side="right") - 1)


def portions(batch, column: str, most: int = PORTION):
    """Parts of an Arrow batch of about ``most`` bytes in the column; a longer text is a part of its own."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = base = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, base = hi, int(ends[hi - 1])
