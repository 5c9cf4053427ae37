"""Encoding through the public libraries, with a bounded cache of units that they encode apart.

A text is cut before a space that stands between two characters that are no white space. There a
byte-level BPE (pattern pre-tokenizer, no normalizer, no added token with white space) always ends a
pre-token and starts another, and no merge crosses from one pre-token to the next: the ids of the text
are those of its units in a row. Where a tokenizer is built otherwise, whole texts are encoded.

Texts are first cut at every space. If a new part is empty or touches other white space, the texts that
have it are cut again, between two characters that are no white space; such parts stay out of the cache, so
that what is in the cache needs no second look.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .units import Store, as_array, at_spaces, owners

#: Units that the cache holds at most; longer units than this many characters are not kept.
CACHE_UNITS, CACHE_CHARS = 1_000_000, 64
#: Units that are encoded as one text.
PACK = 400
_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def is_plain(spec: dict) -> bool:
    """Whether a tokenizer is a byte-level BPE whose pre-tokens end before a space between two characters that are no white space."""
    pre = spec["pre_tokenizer"] or {}
    return (
        spec["normalizer"] is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


class UnitEncoder:
    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.apart = is_plain(spec)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.store = Store(CACHE_UNITS)
        # bytes that each id stands for: a byte-level token has a character for each byte
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.lengths = np.zeros(max(self.tok.get_vocab_size(), *added, 0) + 1, np.int64)
        for token, k in self.tok.get_vocab().items():
            self.lengths[k] = len(added[k].encode()) if k in added else len(token)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _packed(self, units: list[str]) -> np.ndarray:
        """The places in the store of units, each after a space; they begin and end with what is no white space.

        They are encoded as one text, in which every unit is still a unit, and cut by their bytes.
        """
        out = [np.zeros(0, np.int64)]
        packs = [units[k : k + PACK] for k in range(0, len(units), PACK)]
        for some in (packs[k : k + 64] for k in range(0, len(packs), 64)):
            joined = [" " + " ".join(p) for p in some]
            for pack, text, e in zip(some, joined, self.tok.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                sizes = map(len, pack) if text.isascii() else (len(u.encode()) for u in pack)
                ends, want = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(sizes, np.int64, len(pack)) + 1)
                cuts = np.searchsorted(ends, want) + 1
                if len(ends) < cuts[-1] or (ends[cuts - 1] != want).any():
                    out.append(self.store.add_lists(self._ids([" " + u for u in pack])))
                else:
                    out.append(self.store.add(ids, np.diff(cuts, prepend=0)))
        return np.concatenate(out)

    def _places(self, units: list[str]) -> np.ndarray:
        """The places of different clean units, each after a space; new ones are encoded, and kept if they are short."""
        places = self.store.find(units)
        new = np.flatnonzero(places == 0)
        fresh = [units[k] for k in new]
        places[new] = got = self._packed(fresh)
        self.store.known.update((u, p) for u, p in zip(fresh, got.tolist()) if len(u) <= CACHE_CHARS)
        return places

    def _heads(self, heads: list[str]) -> np.ndarray:
        """The places of first units, which have no space before them."""
        keys = [" " + h for h in heads]
        places = self.store.find(keys)
        new = np.flatnonzero(places == 0)
        places[new] = got = self.store.add_lists(self._ids([heads[k] for k in new]))
        self.store.known.update((keys[k], p) for k, p in zip(new, got.tolist()) if len(keys[k]) <= CACHE_CHARS)
        return places

    def _uneven(self, texts: list[str]) -> np.ndarray:
        """The places of whole texts in which spaces meet other white space: one row of ids for each."""
        cut = [_CUT.split(t) for t in texts]
        heads = self._heads([c[0] for c in cut])
        units = list(dict.fromkeys(chain.from_iterable(c[1:] for c in cut)))
        clean = [u for u in units if u.strip() == u]
        odd = [u for u in units if u.strip() != u]  # only a text's last unit may end with white space
        at = dict(zip(clean, self._places(clean).tolist())) | dict(zip(odd, self.store.add_lists(self._ids([" " + u for u in odd])).tolist()))
        rows = [self.store.gather(np.array([h, *(at[u] for u in c[1:])])) for h, c in zip(heads.tolist(), cut)]
        return self.store.add_lists(rows)

    def _sequence(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(places in the store, offsets of each text in them) of an Arrow array or list of texts."""
        self.store.trim()
        texts = as_array(texts)
        if not self.apart:
            return self.store.add_lists(self._ids(texts.to_pylist())), np.arange(len(texts) + 1)
        units, which, offsets = at_spaces(texts)
        places = self.store.find(units)
        # what is known is clean: it neither begins nor ends with white space, so only new units need a look
        new = np.flatnonzero(places == 0)
        dirty = np.array([not u or u.strip() != u for u in (units[k] for k in new)], bool)
        clean = new[~dirty]
        places[clean] = self._places([units[k] for k in clean])
        seq = places[which]
        heads = which[offsets[:-1]]
        used, back = np.unique(heads, return_inverse=True)
        seq[offsets[:-1]] = self._heads([units[k] for k in used])[back]
        if dirty.any():
            bad = np.zeros(len(units), bool)
            bad[new[dirty]] = True
            odd = owners(offsets, np.flatnonzero(bad[which]))
            rows = self._uneven(texts.take(odd).to_pylist())
            for k, p in zip(odd.tolist(), rows.tolist()):
                seq[offsets[k] : offsets[k + 1]] = 0
                seq[offsets[k]] = p
        return seq, offsets

    def encode_flat(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, how many each text has)."""
        seq, offsets = self._sequence(texts)
        return self.store.gather(seq), self.store.counts(seq, offsets)

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        flat, counts = self.encode_flat(texts)
        return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []

    def count(self, texts) -> np.ndarray:
        """How many ids each text has."""
        return self.store.counts(*self._sequence(texts))


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def slices(batch, rows: int = 64):
    """Parts of an Arrow batch, so that few texts are held as Python strings at once."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
