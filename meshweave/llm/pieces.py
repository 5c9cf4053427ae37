"""SentencePiece encoding that keeps the source offsets of every piece, and decoding.

The model file holds a compiled character map: a double-array trie of byte strings and what they become.
``CharMap`` reads it; normalising takes the longest prefix in the trie at each place and records, for each
byte of the normalised text, the source byte that it comes from. The library gives the ids; the byte
lengths of their pieces, added up, place each piece in the normalised text, and the record projects it to
a span of the original bytes. The lengths must add up to the normalised text, or the task fails.

Where the map is empty and no piece has a word mark after another character, no merge crosses from a
character to a following space, so the ids of a text are those of its units (spaces and the run after
them) in a row, and a bounded cache of units saves most work; else whole texts are encoded.

A map without a shuffle; one text's arrays are held at a time.

Defined results: null text is the empty text (no ids, empty decoding); repeated rows each get a row; an
empty table gives no rows; other columns are kept by ``encode_documents`` unless their names clash with its
own, which replace them.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import table
from .tokens import CACHE_CHARS, default_path
from .units import Store, as_array, at_spaces, owners, portions

MARK = "▁"
# Fixed values of the model format: field numbers and piece types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
CHARS_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5
USER_DEFINED, BYTE = 4, 6
MARK_AS_SUFFIX = 24
#: Bytes of text whose arrays are held at once.
PORTION = 1 << 20
#: Units that a worker keeps, at about 200 bytes each.
CACHE_UNITS = 250_000
_UNITS = re.compile(r" +[^ ]*")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        c = b[i]
        i += 1
        v |= (c & 127) << shift
        shift += 7
        if c < 128:
            return v, i


def fields(b: bytes):
    """(number, value) of a serialised message: integers, or bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class CharMap:
    """The compiled character map: longest-prefix lookups in its double array."""

    def __init__(self, blob: bytes):
        self.units, self.text = (), b""
        if blob:
            n = struct.unpack("<I", blob[:4])[0]
            self.units, self.text = struct.unpack(f"<{n // 4}I", blob[4 : 4 + n]), blob[4 + n :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, b: bytes, i: int) -> tuple[int, int]:
        """(length, value) of the longest key that ``b`` has at ``i``; (0, 0) if there is none."""
        units, best = self.units, (0, 0)
        node = self._child(0)
        for j in range(i, len(b)):
            node ^= b[j]
            if node >= len(units) or units[node] & 0x800000FF != b[j]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._child(node)
            if leaf:
                best = (j + 1 - i, units[node] & 0x7FFFFFFF)
        return best

    def _child(self, node: int) -> int:
        u = self.units[node]
        return (u >> 10) << ((u & 0x200) >> 6)

    def replacement(self, value: int) -> bytes:
        return self.text[value : self.text.index(b"\0", value)]


class PieceCodec:
    def __init__(self, path: str):
        import pyarrow as pa
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        # messages of one number are parts of one
        spec, trainer = (dict(fields(b"".join(v for k, v in model if k == number))) for number in (NORMALIZER, TRAINER))
        self.map = CharMap(spec.get(CHARS_MAP, b""))
        self.prefix, self.squeeze, self.escape = bool(spec.get(DUMMY_PREFIX, 1)), bool(spec.get(EXTRA_SPACES, 1)), bool(spec.get(ESCAPE, 1))
        if trainer.get(MARK_AS_SUFFIX):
            raise ValueError("models that mark words at their end are not supported")
        pieces = [dict(fields(v)) for k, v in model if k == PIECES]
        self.lengths = np.array([1 if p.get(TYPE) == BYTE else len(p.get(PIECE, b"")) for p in pieces], np.int64)
        if any(p.get(TYPE) == USER_DEFINED for p in pieces):
            raise ValueError("models with user-defined symbols are not supported")
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.apart = not self.map and self.prefix and self.escape and not self.squeeze and not any(inner.search(p[PIECE].decode()) for p in pieces if p.get(TYPE, 1) == 1)
        self.unknown = self.sp.unk_id() if not any(p.get(TYPE) == BYTE for p in pieces) else -1
        self.store = Store(CACHE_UNITS)
        self.marks = pa.array([str(k) for k in range(len(pieces))], pa.string())

    def _lists(self, texts: list[str]) -> np.ndarray:
        return self.store.add_lists(self.sp.encode(texts, num_threads=1) if texts else [])

    def _places(self, units: list[str]) -> np.ndarray:
        """The places of the ids of different units, told without their first space; new ones are kept if they are short."""
        places = self.store.find(units)
        new = np.flatnonzero(places == 0)
        fresh = [units[k] for k in new]
        places[new] = got = self._lists(fresh)
        self.store.known.update((u, p) for u, p in zip(fresh, got.tolist()) if len(u) <= CACHE_CHARS)
        return places

    def _uneven(self, texts: list[str]) -> np.ndarray:
        """The places of the ids of whole texts with runs of spaces, or which hold the mark or end with a space."""
        cut = [_UNITS.findall(" " + t) if t and t[-1] != " " and MARK not in t else None for t in texts]
        units = list(dict.fromkeys(u[1:] for c in cut if c for u in c))
        at = dict(zip(units, self._places(units).tolist()))
        whole = iter(self._lists([t for t, c in zip(texts, cut) if c is None]).tolist())
        rows = [self.store.gather(np.array([next(whole)] if c is None else [at[u[1:]] for u in c])) for c in cut]
        return self.store.add_lists(rows)

    def encode_flat(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, how many each text has) of an Arrow array or list of texts."""
        self.store.trim()
        texts = as_array(texts)
        if not self.apart:
            places, offsets = self._lists(texts.to_pylist()), np.arange(len(texts) + 1)
        else:
            units, which, offsets = at_spaces(texts)
            # an empty part stands beside another space, or for an empty text
            odd = np.array([not u or MARK in u for u in units], bool)
            places = np.zeros(len(units), np.int64)
            places[~odd] = self._places([u for u, o in zip(units, odd) if not o])
            places = places[which]
            if odd.any():
                bad = owners(offsets, np.flatnonzero(odd[which]))
                rows = self._uneven(texts.take(bad).to_pylist())
                for k, p in zip(bad.tolist(), rows.tolist()):
                    places[offsets[k] : offsets[k + 1]] = 0
                    places[offsets[k]] = p
        return self.store.gather(places), self.store.counts(places, offsets)

    def encode(self, texts) -> list[tuple[list[int], str]]:
        """(ids, ids in decimal joined by commas) of each text."""
        flat, counts = self.encode_flat(texts)
        each = np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
        return [(ids.tolist(), s) for ids, s in zip(each, self.joined(flat, counts).to_pylist())]

    def joined(self, flat: np.ndarray, counts: np.ndarray):
        """The ids of each text in decimal, joined by commas, as an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(counts):
            return pa.array([], pa.string())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.marks.take(pa.array(flat))), ",")

    def spans_flat(self, texts, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte in its text of each piece, for all texts in a row.

        Without a character map only spaces change: each is a mark of three bytes, and one more stands before a
        text that is not empty. So one running sum over all pieces places them in all normalised texts at once.
        """
        texts = as_array(texts)
        if self.map or self.squeeze or not (self.prefix and self.escape) or self.unknown >= 0:
            each = [self.spans(t, ids) for t, ids in zip(texts.to_pylist(), np.split(flat, np.cumsum(counts)[:-1]))] if len(counts) else []
            none = np.zeros(0, np.int64)
            return np.concatenate([none, *(b for b, _ in each)]), np.concatenate([none, *(e for _, e in each)])
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == "string" else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begin, n = offsets[:-1] - offsets[0], np.diff(offsets)
        # source byte of each normalised byte, and one more place for the end of each text
        width = np.where(raw == 32, 3, 1)
        at = np.repeat(np.arange(len(raw)), width)
        long = np.concatenate([[0], np.cumsum(width)])
        size = long[begin + n] - long[begin] + 3 * (n > 0)
        ends = np.cumsum(self.lengths[flat])
        total = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
        if (total != size).any():
            k = int(np.flatnonzero(total != size)[0])
            raise ValueError(f"pieces of {total[k]} bytes do not make up the normalised text of {size[k]}")
        own = np.repeat(np.arange(len(n)), counts)
        before = np.cumsum(size) - size  # of the texts before, as pieces count them
        inner = ends - before[own] - 3  # place after each piece within its text, without the mark in front
        end = np.where(inner >= size[own] - 3, n[own], at[np.clip(long[begin[own]] + inner, 0, max(len(at) - 1, 0))] - begin[own] if len(at) else 0)
        end = np.maximum(end, 0) * (inner > 0)
        first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
        start = np.where(first, 0, np.concatenate([[0], end[:-1]])) if len(own) else end
        return start, end

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the source byte that it comes from."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.map:
            out, at, i = bytearray(), [], 0
            while i < len(raw):
                n, value = self.map.longest(raw, i)
                if n:
                    new = self.map.replacement(value)
                else:
                    n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                    new = raw[i : i + n]
                out += new
                at += [i] * len(new)
                i += n
            raw_n, align = bytes(out), np.array(at, np.int64)
        else:
            raw_n, align = raw, np.arange(len(raw))
        if self.squeeze:
            b = np.frombuffer(raw_n, np.uint8)
            space = b == 32
            keep = ~space
            keep[1:] |= ~space[:-1]
            first = np.flatnonzero(~space)
            if not len(first):
                return b"", np.array([len(raw)])
            keep[: first[0]] = False
            keep[first[-1] + 1 :] = False
            raw_n, align = b[keep].tobytes(), align[keep]
        if self.prefix:
            raw_n, align = b" " + raw_n, np.concatenate([[align[0] if len(align) else 0], align])
        if self.escape:
            space = np.frombuffer(raw_n, np.uint8) == 32
            align = np.repeat(align, np.where(space, 3, 1))
            raw_n = raw_n.replace(b" ", MARK.encode())
        return raw_n, np.concatenate([align, [len(raw)]])

    def spans(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte in the source of each piece."""
        normal, align = self.normalize(text)
        n = self.lengths[np.asarray(ids, np.int64)] if len(ids) else np.zeros(0, np.int64)
        if self.unknown >= 0 and self.unknown in ids:
            n = self._with_unknown(normal, ids, n)
        ends = np.cumsum(n)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError(f"pieces of {ends[-1] if len(ends) else 0} bytes do not make up the normalised text of {len(normal)}")
        return align[ends - n], align[ends]

    def _with_unknown(self, normal: bytes, ids, n: np.ndarray) -> np.ndarray:
        n, i = n.copy(), 0
        names = [self.sp.id_to_piece(int(x)).encode() if x != self.unknown else None for x in ids]
        for k, name in enumerate(names):
            if name is None:  # up to the next known piece
                follow = next((x for x in names[k + 1 :] if x is not None), None)
                n[k] = (normal.index(follow, i + 1) if follow else len(normal)) - i
            i += int(n[k])
        return n


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


_FULL = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("begins", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())])
_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("covered_bytes", T.LongType())])


def _encoded(model: str, digest: bool):
    import pyarrow as pa
    import pyarrow.compute as pc

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in portions(batch, "__mw_text", PORTION):
                texts = part.column("__mw_text")
                flat, counts = c.encode_flat(texts)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                decoded = [c.sp.decode(flat[a:b].tolist()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                begins, ends = c.spans_flat(texts, flat, counts)
                if digest:
                    joined = c.joined(flat, counts)
                    at, held = np.frombuffer(joined.buffers()[1], np.int32), memoryview(joined.buffers()[2] or b"")
                    covered = np.diff(np.concatenate([[0], np.cumsum(ends - begins)])[cuts])
                    new = [
                        pa.array(counts),
                        pa.array([hashlib.sha256(held[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1 : part.num_rows + 1].tolist())], pa.string()),
                        pa.array([sha(d) for d in decoded], pa.string()),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(covered),
                    ]
                    names = _DIGEST.names
                else:
                    lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x))
                    new = [lists(flat.astype(np.int32)), lists(begins), lists(ends), pa.array(decoded, pa.string())]
                    names = _FULL.names
                keep = [k for k in range(part.num_columns) if part.schema.names[k] != "__mw_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *new], [*(part.schema.names[k] for k in keep), *names])
        # workers outlive tasks, and later stages need the memory
        c.store.reset()
        pa.default_memory_pool().release_unused()

    return run


def _apply(df: DataFrame, model: str, text_col: str, digest: bool) -> DataFrame:
    out = _DIGEST if digest else _FULL
    rows = df.withColumn("__mw_text", F.coalesce(F.col(text_col), F.lit(""))).drop(*out.names)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "__mw_text"], *out.fields])
    return rows.mapInArrow(_encoded(model, digest), schema)


def encode_documents(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """The rows with ids, begins, ends (source bytes of each piece) and decoded."""
    return _apply(df, model, text_col, False)


def encode_digests(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """The rows with counts and digests of what :func:`encode_documents` gives, without carrying the arrays."""
    return _apply(df, model, text_col, True)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document's ids and digests in place of its text."""
    return encode_digests(docs, default_path("piece_bpe_32k.model")).drop("text")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path("piece_bpe_32k.model")).drop("text")
