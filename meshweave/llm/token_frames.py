"""Token ids in seekable zstandard files, with a document index.

A shard holds the ids of a range of documents in ascending id order, each followed by the end id, as
little-endian unsigned integers of 16 bits where the vocabulary allows it, else 32. Layout:

* independent zstandard frames of about ``FRAME_IDS`` ids, cut at document ends where they can be;
* a skippable frame with the document index (ids, a null mask and token counts, compressed; the width in
  bytes; its own size in the last 8 bytes);
* the seek table of the zstandard seekable format: sizes of each frame and a checksum of its content (the
  low 32 bits of XXH64), with the frame count, flags and magic number at the very end.

A reader loads the tail, finds a document's ids by its counts, decompresses only the frames that hold
them, and checks each frame. Documents are dealt to shards by a range sort; the driver holds one row a
shard. A shard appears only when it is whole, under a name of the attempt that wrote it, so that a task may
run again. Reading is dealt out in ranges of documents.

The order is that of the id, of a hash of the text and of the text: the sort samples numbers only, and an id that
many rows have (or null) is cut by the hash into several shards, equal rows by their place in the input.

Defined results: null text is the empty text (only the end id); rows with equal ids are separate
documents, ordered by the hash, then the text; null ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from .storage import Output, make_dir, open_input, size_of
from .text import table
from .tokens import default_path, encoder
from .units import portions

#: Ids in a frame before it is closed.
FRAME_IDS = 1 << 17
#: Ids for one task when files are read.
READ_IDS = 1 << 22
# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3


class ShardWriter:
    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.kind = out, width, np.dtype(f"<u{width}")
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[np.ndarray] = []
        self.n_open = self.n_ids = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        if self.n_open and self.n_open + len(ids) > FRAME_IDS:
            self._close()
        while len(ids) > FRAME_IDS:
            self.open, self.n_open = [ids[:FRAME_IDS]], FRAME_IDS
            self._close()
            ids = ids[FRAME_IDS:]
        self.open.append(ids)
        self.n_open += len(ids)

    def _close(self) -> None:
        import xxhash

        raw = np.concatenate(self.open).astype(self.kind).tobytes()
        data = self.zstd.compress(raw)
        self.out.write(data)
        self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.n_open = [], 0

    def finish(self) -> None:
        if self.n_open:
            self._close()
        known = np.array([x is not None for x in self.docs], bool)
        ids = np.array([x or 0 for x in self.docs], "<i8")
        body = self.zstd.compress(known.tobytes() + ids.tobytes() + np.array(self.counts, "<i8").tobytes())
        size = 8 + len(body) + 24
        self.out.write(struct.pack("<II", SKIPPABLE, size - 8) + body + struct.pack("<QQQ", self.width, len(self.docs), size))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC))
        self.out.close()


class ShardReader:
    def __init__(self, uri: str):
        import zstandard

        self.file, size = open_input(uri), size_of(uri)
        self.zstd = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table")
        seek = size - 17 - 12 * n
        head = struct.unpack("<II", self._at(seek, 8))
        if head != (SEEK_SKIPPABLE, 12 * n + 9):
            raise ValueError(f"{uri} has a broken seek table")
        table_ = np.frombuffer(self._at(seek + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.width, n_docs, index = struct.unpack("<QQQ", self._at(seek - 24, 24))
        self.kind = np.dtype(f"<u{self.width}")
        raw = self.zstd.decompress(self._at(seek - index + 8, index - 32), max_output_size=17 * n_docs + 1)
        self.known = np.frombuffer(raw[:n_docs], bool)
        self.ids_ = np.frombuffer(raw[n_docs : 9 * n_docs], "<i8")
        self.counts = np.frombuffer(raw[9 * n_docs :], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.packed, self.sums = table_[:, 0], table_[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(table_[:, 0])])
        self.ends = np.cumsum(table_[:, 1] // self.width)
        self.last: tuple[int, np.ndarray | None] = (-1, None)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _frame(self, k: int) -> np.ndarray:
        import xxhash

        if self.last[0] != k:
            raw = self.zstd.decompress(self._at(int(self.offsets[k]), int(self.packed[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self.last = (k, np.frombuffer(raw, self.kind))
        return self.last[1]

    def span(self, lo: int, hi: int) -> np.ndarray:
        """The ids from place lo to hi of the shard; only the frames that hold them are decompressed."""
        parts = [np.zeros(0, self.kind)]
        k = int(np.searchsorted(self.ends, lo, side="right"))
        while lo < hi:
            begin = int(self.ends[k - 1]) if k else 0
            stop = min(hi, int(self.ends[k]))
            parts.append(self._frame(k)[lo - begin : stop - begin])
            lo, k = stop, k + 1
        return np.concatenate(parts)

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at this place."""
        return self.span(int(self.starts[place]), int(self.starts[place + 1]))

    def runs(self, lo: int, hi: int):
        """The documents from lo to hi in runs of about as many ids as a frame has."""
        while lo < hi:
            stop = int(np.searchsorted(self.starts, self.starts[lo] + FRAME_IDS, side="right")) - 1
            stop = min(hi, max(lo + 1, stop))
            yield lo, stop
            lo = stop


def write_shards(df: DataFrame, folder: str, tokenizer: str, end_id: int) -> list:
    """Encode (id, text) and write the shards in ascending id order; one row a shard: place, uri, docs, ids."""
    import pyarrow as pa

    def write(batches):
        from pyspark import TaskContext

        enc, writer, place = encoder(tokenizer), None, TaskContext.get().partitionId()
        for batch in batches:
            for part in portions(batch, "text"):
                if writer is None:
                    writer = ShardWriter(Output(folder, f"shard-{place:06d}", ".ids.zst"), enc.width if end_id < 1 << 16 else 4)
                flat, counts = enc.encode_flat(part.column("text"))
                ends = np.cumsum(counts)
                flat = np.insert(flat.astype(writer.kind), ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                lo = 0
                for doc_id, hi in zip(part.column("id").to_pylist(), ends.tolist()):
                    writer.add(doc_id, flat[lo:hi])
                    lo = hi
        if writer is not None:
            writer.finish()
            yield pa.RecordBatch.from_pydict({"place": [place], "uri": [writer.out.uri], "docs": [len(writer.docs)], "ids": [writer.n_ids]})

    make_dir(folder)
    keys = df.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = keys.repartitionByRange("id", "h", "row").sortWithinPartitions("id", "h", "text").select("id", "text")
    return sorted(dealt.mapInArrow(write, "place long, uri string, docs long, ids long").collect(), key=lambda r: r["place"])


def read_shards(spark: SparkSession, shards: list) -> DataFrame:
    """One row a document from the files: id, start, n_tokens, ids (uint32, little-endian)."""
    import pyarrow as pa

    plan, start = [], 0
    for s in shards:
        parts = max(1, -(-s["ids"] // READ_IDS))
        step = -(-s["docs"] // parts)
        plan += [(s["uri"], lo, min(lo + step, s["docs"]), start) for lo in range(0, s["docs"], step)]
        start += s["ids"]

    def read(batches):
        for batch in batches:
            for uri, lo, hi, base in zip(*(batch.column(c).to_pylist() for c in ("uri", "lo", "hi", "base"))):
                shard = ShardReader(uri)
                for a, b in shard.runs(lo, hi):
                    raw = np.ascontiguousarray(shard.span(int(shard.starts[a]), int(shard.starts[b])).astype("<u4"))
                    cuts = (4 * (shard.starts[a : b + 1] - shard.starts[a])).astype("<i8")
                    ids = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).cast(pa.binary())
                    docs = pa.array(shard.ids_[a:b], mask=~shard.known[a:b])
                    yield pa.RecordBatch.from_arrays([docs, pa.array(base + shard.starts[a:b]), pa.array(shard.counts[a:b]), ids], ["id", "start", "n_tokens", "ids"])

    ranges = spark.createDataFrame(plan, "uri string, lo long, hi long, base long")
    return ranges.repartition(max(1, len(plan))).mapInArrow(read, "id long, start long, n_tokens long, ids binary")


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    shards = write_shards(docs, new_path(spark, "token-frames"), default_path("byte_bpe_50k.json"), 2)
    got = read_shards(spark, shards)
    return got.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
