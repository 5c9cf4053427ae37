"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writing: each row becomes one gzip member. Of rows with equal payloads of at least ``least`` bytes the one
with the smallest id is a ``response``, the others are ``revisit`` records that refer to it and carry only the
HTTP head, whose Content-Length tells the size of the payload. Payloads travel once, to the table of first
ids by digest, a join that adaptive execution can split where one payload is held by many rows.

Reading: a file is dealt out in byte ranges. A task looks in its range for the gzip magic, and takes a
candidate only if it inflates to the end of a member with a right checksum, begins with a WARC version
line and is as long as its Content-Length says; a chance magic inside compressed data is passed over. A
record belongs to the range in which it starts, so its task may read beyond its range, and records are
found once however files are cut. A member's end is the next candidate.

Record ids hold the id and the row's place in the input, so that they differ; the input must give the same rows when it is read twice.

Defined results: null payload is empty; null URLs leave out the target; null ids are written as ``null`` and
are first only where no row with the payload has an id; rows with equal ids and payloads that are first
are all responses; an empty table gives no rows; other columns are ignored. Control characters in URLs are
percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialize, new_path
from .storage import Output, make_dir, open_input, size_of
from .text import table

#: Bytes of a range for one task; bytes looked at at a time; bytes read at a time.
SPLIT, READ, AHEAD = 4 << 20, 1 << 14, 1 << 18
#: Shortest payload that is stored once.
LEAST = 0
# Fixed values of the formats.
MAGIC, VERSION, URN, DATE = b"\x1f\x8b\x08", b"WARC/1.1\r\n", "urn:x-page:", "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, uri string, offset long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, first, revisit: bool) -> bytes:
    """One record, compressed as a member of its own; ``first`` holds id and row of the response that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}:{row}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{first['id']}:{first['row']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_archive(df: DataFrame, folder: str, least: int = LEAST) -> list:
    """Write (id, url, payload string) and return one row a file: uri, size, records."""
    import pyarrow as pa

    rows = df.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # rows with equal ids are records of their own
    # the first ids are a table of their own, so that a payload that many rows hold can be split in the join
    firsts = materialize(rows.groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-firsts")

    def write(batches):
        out, n = None, 0
        for batch in batches:
            for page_id, row, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "url", "payload", "first"))):
                out = out or Output(folder, "pages", ".warc.gz")
                raw = payload.encode()
                revisit = len(raw) >= least and first is not None and page_id != first["id"]
                out.write(record(page_id, row, url, raw, sha1_base32(raw), first, revisit))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [out.uri], "size": [out.size], "records": [n]})

    make_dir(folder)
    joined = rows.join(firsts, "digest", "left").select("id", "row", "url", "payload", "first")
    files = joined.mapInArrow(write, "uri string, size long, records long").collect()
    discard(firsts)
    return sorted(files, key=lambda r: r["uri"])


class Members:
    """The valid WARC members of a file that start in [lo, hi)."""

    def __init__(self, file, size: int, read: int = READ):
        self.file, self.size, self.read = file, size, read
        self.held, self.begin = b"", 0

    def _at(self, offset: int, n: int) -> bytes:
        """Bytes of the file; what was read ahead serves the search, the member at the place found, and the next ones."""
        at = offset - self.begin
        if at < 0 or (at + n > len(self.held) and self.begin + len(self.held) < self.size) or at > len(self.held):
            self.file.seek(offset)
            self.held, self.begin, at = self.file.read(max(n, AHEAD)), offset, 0
        return self.held[at : at + n]

    def candidate(self, lo: int, hi: int) -> int:
        """The first place in [lo, hi) that has the gzip magic, or ``hi``."""
        while lo < hi:
            block = self._at(lo, self.read + len(MAGIC) - 1)
            k = block.find(MAGIC)
            if k >= 0:
                return min(hi, lo + k)
            if len(block) < len(MAGIC):
                break
            lo += self.read
        return hi

    def inflate(self, offset: int):
        """(record, end) of the member at ``offset``, or None if there is no whole WARC record."""
        z, parts, at, begun = zlib.decompressobj(31), [], offset, False
        while not z.eof:
            block = self._at(at, self.read)
            if not block:
                return None
            at += len(block)
            try:
                parts.append(z.decompress(block))
            except zlib.error:
                return None
            if not begun and sum(map(len, parts)) >= len(VERSION):
                begun = True
                if not b"".join(parts).startswith(b"WARC/"):
                    return None
        data = b"".join(parts)
        head, gap, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        if not gap or not head.startswith(b"WARC/") or not fields.get("Content-Length", "").isdigit():
            return None
        n = int(fields["Content-Length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            return None
        return (fields, rest[:n]), at - len(z.unused_data)

    def records(self, lo: int, hi: int):
        at = self.candidate(lo, hi)
        while at < hi:
            got = self.inflate(at)
            if got is None:
                at = self.candidate(at + 1, hi)
                continue
            yield at, *got[0]
            at = self.candidate(got[1], hi)


def parse(fields: dict[str, str], block: bytes) -> tuple:
    """(id, url, type, refers to, payload bytes, digest, payload); a payload is held against its digest."""
    number = lambda x: None if x is None or x.startswith(f"<{URN}null:") else int(x[len(URN) + 1 : -1].split(":")[0])
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?im)^Content-Length: (\d+)", head)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} fails its digest")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), n, digest, payload if kind == "response" else None


def read_archive(spark: SparkSession, uris: list[str], split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """One row a record of the files, dealt out in ranges of ``split`` bytes."""
    import pyarrow as pa

    ranges = [(u, lo, min(lo + split, n)) for u in uris for n in [size_of(u)] for lo in range(0, n, split)]

    def read(batches):
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in READ_SCHEMA.split(", ")])
        for batch in batches:
            for uri, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("uri", "lo", "hi"))):
                held, size = [], 0
                with open_input(uri) as file:
                    for at, fields, block in Members(file, size_of(uri)).records(lo, hi):
                        row = (*parse(fields, block), uri, at)
                        held.append(row if payloads else (*row[:6], None, *row[7:]))
                        size += len(block)
                        if size > 8 << 20 or len(held) >= 2_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=schema)

    plan = spark.createDataFrame(ranges, "uri string, lo long, hi long")
    return plan.repartition(max(1, min(len(ranges), 10 * spark.sparkContext.defaultParallelism))).mapInArrow(read, READ_SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), "url", F.col("html").alias("payload"))
    files = write_archive(pages, new_path(spark, "warc"))
    got = read_archive(spark, [f["uri"] for f in files], payloads=False)
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 from its hex: eight groups of 20 bits, four letters each.
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INTEGER, 1)" for g in range(8) for k in range(4))
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to FROM q
"""
