"""Token counts; huge documents by overlapping chunks that are spliced where both provably agree.

A document of up to ``HUGE`` characters is encoded by its units (see ``tokens``). A longer one is encoded in chunks that overlap.
The pattern of the pre-tokenizer only looks ahead, a few characters beyond a match, and an added token is
no longer than ``reach``: so of a chunk that starts at a true pre-token boundary, all pre-token boundaries
up to ``reach`` before its end are those of the whole text. The next chunk starts anywhere; from the first boundary
that both have, it goes on exactly as the whole text does. Tokens never cross pre-tokens, so counts are
added up between common boundaries. Where the overlap has none (a huge run without a break), the left
chunk is widened, doubling, up to the end of the text.

Tokenizers of other builds (see ``tokens.is_plain``) encode whole texts.

Only one chunk's encoding is held at a time. A map without a shuffle; a task that is lost is run again.

Defined results: null text is the empty text (0 bytes, 0 tokens); repeated rows each get a row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table
from .tokens import default_path, encoder, is_plain, load_tokenizer
from .units import portions

#: Characters from which a document is encoded in chunks; a chunk; the overlap of two chunks.
HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 14, 1 << 10
LIMIT = 512


class SplicedCounter:
    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tok = load_tokenizer(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        added = spec["added_tokens"]
        #: Splices are proven for plain byte-level tokenizers only; others encode whole texts.
        self.plain = is_plain(spec)
        #: Longest added token, and what the pattern looks ahead (a contraction's two letters, or one character).
        self.reach = max([len(t["content"]) for t in added], default=0) + 4
        self.huge, self.chunk, self.overlap, self.widened = huge, chunk, max(overlap, 2 * self.reach), 0

    def _encode(self, text: str, lo: int, hi: int):
        """(tokens, {place of a pre-token boundary: tokens before it}) of text[lo:hi], by places in the text."""
        e = self.tok.encode(text[lo:hi], add_special_tokens=False)
        words, offsets, at = e.word_ids, e.offsets, {}
        for k, w in enumerate(words):
            if k == 0 or w != words[k - 1]:
                at[lo + offsets[k][0]] = k
        return len(words), at

    def count(self, text: str) -> int:
        if len(text) <= self.huge or not self.plain:
            return len(self.tok.encode_batch_fast([text], add_special_tokens=False)[0])
        total, end = 0, min(len(text), self.chunk)
        n, at = self._encode(text, 0, end)
        base, left = 0, 0  # tokens of the left chunk before its part that counts; where that part begins
        size = self.chunk
        while end < len(text):
            begin = end - self.overlap
            stop = min(len(text), begin + size)
            n2, at2 = self._encode(text, begin, stop)
            common = [p for p in at2 if begin < p <= end - self.reach and p > left and p in at]
            if common:
                p = common[-1]
                total += at[p] - base
                n, at, base, left, end, size = n2, at2, at2[p], p, stop, self.chunk
            else:
                self.widened += 1
                size *= 2
                end = min(len(text), end + size)
                n, at = self._encode(text, left, end)
                base = 0
        return total + n - base


_COUNTERS: dict[str, SplicedCounter] = {}


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, for each row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = SplicedCounter(tokenizer)
        counter, units = _COUNTERS[tokenizer], encoder(tokenizer)
        for batch in batches:
            for part in portions(batch, "text"):
                size = pc.utf8_length(part.column("text")).to_numpy(zero_copy_only=False)
                n, short = np.zeros(part.num_rows, np.int64), size <= counter.huge
                n[short] = units.count(part.column("text").filter(pa.array(short)))
                n[~short] = [counter.count(t) for t in part.column("text").filter(pa.array(~short)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    got = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
