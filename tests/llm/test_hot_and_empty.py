import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.llm import fingerprints, html_text, jaccard, pieces, quality, registry, token_counts, token_frames, tokens, urls, warc
from meshweave.plans.lineage import new_path

PAGE_QUERIES = ("op2_html_extract", "op4_url_filter", "op5_warc")


def word_text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows have a null id, a third one id, and some texts are held by many rows."""
    rng = random.Random(5)
    rows = [(None, word_text(rng, 60), "s") for _ in range(200)] + [(7, word_text(rng, 60), "s") for _ in range(200)] + [(100 + k, word_text(rng, 60), "t") for k in range(200)]
    rows += [(None, "same text again", None)] * 40 + [(7, "same text again", "s")] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def largest(df, *by):
    return max(r["count"] for r in df.groupBy(*by).count().collect())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    import corpus_pipeline

    for name, query in {**registry.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, f"file://{tmp_path}").collect() == [], name


def test_clashing_columns_and_nulls_of_pages(spark, tmp_path):
    rows = [(1, "http://a.net/es/x", "<p>one</p>"), (1, "http://a.net/es/x", "<p>one</p>"), (2, None, None), (None, "http://b.com/", ""), (None, None, None), (3, "http://b.com/", "<p>one</p>")]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = plain.withColumns({c: F.lit("clash") for c in ("id", "host", "path", "text", "digest", "first", "row", "payload", "block", "key", "verdict", "rule", "n_chars")})
    for name, df in (("plain", plain), ("wide", wide)):
        df.write.parquet(f"file://{tmp_path}/{name}/pages.parquet")
    for q in PAGE_QUERIES:
        a, b = (sorted(map(repr, (r.asDict() for r in registry.QUERIES[q](spark, f"file://{tmp_path}/{n}").collect()))) for n in ("plain", "wide"))
        assert a == b and len(a) == len(rows)


def test_hot_ids_are_dealt_out(spark, hot, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small shards would be put together
    try:
        deal_out(spark, hot, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def deal_out(spark, hot, tmp_path):
    hot.write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_merkle_fingerprints", "op9_curriculum_mix"):
        want = con.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        near = lambda t: tuple(round(x, 6) if isinstance(x, float) else x for x in t)
        got = sorted((near(r[c] for c in names) for r in registry.QUERIES[name](spark, f"file://{tmp_path}").collect()), key=repr)
        assert got == sorted(map(near, want.fetchall()), key=repr), name
    own = hot.select(F.col("doc_id").alias("id"), "text")
    assert largest(fingerprints.with_next(own, lambda d: d.withColumn("at", F.col("b"))), "at") < 200
    shards = token_frames.write_shards(own, new_path(spark, "hot"), tokens.default_path("byte_bpe_50k.json"), 2)
    assert sum(s["docs"] for s in shards) == own.count() and max(s["docs"] for s in shards) < 400
    got = [tuple(r) for r in token_frames.read_shards(spark, shards).orderBy("start").select("id", "n_tokens").collect()]
    assert [i for i, _ in got] == sorted((i for i, _ in got), key=lambda i: (i is not None, i or 0))


def test_over_limit_and_ablations(spark, docs):
    enc = tokens.load_tokenizer(tokens.default_path("byte_bpe_50k.json"))
    for r in token_counts.count_tokens(docs.select("doc_id", "text"), tokens.default_path("byte_bpe_50k.json"), limit=3).collect():
        assert r["over_limit"] == (r["n_tokens"] > 3)
    assert enc is not None
    book = quality.apply_policy(quality.ledger(docs))
    bits = [r["fail_bits"] for r in book.collect()]
    for r in quality.ablations(book).collect():
        b = quality.bit(r["rule"])
        want = (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(not x & ~b for x in bits), len(bits))
        assert (r["n_failed"], r["n_only"], r["n_kept_without"], r["n_documents"]) == want


def test_rounds_of_a_template_are_bounded(spark, monkeypatch):
    """Documents that share most of their words but do not link, in buckets far larger than a group."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(300)]
    rows = []
    for k in range(160):
        own = [f"x{k}_{j}" for j in range(44)]
        rows.append((k, " ".join(common + own)))
    rows += [(1000 + k, rows[5 * k][1] + " and more") for k in range(6)]  # near copies among them
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    turns = []
    plain = jaccard._grouped
    monkeypatch.setattr(jaccard, "_grouped", lambda *a: turns.append(1) or plain(*a))
    got = {r[0]: r[2] for r in jaccard.components(df, 4, 85, group=20).collect()}
    assert got == {**{k: k for k in range(160)}, **{1000 + k: 5 * k for k in range(6)}}
    assert 1 <= len(turns) <= jaccard.PIVOTS + 1


def test_packs_hold_all_rows():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1 << 48), (500, 1 << 48), (3000, 50), (90_000, 1 << 48)):
        sig = np.sort(rng.integers(0, top, n).astype(np.uint64))
        for ids in (rng.integers(-5, 70_000, n), rng.integers(-(1 << 62), 1 << 62, n)):
            a, b = jaccard._unpack(jaccard._pack(sig, ids))
            assert (a == sig).all() and (b == ids).all()


def test_false_magic_in_compressed_data(spark, tmp_path):
    """Members whose stored bytes hold whole gzip members and broken heads: only true records are found."""
    import gzip
    import zlib

    def stored(data):  # no compression, so that the bytes of the payload stand in the file
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    fake = b"\x1f\x8b\x08" + b"junk" * 3 + gzip.compress(b"no record") + gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc")
    raw, starts = b"", []
    for k in range(6):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(fake) + fake
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}:{k}>\r\nWARC-Payload-Digest: sha1:{warc.sha1_base32(fake)}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        starts.append(len(raw))
        raw += stored(head + block + b"\r\n\r\n")
    path = tmp_path / "planted.warc.gz"
    path.write_bytes(raw)
    for split in (1 << 20, 61):
        got = warc.read_archive(spark, [f"file://{path}"], split=split).collect()
        assert sorted(r["offset"] for r in got) == starts and {r["payload_bytes"] for r in got} == {len(fake)}


def test_record_ids_differ(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (1, None, "b"), (None, None, "a"), (2, "u", "a")], "id long, url string, payload string")
    files = warc.write_archive(rows, new_path(spark, "warc-ids"))
    found, refers = collections.Counter(), set()
    for f in files:
        size = f["size"]
        for _, fields, _ in warc.Members(warc.open_input(f["uri"]), size).records(0, size):
            found[fields["WARC-Record-ID"]] += 1
            refers.add(fields.get("WARC-Refers-To"))
    assert set(found.values()) == {1} and len(found) == 5 and refers - {None} <= set(found)


def test_hot_urls_and_payloads(spark):
    rows = [(k, None if k % 3 else f"http://h{k}.net/fr/{k}", "<p>one</p>" if k % 2 else f"<p>{k}</p>") for k in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = collections.Counter(tuple(r)[3:] for r in urls.judge(df, urls.rule_table(spark)).collect())
    assert got == {("net/fr/", "block"): 300, (None, "allow"): 600}
    assert html_text.extract_pages(df).where("n_chars > 0").count() == 900


def double_array(keys):
    """A compiled character map of {bytes: bytes}, built the plain way."""
    text, at = b"", {}
    for k, v in keys.items():
        at[k] = len(text)
        text += v + b"\0"
    units, used = {0: 0}, {0}

    def place(node, prefix):
        labels = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)} | ({0} if prefix in keys else set()))
        if not labels:
            return
        offset = next(o for o in range(1, 1 << 16) if all((node ^ o ^ c) not in used for c in labels) and all((node ^ o ^ c) < 1 << 14 for c in labels))
        units[node] = units.get(node, 0) | offset << 10 | (1 << 8 if 0 in labels else 0)
        children = {c: node ^ offset ^ c for c in labels}
        used.update(children.values())
        for c, child in children.items():
            units[child] = 1 << 31 | at[prefix] if c == 0 else c
        for c, child in children.items():
            if c:
                place(child, prefix + bytes([c]))

    place(0, b"")
    n = -(-(max(units) + 1) // 256) * 256
    array = np.array([units.get(k, 0) for k in range(n)], "<u4").tobytes()
    return len(array).to_bytes(4, "little") + array + text


def test_character_map(tmp_path):
    """A model with a map: normalised texts and spans against the library."""
    def field(number, data):
        size, out = len(data), bytearray()
        while size > 127:
            out.append(size & 127 | 128)
            size >>= 7
        return bytes([number << 3 | 2]) + bytes([*out, size]) + data

    keys = {"é".encode(): b"e", "ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "ＡＢ".encode(): b"xyz", "　".encode(): b" ", b"\t": b" "}
    model = open(tokens.default_path("piece_bpe_32k.model"), "rb").read()
    path = tmp_path / "mapped.model"
    path.write_bytes(model + field(pieces.NORMALIZER, field(pieces.CHARS_MAP, double_array(keys))))  # messages of one number merge
    c = pieces.PieceCodec(str(path))
    assert c.map and not c.apart
    texts = ["café ﬁn", "ＡＢ Ａ x", "　a\tb", "plain", "", "日本é🙂", "ＡＡＢé"]
    flat, counts = c.encode_flat(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == c.sp.encode(texts)
    begins, ends = c.spans_flat(texts, flat, counts)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        normal, _ = c.normalize(t)
        assert normal.decode() == "".join(c.sp.id_to_piece(i) if not c.sp.is_byte(i) else "" for i in c.sp.encode(t)) or any(c.sp.is_byte(i) for i in c.sp.encode(t))
        b, e = begins[cuts[k] : cuts[k + 1]], ends[cuts[k] : cuts[k + 1]]
        assert (b <= e).all() and (not len(b) or (b[0] == 0 and e[-1] == len(t.encode())))
