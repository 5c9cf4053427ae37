import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from meshweave.llm import fingerprints, jaccard, mixing, pieces, quality, registry, token_counts, token_frames, tokens


def local(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.mark.parametrize("name", ["op1_merkle_fingerprints", "op7_quality_rules", "op9_curriculum_mix"])
def test_against_sql(spark, docs, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder[7:]}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, folder), con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    key = lambda t: tuple((x is None, round(x, 6) if isinstance(x, float) else x) for x in t)
    assert sorted(map(key, (tuple(r[c] for c in names) for r in got.collect())), key=repr) == sorted(map(key, want.fetchall()), key=repr)


def test_fingerprints_tell_equal_and_edited(spark):
    text = "\n".join(f"Paragraph {k} says something. And more." for k in range(40))
    rows = spark.createDataFrame([(1, text), (2, text), (3, text.replace("Paragraph 20", "Passage 20"))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(rows).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert 0.9 < got[2]["near_next"] < 1 and got[3]["fingerprint"] != got[2]["fingerprint"]
    assert fingerprints.compare_edits(rows.limit(0)).count() == 0


def test_ledger(spark, docs):
    book = quality.apply_policy(quality.ledger(docs))
    found = {r["rule"]: r for r in quality.ablations(book).collect()}
    assert found["few_words"]["n_failed"] == book.where("n_words < 50").count()
    assert {r["n_documents"] for r in found.values()} == {docs.count()}
    assert quality.quality_stage(spark, docs, "").columns == docs.columns


def test_token_frames(spark, folder, docs, monkeypatch):
    monkeypatch.setattr(token_frames, "READ_IDS", 5_000)
    enc = tokens.load_tokenizer(tokens.default_path("byte_bpe_50k.json"))
    rows = sorted(local(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r in rows:
        ids = [*enc.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in registry.QUERIES["op3_token_frames"](spark, folder).orderBy("start").collect()]
    assert got == want


def test_frames_are_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_IDS", 10)
    out = token_frames.Output(f"file://{tmp_path}", "s", ".zst")
    w = token_frames.ShardWriter(out, 2)
    docs = {k: np.arange(n, dtype=np.uint32) + k for k, n in enumerate([3, 0, 25, 10, 1])}
    for k, ids in docs.items():
        w.add(k, ids)
    w.finish()
    r = token_frames.ShardReader(out.uri)
    assert all((r.ids(k) == ids).all() for k, ids in docs.items()) and len(r.packed) > 3
    raw = bytearray(open(out.path, "rb").read())
    raw[10] ^= 255
    open(out.path, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017
        token_frames.ShardReader(out.uri).ids(0)


def test_token_counts(spark, folder, docs):
    enc = tokens.load_tokenizer(tokens.default_path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(enc.encode(r["text"] or "", add_special_tokens=False).ids)) for r in local(docs))
    assert sorted((r[0] or -1, r[1], r[2]) for r in registry.QUERIES["op6_token_counts"](spark, folder).collect()) == want


def test_splices_hold_and_widen():
    path = tokens.default_path("byte_bpe_50k.json")
    c = token_counts.SplicedCounter(path, huge=50, chunk=120, overlap=40)
    texts = ["it's <|endoftext|> a  test 'll\n\n " * 60, "x" * 900 + " end", "日本語 " * 200, " " * 500 + "a", "ab<|endoftext|>" * 80, "1 22  333\t\t4444 " * 70]
    for t in texts:
        assert c.count(t) == len(c.tok.encode(t, add_special_tokens=False).ids)
    assert c.widened


def test_units_and_pieces(spark, docs):
    odd = ["", " ", "  a  b ", "a▁b c", "naïve 日本\tx\n", "<s> </s>", "\x00\x01", "é 🙂 z"]
    c = pieces.PieceCodec(tokens.default_path("piece_bpe_32k.model"))
    got = c.encode(odd + odd)
    assert [list(x[0]) for x in got] == c.sp.encode(odd + odd)
    for t, (ids, _) in zip(odd, got):
        begin, end = c.spans(t, ids)
        assert (begin <= end).all() and (not len(ids) or end[-1] == len(t.encode()))
    e = tokens.UnitEncoder(tokens.default_path("byte_bpe_50k.json"))
    assert [x.tolist() for x in e.encode(odd)] == [x.ids for x in e.tok.encode_batch(odd, add_special_tokens=False)]
    full = pieces.encode_documents(docs.where("doc_id = 8"), tokens.default_path("piece_bpe_32k.model")).first()
    assert full["decoded"] == full["text"] and full["size"] == "clash"



def test_sentencepiece_query(spark, folder, docs):
    c = pieces.PieceCodec(tokens.default_path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r["doc_id"] or -1, len(i), sha(",".join(map(str, i))), sha(c.sp.decode(i))) for r in local(docs) for i in [c.sp.encode(r["text"] or "")])
    assert sorted((r[0] or -1, *tuple(r)[1:4]) for r in registry.QUERIES["op10_sentencepiece"](spark, folder).collect()) == want


def brute(rows, words, percent):
    sets = {}
    for r in rows:
        w = tuple(quality_words(r["text"] or ""))
        sets[r["doc_id"]] = {w[k : k + words] for k in range(len(w) - words + 1)} or ({w} if w else set())
    label = {k: k for k in sets if k is not None}
    for _ in label:
        for a, b in itertools.combinations(label, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[a] = label[b] = min(label[a], label[b])
    return {k: (len(sets[k]), label[k]) for k in label}


def quality_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))


@pytest.mark.parametrize("group", [jaccard.GROUP, 1])
def test_jaccard_components(spark, docs, group, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 2)
    got = {r[0]: (r[1], r[2]) for r in jaccard.components(docs, 4, 85, group=group).collect()}
    assert got.pop(None)[1] is None
    assert got == brute(local(docs), 4, 85)
    assert jaccard.components(docs.limit(0)).count() == 0


def test_sketches_lose_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 60, 600):
        for share in (0.5, 0.8, 0.9, 0.95, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: max(1, int(share * len(a)))], rng.integers(0, 1 << 63, max(1, n // 9)).astype(np.uint64)]))
            may = jaccard.may_link(len(a), jaccard._sketch(a), len(b), jaccard._sketch(b), 85)
            assert may or not jaccard.linked(a, b, 85)
            assert not may or share >= 0.8 or n < 60


def test_signatures_meet():
    rng = np.random.default_rng(1)
    scheme = jaccard.PartEnum(85)
    for n in [*range(1, 40), 100, 700]:
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for drop in range(int(0.15 * n) + 1):
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int((n - drop) / 0.85) - n if int((n - drop) / 0.85) > n else 0, dtype=np.uint64)])
            if jaccard.linked(np.sort(a), np.sort(b), 85) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(scheme.signatures(np.unique(a)), scheme.signatures(np.unique(b))))


def plain_targets(sizes):
    """Share by weight; stop the sources whose share is too large, and share what is left anew."""
    weights, targets, open_, left = [1 + i % 3 for i in range(len(sizes))], [0.0] * len(sizes), set(range(len(sizes))), sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > 3 * sizes[i] * total}
        for i in over or open_:
            targets[i] = 3.0 * sizes[i] if over else left * weights[i] / total
        left -= sum(targets[i] for i in over)
        open_ = open_ - over if over else set()
    return targets


def test_targets_of_sources(spark):
    rng = random.Random(5)
    cases = [[100, 10, 10], [1, 1], [0, 0], [7], [], [10**6] + [3] * 5, [int(10 ** rng.uniform(0, 6)) for _ in range(700)]]
    for sizes in cases:
        names = sorted({chr(97 + rng.randrange(26)) + rng.choice(["é", "日", "🙂", "\uffee", ""]) + str(i) for i in range(len(sizes))}, key=lambda x: x.encode())
        if len(sizes) > 1:
            names[-1] = None  # last of all
        rows = [(i, s, n) for i, (s, n) in enumerate(zip(names, sizes))] + [(None, s, 0) for s in names[:2]]
        plan = mixing.source_plan(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3)).collect()
        plan.sort(key=lambda r: r["sid"])
        assert [(r["sid"], r["source"], r["source_size"]) for r in plan] == list(zip(range(len(sizes)), names, sizes))
        assert [r["target"] for r in plan] == pytest.approx(plain_targets(sizes))
        assert sum(r["target"] * r["tilt"] for r in plan) == pytest.approx(0, abs=1e-6 * max(1, sum(sizes)))
        assert all(abs(r["tilt"]) <= mixing.MOST_TILT for r in plan) and [r["tilt"] for r in plan] == sorted(r["tilt"] for r in plan)


def test_mix(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    own = docs.select("doc_id", "source", mixing.count_words(docs["text"]).alias("size"))
    assert mixed.count() == sum(len(r["positions"]) for r in mixing.assign(own).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
