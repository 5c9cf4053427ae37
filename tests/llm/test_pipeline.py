import hashlib

import corpus_pipeline
from meshweave.llm import jaccard, mixing, pieces, quality, tokens


def test_pipeline(spark, folder, docs):
    out = corpus_pipeline.run(spark, folder)
    kept = quality.quality_stage(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect()}
    ids = {r["doc_id"] for r in jaccard.dedup_stage(spark, kept, folder).collect()}
    assert 1 in ids and not ids & {2, 3}
    left = kept.where(kept["doc_id"].isin([i for i in ids if i is not None]) | kept["doc_id"].isNull())
    c = pieces.PieceCodec(tokens.default_path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"] or -1, hashlib.sha256(",".join(map(str, c.sp.encode(r["text"] or ""))).encode()).hexdigest()) for r in mixing.mix(left).collect())
    assert sorted((r["doc_id"] or -1, r["ids_sha256"]) for r in out.collect()) == want
