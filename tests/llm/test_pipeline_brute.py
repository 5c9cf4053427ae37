import hashlib
import random

import corpus_pipeline
import duckdb
from test_text_operators import brute

from meshweave.llm import mixing, pieces, quality, tokens


def edited(words, *places):
    return [f"new{k}x" if k in places else w for k, w in enumerate(words)]


def corpus():
    """Chains whose ends do not link by themselves, look-alikes just below the bound, copies, bad texts, repeated rows and null ids."""
    rng, rows, n = random.Random(11), [], 0
    for c in range(6):
        w = [f"word{rng.randrange(10**6)}" for _ in range(80)]
        chain = [w, edited(w, 10), edited(w, 10, 30), edited(w, 10, 30, 50)]
        ids = rng.sample(range(n, n + 6), 6)
        n += 10
        rows += [(i, " ".join(t), "abc"[c % 3]) for i, t in zip(ids, chain)]
        rows += [(ids[4], " ".join(edited(w, 5, 45)), None if c == 5 else "b")]  # a clean look-alike
        rows += [(ids[5], "  ".join(x.upper() if c % 2 else x for x in chain[c % 4]), "c")]  # a copy by its words
    rows += [(n, "too short", "a"), (n + 1, "same words again " * 30, "a"), (n + 2, None, "b"), (None, rows[0][1], "a"), (None, rows[3][1], None), rows[1], rows[4], rows[4]]
    return rows


def test_rows_of_the_pipeline(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus()]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    load = lambda name, held: con.execute(f"create or replace table {name} (doc_id bigint, text varchar, source varchar)") and con.executemany(f"insert into {name} values (?, ?, ?)", held)

    # one row at a time, as the SQL of the rules keeps no text
    kept = []
    for i, t, _, s, _ in rows:
        load("documents", [(i, t, s)])
        if con.execute(f"select kept from ({quality.OP7_SQL})").fetchone()[0]:
            kept.append((i, t, s))
    assert 30 < len(kept) < len(rows)

    label = brute([{"doc_id": i, "text": t} for i, t, _ in kept], 5, 80)
    left = sorted({r for r in kept if r[0] is not None and label[r[0]][1] == r[0]}) + [r for r in kept if r[0] is None]
    assert sum(r[0] is not None for r in left) == 12  # a chain with its copies leaves one, a look-alike stays

    load("documents", left)
    c = pieces.PieceCodec(tokens.default_path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(",".join(map(str, c.sp.encode(t))).encode()).hexdigest()
    # null ids are told apart by their sources
    by = {(i, s): t for i, t, s in left}
    want, sizes = [], con.execute(f"select doc_id, size, source_size, taken from ({mixing.OP9_SQL})").fetchall()
    total = {s: sum(len(t.split()) for _, t, x in left if x == s) for s in {x for _, _, x in left}}
    for i, size, source_size, taken in sizes:
        s = next(s for (j, s) in by if j == i and total[s] == source_size)
        want += [(-1 if i is None else i, sha(by[i, s]))] * (taken // size)
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want)
