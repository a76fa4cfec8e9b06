"""Operators over rows that the given tables don't have."""

import hashlib

from reelspan.llm import ngram_join, simhash, substring_dedup


def test_op4_runs_of_one_minimiser_that_agree_in_40_bits_of_their_hash(spark):
    seed = "mmdsswxvatqavombtsdl"
    rows = [(1, "sesosvrljadofksfpjnqzkaznplwnl" + seed), (2, "cdazufuvasfkriklvnsh qdwmqiiqg" + seed), (3, "sgbg jkuamtlg cpnzqjfaztmdavni" + seed), (4, "jqpgmrpjwtiwdxqwawnjvchkqwhm q" + seed)]
    runs = substring_dedup.Texts([i for i, _ in rows], [t.encode() for _, t in rows], 50)
    assert len(set(runs.seed.tolist())) == 1 and len({x >> 24 for x in runs.run.tolist()}) == 2 and len(set(runs.run.tolist())) == 4
    df = spark.createDataFrame([*rows, (9, rows[3][1])], "doc_id long, text string")
    for block_bytes in (1 << 22, 60):  # all in one block, and apart
        got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, block_bytes=block_bytes).collect()}
        assert got == {i: (0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows} | {9: (50, hashlib.sha256(b"").hexdigest())}


def test_keep_one_judges_rows_not_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    rows = [(5, one, "r"), (5, one, "r"), (5, two, "s"), (7, two, "t"), (None, one, "u"), (None, three, "v"), (None, three, "v"), (8, None, "w"), (8, "", "x")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted((r.n, r.doc_id) for r in kept.collect()) == [("r", 5), ("s", 5), ("v", None), ("w", 8), ("x", 8)]


def test_op3_has_a_row_for_each_input_row(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(None, two), (None, one), (20, one), (20, two), (20, two), (21, "x" + two), (22, None)]
    got = simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        want.append((i or 0, len(t), hashlib.sha256((t[: len(t) - cut] + follow[:cut]).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all((r.near_classes is not None) == (r.doc_id == 20) for r in got)
    assert [r.class_id for r in got if r.doc_id == 20] == [None] * 3 and {r.class_id for r in got if r.doc_id in (21, 22)} == {21, 22}
