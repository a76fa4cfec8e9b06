"""The classifier against plain code, with hot ids and few positives; each stage of the pipeline against a plain version."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelspan.llm import pu_quality, quality_rules

rng = random.Random(23)
WORDS = "the of and to in a is that for it as was with be on are this from cat dog house tree river stone walked slowly over under many people saw night light".split()


def prose(n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.6) for _ in range(n)).capitalize() + "."


def junk(n):
    return " ".join(rng.choice(["BUY", "$$$", "&&", "click", "click", "***", "WIN!!!", "|"]) for _ in range(n))


def made():
    passage = prose(30).lower()[:-1]
    docs = [(i, prose(rng.randrange(60, 160)) if i % 3 else junk(rng.randrange(20, 120))) for i in range(200)]
    docs = [(i, f"{t[:-1]} {passage} {prose(40).lower()}" if i % 6 == 1 else t) for i, t in docs]  # a passage that many share
    for i in range(200, 295):  # near and exact copies
        text = docs[rng.randrange(200)][1]
        words = text.split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    return docs + [(295, None), (296, ""), (297, "short text"), (298, docs[1][1]), (299, docs[1][1])]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    docs = made()
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(0, 200, 2)]
    at = tmp_path_factory.mktemp("made")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at), docs, labels


def test_scores_equal_a_plain_fit(spark, table):
    """Samples hold all rows here, so the model is that of all rows of the folds in the order of their hashes."""
    at, docs, labels = table
    frame, marks = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    keyed = frame.where(pu_quality.fold(F.col("doc_id")) != 2).select("doc_id", *[F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(s)).alias(s) for s in ("labelled", "unlabelled")]).collect()
    text, good = dict(docs), {i for i, q, _ in labels if q == 1}
    plain = lambda ids: np.array([pu_quality.features((text[i] or "").encode()).astype(np.float16) for i in ids], np.float32)
    model = pu_quality.fit(plain([r.doc_id for r in sorted(keyed, key=lambda r: r.labelled) if r.doc_id in good]), plain([r.doc_id for r in sorted(keyed, key=lambda r: r.unlabelled)]))
    want = {i: 1 / (1 + np.exp(-np.clip(((pu_quality.features((t or "").encode()) - model.mean) / model.scale) @ model.weights + model.bias, -40, 40))) for i, t in docs}
    got = {r.doc_id: r for r in pu_quality.classify(frame, marks).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.score == pytest.approx(want[i], abs=1e-5) and (r.predicted == (r.score >= 0.7))
    assert sum((got[i].predicted == 1) != (i % 3 != 0) for i in range(200)) <= 10


def test_risk_gradient():
    """Where the negative part is above 0 (below, its gradient is taken back) no step aside lowers the risk."""
    r = np.random.default_rng(5)
    p, u = r.normal(0.5, 1, (400, 3)), np.where(r.random((800, 1)) < 0.4, r.normal(0.5, 1, (800, 3)), r.normal(-0.5, 1, (800, 3)))
    w, bias, risks = pu_quality.minimise(p, u, 0.4, steps=2000, decay=0.05)
    minus = lambda v: np.logaddexp(0, u @ v[:3] + v[3]).mean() - 0.4 * np.logaddexp(0, p @ v[:3] + v[3]).mean()

    def risk(v):
        return 0.4 * np.logaddexp(0, -(p @ v[:3] + v[3])).mean() + max(0.0, minus(v)) + 0.025 * (v[:3] ** 2).sum()

    assert minus(np.append(w, bias)) > 0.01

    at = np.append(w, bias)
    for k in range(4):
        step = np.eye(4)[k] * 0.05
        assert risk(at) <= risk(at + step) + 1e-4 and risk(at) <= risk(at - step) + 1e-4


def test_hot_ids_stay_bounded(spark):
    """10,000 equal rows of one id are one row of a sample, 5,000 texts of one positive id no more than the sample holds."""
    equal = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    many = spark.range(5_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = equal.unionByName(many)
    assert len(pu_quality.matrix(pu_quality.sample(equal, 100, "s"))) == 1
    assert len(pu_quality.matrix(pu_quality.sample(rows, 100, "s"))) == 100
    model = pu_quality.train(rows, spark.createDataFrame([(i, 1) for i in (1, 3)] * 2, "doc_id long, quality int"), 50, 80)
    assert 0.05 <= model.prior <= 0.95 and np.isfinite(model.weights).all()
    assert pu_quality.classify(rows, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).count() == 15_000


@pytest.mark.parametrize("n", [1, 2, 10, 40, 49, 50, 51, 300])
def test_prior_has_no_switch(n):
    """With few positives the estimate is coarser, not another."""
    r = np.random.default_rng(n)
    found = [pu_quality.estimate_prior(r.normal(2, 1, n), np.where(r.random(2000) < 0.8, r.normal(2, 1, 2000), r.normal(-2, 1, 2000))) for _ in range(20)]
    assert abs(np.median(found) - 0.8) < (0.5 if n < 5 else 0.15 if n < 50 else 0.12)


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_near(rows):
    """The smallest row of each component of links."""
    own, at = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {(i, t) for i, t in rows if root(i) == i}


def plain_repeats(rows):
    seen, out = set(), set()
    for i, t in sorted(rows):
        raw = (t or "").encode()
        hit = [p for p in range(len(raw) - 49) if raw[p : p + 50] in seen]
        gone = {q for p in hit for q in range(p, p + 50)}
        out.add((i, bytes(b for q, b in enumerate(raw) if q not in gone).decode("utf-8", "ignore")))
        seen |= {raw[p : p + 50] for p in range(len(raw) - 49)}
    return out


def test_stages_one_by_one(spark, table):
    """Each stage on what the one before kept; the last one holds every token of every text once."""
    import duckdb
    from tokenizers import Tokenizer

    from reelspan.llm.queries import vocabulary

    at, docs, _ = table
    rows = lambda df: {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    frame, stages = spark.read.parquet(f"{at}/documents.parquet"), dict(corpus_pipeline.STAGES)
    kept = stages["classify"](spark, frame, at).cache()
    good = {r.doc_id for r in pu_quality.classify(frame, spark.read.parquet(f"{at}/labels.parquet")).collect() if r.score >= 0.7}
    assert rows(kept) == {(i, t) for i, t in docs if i in good} and 100 < len(good) < 300

    ruled = stages["rules"](spark, kept, at).cache()
    documents = kept.toPandas()  # noqa: F841
    passed = {x[0] for x in duckdb.sql(quality_rules.oracle_sql()).fetchall() if x[-1]}
    assert rows(ruled) == {(i, t) for i, t in rows(kept) if i in passed} and len(passed) > 100

    single = stages["near_duplicates"](spark, ruled, at).cache()
    assert rows(single) == plain_near(rows(ruled)) and single.count() < ruled.count()

    cut = stages["repeats"](spark, single, at).cache()
    assert rows(cut) == plain_repeats(rows(single)) and rows(cut) != rows(single)

    tool, tokens = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), defaultdict(int)
    for r in stages["pack"](spark, cut, at).collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(tool.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows(cut)}


def test_run_on_empty_tables(spark, table, tmp_path):
    at, docs, labels = table
    for name, (d, m) in {"none": ([], []), "unlabelled": (docs[:30], []), "undocumented": ([], labels)}.items():
        spark.createDataFrame(d, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(m, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert os.path.isdir(tmp_path / name) and corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
