"""One table of odd rows for every operator and stage: null and repeated ids, a very long text, clashing columns, no rows."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import ngram_join, packing, piece_fst, pu_quality, quality_rules, simhash, substring_dedup, token_counts, token_files, warc
from reelspan.llm.queries import vocabulary

rng = random.Random(11)
WORDS = "the of and cat dog house tree river stone walked slowly over under many people saw".split()
LONG = " ".join(rng.choice(WORDS) + rng.choice(["", "s", ",", "▁x", "é"]) for _ in range(40_000))
ROWS = [(None, "no id here"), (None, "no id here"), (1, None), (2, ""), (3, LONG), (3, "another text of three"), (4, LONG + " end"), (5, "x" * 60_000), (5, "x" * 60_000)]
SCHEMA = "doc_id long, text string, block int, salt int, score double, n_tokens string, row string, unit string, _null_text int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2, 0.5, "n", "r", "u", 0) for i, t in ROWS], SCHEMA).repartition(3).cache()


BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
OPERATORS = {
    "op1": lambda d: piece_fst.round_trip(d, vocabulary(PIECES)),
    "op2": lambda d: token_files.token_files(d, vocabulary(BPE), 2),
    "op3": simhash.fingerprint_documents,
    "op4": substring_dedup.dedup,
    "op5": quality_rules.quality_rules,
    "op6": lambda d: token_counts.token_counts(d, vocabulary(PIECES)),
    "op7": lambda d: pu_quality.classify(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")),
    "op10": ngram_join.jaccard_components,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(odd, name):
    rows = OPERATORS[name](odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS)
    assert OPERATORS[name](odd.where("doc_id = 99")).count() == 0


def test_long_texts_equal_the_libraries(odd):
    import sentencepiece
    from tokenizers import Tokenizer

    model, bpe = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES)), Tokenizer.from_file(vocabulary(BPE))
    counted = sorted((r.doc_id or 0, r.n_tokens) for r in OPERATORS["op6"](odd).collect())
    assert counted == sorted((i or 0, len(model.encode(t or ""))) for i, t in ROWS)
    crcs = sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in OPERATORS["op1"](odd).collect())
    assert crcs == sorted((i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in ROWS for x in [model.encode(t or "")])
    filed = sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in OPERATORS["op2"](odd).collect())
    assert filed == sorted((i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in ROWS for x in [[*bpe.encode(t or "", add_special_tokens=False).ids, 2]])


def test_op9_rows(odd):
    """Every id lies in one piece with its own checksum; sequences are gapless; at most one in fifty tokens is padding."""
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(vocabulary(BPE))
    ids = sorted((i or 0, np.array([*bpe.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ROWS)
    rows = packing.pack(odd, vocabulary(BPE), 1, 2048).collect()
    want = Counter()
    for i, raw in ids:
        n = len(raw) // 4
        assert {r.doc_tokens for r in rows if (r.doc_id or 0) == i} <= {len(x) // 4 for j, x in ids if j == i}
        for r in {(r.start, r.length) for r in rows if (r.doc_id or 0) == i and r.doc_tokens == n}:
            want[i, r[0], r[1], zlib.crc32(raw[4 * r[0] : 4 * (r[0] + r[1])]), n] += 1
    assert Counter((r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by_doc = defaultdict(int)
    for r in rows:
        by_doc[r.doc_id or 0] += r.length
    assert by_doc == {i: sum(len(x) // 4 for j, x in ids if j == i) for i, _ in ids}
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(odd.where("doc_id = 99"), vocabulary(BPE), 1, 2048).count() == 0


def test_op9_takes_the_shortest_pack():
    assert {p for p, _ in packing.shortest_pack_first({1900: 1, 1000: 1, 100: 1}, 2048)} == {((1900, 1),), ((1000, 1), (100, 1))}


def _model(pieces, bpe):
    field = lambda n, raw: bytes([n << 3 | 2, len(raw)]) + raw
    out = b""
    for text, score, kind in pieces:
        out += field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    return out + field(2, bytes([3 << 3, 2 if bpe else 1])) + field(3, field(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0]))


@pytest.mark.parametrize("bpe", [True, False])
def test_op1_user_and_unused_pieces(bpe):
    """Pieces that are taken first, and pieces that are never taken, as the library has them."""
    import sentencepiece

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("ab", -1, 5), ("abc", -2, 1), ("bc", -3, 1), ("cab", 0, 4), ("a", -4, 1), ("b", -5, 1), ("c", -6, 1), ("▁", -7, 1)]
    raw = _model(pieces, bpe)
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    fst = piece_fst.PieceTransducer(raw)
    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 12)))
        assert fst.encode(text) == model.encode(text), text


def test_op7_prior():
    """The prior is found from positives and unlabelled alone, and rows labelled 0 change nothing."""
    r = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        positive, free = r.normal(2, 1, 1500), np.where(r.random(3000) < share, r.normal(2, 1, 3000), r.normal(-2, 1, 3000))
        assert abs(pu_quality.estimate_prior(positive, free) - share) < 0.08


def test_op8_rows(spark):
    rows = [(None, "u", "page"), (3, None, "page"), (2, "a\r\nb", "page"), (2, "a\r\nb", "page"), (2, "c", None), (5, "d", "é" * 60_000), (9, "e", "é" * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'k' AS key", "2 AS origin")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    assert got == Counter([(None, 4, "revisit", 2), (3, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (2, 0, "response", None), (5, 120_000, "response", None), (9, 120_000, "revisit", 5)])
    assert warc.archive(pages.where("page_id = 77")).count() == 0


def test_op8_frequent_payloads(spark):
    """Frequent and rare payloads, ids that are null in bulk: the same roles whatever counts as frequent."""
    rows = [(k, "error") for k in range(1000, 1600)] + [(None, "error")] * 300 + [(None, "alone")] * 40 + [(k, f"p{k // 3}") for k in range(900)] + [(2000, "one")]
    want = Counter()
    for page, html in rows:
        same = [p for p, h in rows if h == html and p is not None]
        first = min(same, default=None)
        want[page, len(html), "response" if first in (None, page) else "revisit", None if first == page else first] += 1
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    for hot in (1, 10, 1000):
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages, hot).collect())
        assert got == want, hot


def test_stages(spark, odd, tmp_path):
    """Stages keep the columns, whatever their names, and take a table without rows."""
    import corpus_pipeline

    spark.createDataFrame([(3, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, odd.where("doc_id = 99")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == odd.columns and out.count() <= rows.count()
        assert corpus_pipeline.pack(spark, rows, str(tmp_path)).count() >= rows.count()
    assert ngram_join.keep_one(odd).count() == 6  # blank texts stay, one of each group of the others
    # What a smaller row has is removed: the long text of 4 but for its end, and nothing of rows that share an id.
    kept = {r.text for r in substring_dedup.keep_first(odd.where("doc_id in (3, 4)")).collect()}
    assert LONG in kept and "another text of three" in kept and not any(t.startswith(LONG) and t != LONG for t in kept)


def test_meet(spark):
    """A join with frequent keys by broadcast is the plain join, whatever counts as frequent."""
    from reelspan.llm import common

    rows = spark.createDataFrame([(k % 7 if k < 500 else k, k % 3, k) for k in range(900)] + [(None, 1, -1)], "a long, b long, v long")
    facts = rows.where("a IS NOT NULL AND a % 2 = 0").groupBy("a", "b").agg(F.count("*").alias("copies"), F.sum("v").alias("s"))
    for how in ("inner", "left"):
        want = sorted(rows.join(facts.drop("copies"), ["a", "b"], how).select("a", "b", "v", "s").collect(), key=str)
        for hot in (1, 20, 100_000):
            assert sorted(common.meet(rows, facts, ["a", "b"], 901, hot, how).collect(), key=str) == want
