"""The normaliser and the models that have a rule table, against the library; hot fingerprints against a plain count."""

import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelspan.llm import piece_fst, simhash
from reelspan.llm.normaliser import Normaliser, rules

sentencepiece = pytest.importorskip("sentencepiece")
rng = random.Random(11)
FEW = list("abAB  \t\n▁é①ﬁﷺ　 ​́e¨각ｶﾞΣß\x00")


def _text(most=14):
    return "".join(rng.choice(FEW) if rng.random() < 0.8 else chr(rng.randrange(32, 0x3000)) for _ in range(rng.randint(0, most)))


def _spec(rule, squeeze, prefix):
    tool = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    return tool, next(dict(piece_fst._fields(v)) for n, v in piece_fst._fields(tool.serialized_model_proto()) if n == 3)


@pytest.fixture(scope="module")
def table():
    return _spec("nmt_nfkc", True, True)[1][2]


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_rule_table(table, squeeze, prefix):
    tool, _ = _spec("nmt_nfkc", squeeze, prefix)
    mine = Normaliser(rules(table), (), squeeze, prefix)
    for text in ["", " ", "   ", "▁", " ▁ ", *(_text() for _ in range(1500)), _text(200_000)]:
        assert mine.apply(text) == tool.Normalize(text), ascii(text[:50])


def _field(n, raw):
    size, out = len(raw), b""
    while True:
        out += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            return bytes([n << 3 | 2]) + out + raw


@pytest.mark.parametrize("bpe", [True, False])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_model_with_rule_table_and_user_pieces(table, bpe, squeeze):
    """Composition of the normaliser with the pieces; the user's "①" and "ﬁ" are not rewritten, "é" is in no piece."""
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("①", -1, 4), ("ﬁ", -1, 4), *((x, -2 - k / 8, 1) for k, x in enumerate(["ab", "▁a", "▁ab", "fi", "▁", "a", "b", "e", "f", "i", "1", "A", "B"]))]
    raw = b"".join(_field(1, _field(1, t.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", w) + bytes([3 << 3, kind])) for t, w, kind in pieces)
    raw += _field(2, bytes([3 << 3, 2 if bpe else 1])) + _field(3, _field(1, b"nmt_nfkc") + _field(2, table) + bytes([3 << 3, 1, 4 << 3, squeeze]))
    model, fst = sentencepiece.SentencePieceProcessor(model_proto=raw), piece_fst.PieceTransducer(raw)
    for _ in range(600):
        text = "".join(rng.choice("ab fi①ﬁ1Ａ　A") for _ in range(rng.randint(0, 12)))
        assert fst.encode(text) == model.encode(text), text


def test_hot_fingerprints_join_as_others(spark):
    rows = [(i, 7 if i % 3 == 0 else i % 40) for i in range(300)]
    found = spark.createDataFrame(rows, "doc_id long, fp long")
    copies = Counter(fp for _, fp in rows)
    classes = spark.createDataFrame([(fp, fp * 10, None if fp % 2 else fp, n) for fp, n in copies.items()], "fp long, class_id long, near long, copies long")
    for hot in (2, 5, 40, 1000):
        got = sorted((r.doc_id, r.fp, r.class_id, r.near) for r in simhash.with_classes(found, classes, 300, hot).collect())
        assert got == [(i, fp, fp * 10, None if fp % 2 else fp) for i, fp in rows]
    assert simhash.with_classes(found.where(F.lit(False)), classes.where(F.lit(False)), 0).count() == 0
