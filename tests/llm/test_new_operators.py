"""op11 to op13 against the library and brute force, with odd rows: nulls, repeated ids, ties, blank and very long texts, clashing names, no rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from reelspan.llm import filter_audit, lexical_search, rank_bpe
from reelspan.llm.queries import vocabulary

rng = random.Random(7)
RANKS, PATTERN = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = "the of and Cat dog house TREE river stone's walked don't slowly 12 345 é ÀB 日本 , ... # x".split()


def prose(n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "\t ", ""]) for _ in range(n))


LONG = prose(30_000)
ROWS = [
    (None, "no id here the cat"), (None, "no id here the cat"), (1, None), (2, ""), (2, ""), (3, LONG), (3, "another text of three"), (4, LONG), (5, "x" * 60_000),
    (6, " " * 80_000 + "a"), (7, "\n" * 70_000), (8, "<|endoftext|> a's b'll"), (9, "!" * 40_000 + " end"), (10, "the cat"), (11, "the cat"), (12, "THE CAT"), (13, "ab " * 400), (14, prose(300)),
]
SCHEMA = "doc_id long, text string, lang string, n int, mask string, size string, columns int, step int, part string, digest string, block int, score double, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "", "en", "de"][k % 4], 1, "m", "s", 2, 3, "p", "d", 4, 0.5, "i") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op11_equals_the_library(odd):
    tool = library()
    matches = regex.compile(PATTERN)
    want = Counter()
    for i, t in ROWS:
        ids = [x for m in matches.finditer(t or "") for x in tool._encode_single_piece(m.group())]
        if len(t or "") < 60_000:
            assert ids == tool.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    rows = rank_bpe.round_trip(odd, RANKS, PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert rank_bpe.round_trip(odd.where("doc_id = 99"), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("limit", [1, 2, 7, 50])
def test_op11_parts_change_nothing(limit):
    """Wherever a text is cut its ids stay those of the library; the parts are the text."""
    tool, cutter = library(), rank_bpe.RankEncoder(RANKS, PATTERN, limit)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", " ", " ", "\n", "\x1c", "\xa0", "'", "s", "1", "!", "é", "日", "'ll"]) for _ in range(rng.randint(0, 120)))
        assert "".join(cutter.parts(text)) == text
        assert cutter.encode(text).tolist() == tool.encode_ordinary(text), repr(text)


def test_op11_raw_bytes(spark):
    """Decoding gives the bytes of any ids, cut characters too; ids without bytes and null ids give null."""
    tool = library()
    ids = tool.encode_ordinary("日本語 é")
    rows = [(1, 2, np.array(ids[:2], "<u4").tobytes()), (2, 1, np.array([50_256], "<u4").tobytes()), (3, 1, np.array([4_000_000_000], "<u4").tobytes()), (4, 0, b""), (5, 0, None)]
    got = {r.doc_id: r.raw for r in rank_bpe.decode_documents(spark.createDataFrame(rows, rank_bpe.IDS), RANKS, PATTERN).collect()}
    assert got == {1: bytearray(tool.decode_bytes(ids[:2])), 2: None, 3: None, 4: bytearray(), 5: None}


LABELS = [(3, 1, 0), (4, 1, 1), (4, 0, 0), (10, 1, None), (11, None, 1), (14, 0, 1), (None, 1, 1), (77, 1, 1)]


def test_op12_brute_force(spark, odd):
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    good, toxic = ({i for i, q, t in LABELS if i is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for r in odd.collect():
        t, w = r.text or "", re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        copy = r.doc_id is not None and any(i is not None and i < r.doc_id and (u or "") == t for i, u in ROWS)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        docs.append((r.lang or "", {x for x in bad if bad[x]}, r.doc_id in good, r.doc_id in toxic))
    want, removed = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for k, x in enumerate(order):
                goes = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                all_of = [d for d in docs if d[0] == part and x in d[1]]
                want[part, order, k + 1] = (len(left), len(goes), len(all_of) - len(goes), sum(d[1] == {x} for d in all_of), sum(d[2] for d in goes), sum(d[3] for d in goes))
                removed[part, x] += len(goes)
    rows = filter_audit.audit(odd, labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in rows}
    assert got == want and len(rows) == len(want)
    assert all(r.shapley == removed[r.part, r.filter_order[r.step - 1]] for r in rows)
    assert any(r.redundant for r in rows) and any(r.unique_fails for r in rows) and any(r.toxic_lost for r in rows)
    assert filter_audit.audit(odd.where("doc_id = 99"), labels).count() == 0
    assert sum(r.good_lost for r in filter_audit.audit(odd, labels.where("doc_id = 99")).collect()) == 0


def test_op12_other_filters(spark):
    """Own conditions and another column of parts."""
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "", "y")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    rows = filter_audit.audit(docs, labels, "source", {"S": lambda text, words: F.size(words) < 2}).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed) for r in rows}
    assert got == {("x", "SE", 1): (2, 0), ("x", "SE", 2): (1, 1), ("x", "ES", 1): (1, 1), ("x", "ES", 2): (1, 0), ("y", "SE", 1): (0, 1), ("y", "SE", 2): (0, 0), ("y", "ES", 1): (1, 0), ("y", "ES", 2): (0, 1)}


ITEMS = [(1, "the cat, The CAT and the dog"), (2, None), (2, "river"), (3, "zzz nothing"), (None, "house tree"), (5, "é ÀB 日本 12"), (6, "the cat"), (6, "the cat"), (7, "x" * 60_000)]


def ranked(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(x for _, b in bags for x in b)
    out = []
    for item in {i for i, _ in items}:
        q = [x for t in {t for i, t in items if i == item} for x in split(t)]
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * b[x] // (1000 * b[x] + 8 * m)) for x in q if x in b)
            scored += [(-s, i is not None, i or 0)] if s > 0 else []
        out += [(item, r + 1, i if named else None, -s) for r, (s, named, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("item_bytes,entries", [(4_000_000, 2_000_000), (20, 7)])
def test_op13_brute_force(spark, odd, monkeypatch, item_bytes, entries):
    """In one block and in many of each kind, with equal scores beyond the tenth place."""
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical_search, "BLOCK_ENTRIES", entries)
    more = [(i, "the cat") for i in range(40, 20, -1)]
    docs = odd.select("doc_id", "text", "size", "columns").unionByName(spark.createDataFrame([(*x, "s", 1) for x in more], "doc_id long, text string, size string, columns int"))
    items = spark.createDataFrame([(*x, 3, "r") for x in ITEMS], "item_id long, text string, block int, rank string")
    rows = lexical_search.search(docs, items).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in rows) == ranked(ROWS + more, ITEMS)
    assert max(Counter(r.item_id for r in rows).values()) == 10
    assert lexical_search.search(docs.where("doc_id = 99"), items).count() == 0 and lexical_search.search(docs, items.where("item_id = 99")).count() == 0
