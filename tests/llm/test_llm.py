"""Operators of the training-data pipeline against brute force, the libraries and round trips, with odd rows."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import ngram_join, packing, piece_fst, pu_quality, quality_rules, simhash, substring_dedup, suffix_sort, token_counts, token_files, warc
from reelspan.llm.queries import vocabulary

random.seed(5)
PHRASE = " ".join(f"word{k}" for k in range(30))
ODD = [None, "", " ", "  a   b \n\n c  ", "é" * 60, "日本語" * 40, "x" * 3000, "<|endoftext|> a <s>", PHRASE, PHRASE, PHRASE.replace("word7", "other"), "A B\tC\x0bD", f"{PHRASE} tail. {PHRASE}"]
SCHEMA = "doc_id long, text string, score double, kept boolean, block int, n string"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, and extra columns whose names clash with those that operators add."""
    rows = [(i, t, 0.5, False, 7, "z") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def texts():
    return {i: t or "" for i, t in enumerate(ODD)}


def test_op1_equals_the_library(spark, docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(piece_fst.encode_documents(docs, path), "ids")
    back = by_id(piece_fst.decode_documents(piece_fst.encode_documents(docs, path), path), "text")
    for i, t in texts().items():
        want = model.encode(t)
        assert np.frombuffer(got[i][0], "<u4").tolist() == want and back[i][0] == model.decode(want)


def test_op1_unigram():
    def field(n, raw):
        return bytes([n << 3 | 2, len(raw)]) + raw

    def piece(text, score, kind=1):
        import struct

        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + piece("▁", -3) + piece("a", -2) + piece("b", -2) + piece("ab", -2.5) + piece("▁a", -2.2) + field(2, bytes([3 << 3, 1]))
    fst = piece_fst.PieceTransducer(model)
    assert [fst.pieces[i][0] for i in fst.encode("ab")] == ["▁a", "b"] and [fst.pieces[i][0] for i in fst.encode("aab")] == ["▁a", "ab"]


def test_op2_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tool, at = Tokenizer.from_file(path), 0
    got = by_id(token_files.token_files(docs, path, 2), "start", "n_tokens", "ids_crc32")
    for i, t in texts().items():
        ids = [*tool.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files(docs.where("doc_id < 0"), path).count() == 0


@pytest.mark.parametrize("vocabulary_size", [2, 3, 256, 1000, 50257, 1 << 20])
def test_op2_packing(vocabulary_size):
    rows = [(k if k else None, [random.randrange(vocabulary_size) for _ in range(random.randrange(40))]) for k in range(30)]
    assert token_files.round_trip(rows, vocabulary_size) == rows


def _simhash(runs):
    """Votes of 64-bit hashes, the plain way."""
    total = np.zeros(64, int)
    for h in runs:
        total += np.array([1 if h >> k & 1 else -1 for k in range(64)])
    return sum(1 << k for k in range(64) if total[k] > 0)


def test_op3(spark, docs):
    got = by_id(simhash.fingerprint_documents(docs), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next", "class_id")
    t = texts()
    for i in t:
        follow = t[(i + 1) % len(t)]
        k = len(t[i]) // 4
        assert got[i][:2] == (len(t[i]), hashlib.sha256((t[i][: len(t[i]) - k] + follow[:k]).encode()).hexdigest())
    assert got[8][2] == got[9][2] and got[8][4] == 1 and got[9][5] == 8 and got[1][2] == "0" * 16
    words = spark.createDataFrame([(PHRASE,)], "text string").select(simhash.word_hashes(F.col("text")).alias("w"))
    runs = [r[0] & (1 << 64) - 1 for r in words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(5)])))).collect()]
    assert int(got[8][2], 16) == _simhash(runs)
    one = by_id(simhash.fingerprint_documents(docs.where("doc_id = 8")), "near_next")
    assert one == {8: (1.0,)} and simhash.fingerprint_documents(docs.where("doc_id < 0")).count() == 0


def test_op3_block_tables(spark):
    base = [random.getrandbits(64) for _ in range(40)]
    fps = sorted({f ^ sum(1 << random.randrange(64) for _ in range(random.randrange(6))) & (1 << 64) - 1 for f in base for _ in range(10)} | set(base))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.query_fp, r.fp) for r in simhash.within_radius(rows, rows).collect()}
    assert got == {(a, b) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3} and got


@pytest.mark.parametrize("raw", [b"", b"banana" * 9, b"x" * 70, b"\0\0a\0" * 20, bytes(random.choice(b"ab") for _ in range(300)), b"abcdefghij" * 20 + b"abcdefghik" * 5])
def test_op4_suffix_array(raw):
    assert suffix_sort.suffix_array(raw, 8).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def _dedup(rows, length=50):
    low = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            low[t[k : k + length]] = min(i, low.get(t[k : k + length], i))
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if low[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_op4(spark, docs):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(substring_dedup.dedup(docs), *names) == _dedup([(i, t.encode()) for i, t in texts().items()])
    base = "".join(random.choice("abcdefgh ") for _ in range(400))
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(random.randint(0, 6)):
            t[random.randrange(400)] = random.choice("XYZé")
        rows.append((i, "".join(t)[random.randint(0, 200) : random.randint(200, 400)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_id(substring_dedup.dedup(df, block_bytes=700), *names) == _dedup([(i, t.encode()) for i, t in rows])
    kept = substring_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {0, 1, 2, 8} <= {r.doc_id for r in kept.collect()} and 9 not in {r.doc_id for r in kept.collect()}
    assert substring_dedup.dedup(docs.where("doc_id < 0")).count() == 0


def test_op5(spark, docs):
    got = by_id(quality_rules.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in texts().items():
        words = t.encode().split()
        windows = defaultdict(list)
        for k in range(len(words) - 2):
            windows[tuple(words[k : k + 3])].append(k)
        covered = {p + j for at in windows.values() if len(at) > 1 for p in at for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert got[i][:5] == want and got[i][5] == (len(words) < 50 or 2 * len(covered) > len(words))
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_op6(spark, docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.token_counts(docs, path, 100), "n_bytes", "n_tokens", "over_limit")
    for i, t in texts().items():
        n = len(model.encode(t))
        assert got[i] == (len(t.encode()), n, n > 100)
    tiny = token_counts.Counter(path, chunk=40, overlap=2)
    for t in [*texts().values(), " " * 300, "aaaa" * 200, "🙂é日" * 90, "\x01\x02 " * 80]:
        assert tiny.long_ids(t) == model.encode(t) and tiny.counts([t]) == [len(model.encode(t))]


def test_op7(spark, docs):
    good, bad = "The cat and the dog went to a house by the sea.", "Buy*** now### cheap$$$ THE&&& BEST!!"
    rows = [(i, " ".join(random.choices((good if i % 4 else bad).split(), k=40)), int(bool(i % 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = pu_quality.classify(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) >= 0.95 * len(held)
    scored = pu_quality.classify(docs, df.select("doc_id", "quality"))
    assert scored.count() == len(ODD) and scored.where("score is null or score < 0 or score > 1").count() == 0
    none = pu_quality.classify(docs, df.where("doc_id < 0").select("doc_id", "quality"))
    assert none.where("predicted = 0").count() == len(ODD)


def test_op7_risk_is_not_negative():
    r = np.random.default_rng(1)
    p, u = r.normal(1, 1, (50, 4)), np.vstack([r.normal(1, 1, (80, 4)), r.normal(-1, 1, (40, 4))])
    *_, risks = pu_quality.minimise(p, u, 0.66)
    assert min(risks) >= 0 and risks[-1] < risks[0]


def test_op8(spark):
    long = "".join(random.choice("abc<> é") for _ in range(90_000))
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u", long), (4, "u", long), (5, "u", ""), (6, "u", None), (7, "a\r\nb", "y")]
    got = {r.page_id: r for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = {"x": 1, long: 3, "": 5, "y": 7}
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op8_chunks():
    for n in (0, 1, 8191, 8192, 30_000):
        raw = bytes(random.randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(raw)) == raw
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_op9(spark, docs):
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 1, 64).collect()
    tokens = by_id(token_files.token_files(docs, vocabulary("byte_bpe_50k.json"), 1), "n_tokens")
    pieces, rows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        rows[r.sequence_id].append((r.offset, r.length))
    for i, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == tokens[i][0]
    assert set(pieces) == set(texts()) and set(rows) == set(range(len(rows)))
    for own in rows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(docs.where("doc_id < 0"), vocabulary("byte_bpe_50k.json")).count() == 0


def test_op9_patterns():
    h = {random.randint(1, 1024): random.randint(1, 300) for _ in range(300)} | {2048: 50}
    found, back = packing.shortest_pack_first(h, 2048), defaultdict(int)
    for pattern, n in found:
        assert sum(length * k for length, k in pattern) <= 2048
        for length, k in pattern:
            back[length] += k * n
    assert back == h and sum(a * b for a, b in h.items()) > 0.98 * 2048 * sum(n for _, n in found)


def _components(rows, size, num, den):
    sets, parent, shared, where = [], {}, defaultdict(int), defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().translate(ngram_join._LOWER).split()
        k = min(size, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b, (_, s) in enumerate(sets):
        for g in s:
            for a in where[g]:
                shared[a, b] += 1
            where[g].append(b)
    for (a, b), n in shared.items():
        if n * den >= num * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_op10(spark, docs, monkeypatch):
    names = ("n_shingles", "component_id")
    assert by_id(ngram_join.jaccard_components(docs, 4, "0.85"), *names) == _components(list(enumerate(ODD)), 4, 85, 100)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(random.randint(0, 3)):
            w[random.randrange(60)] = f"x{random.randrange(5)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(ngram_join.jaccard_components(df, 4, "0.85"), *names) == _components(rows, 4, 85, 100)
    # Groups of many chunks, near the threshold: several texts, each with up to nine edits.
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 12)
    rows = []
    for i in range(240):
        w = [f"g{i % 3}w{k}" for k in range(40 + 20 * (i % 3))]
        for _ in range(random.randint(0, 6)):
            at = random.randrange(len(w))
            w[at : at + random.randint(0, 1)] = [f"x{random.randrange(4)}"] * random.randint(0, 2)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(ngram_join.jaccard_components(df, 4, "0.85"), *names) == _components(rows, 4, 85, 100)
    assert by_id(ngram_join.jaccard_components(df, 5, "0.6"), *names) == _components(rows, 5, 6, 10)
    kept = ngram_join.keep_one(docs)
    want = {i for i, (_, c) in _components(list(enumerate(ODD)), 5, 8, 10).items() if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and 9 not in want
    assert ngram_join.jaccard_components(docs.where("doc_id < 0")).count() == 0


def test_op10_repeated_and_null_ids(spark):
    """Documents are linked through each of their texts; a null id has sizes but no component."""
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(50)) for x in "abcd")
    rows = [(1, one), (2, one + " end"), (2, two), (3, "start " + two), (4, three), (5, three), (None, four), (None, four), (6, four), (7, ""), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.jaccard_components(df, 4, "0.85").collect())
    assert got == [(0, 47, 0), (0, 47, 0), (1, 47, 1), (2, 47, 1), (2, 48, 1), (3, 48, 1), (4, 47, 4), (5, 47, 4), (6, 47, 6), (7, 0, 7), (7, 0, 7)]


@pytest.mark.parametrize("num,den", [(85, 100), (8, 10), (1, 2), (1, 1)])
def test_op10_prefixes(num, den):
    """Two sets at the threshold have, in any order, L shingles common to both long prefixes, L being either's."""
    t = Fraction(num, den)
    extra = lambda n: ngram_join.long_prefix(n, t) - ngram_join.prefix_length(n, t) + 1
    for n in range(1, 140):
        for m in range(n, min(140, int(n / t) + 1)):
            common = -(-num * (n + m) // (num + den))
            # Common ones in the prefix at least, by how many lie behind it at most.
            both = min(common - (x - ngram_join.long_prefix(x, t)) for x in (n, m))
            assert common > min(n, m) or both >= max(extra(n), extra(m))


def test_op10_index():
    """Overlaps derived from another set's are those counted, and no link of sets is lost by skipped blocks."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 120, dtype=np.uint64))
    sets = [np.unique(np.append(rng.choice(base, rng.integers(70, 120), False), rng.integers(0, 9, rng.integers(0, 9)).astype(np.uint64))) for _ in range(80)]
    sets.sort(key=len)
    index = ngram_join.SetIndex(sets, Fraction(4, 5))
    for k, s in enumerate(sets):
        want = [len(np.intersect1d(s, x, True)) for x in sets]
        near = {j for j, x in enumerate(sets) if j != k and 5 * want[j] >= 4 * (len(s) + len(x) - want[j])}
        listed = index.overlaps(k)
        assert all(listed[j] == want[j] for j in range(80) if j != k) and near <= set(index.candidates(k).tolist())
        assert set(index.links(k, index.candidates(k)).tolist()) - {k} == near


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [" ".join(random.choice("the of and cat dog house tree river stone walked slowly over under many people saw".split()) for _ in range(80)) + f" end{i}." for i in range(60)]
    rows = [(i, good[i % 60] if i % 3 else "BUY!! NOW!! ### $$$ " * 20, "en", "s", 1) for i in range(180)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(0, 180)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and not any(i % 3 == 0 for i in ids) and len({rows[i][1] for i in ids}) == len(ids)
