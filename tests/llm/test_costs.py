"""What keeps the operators within their budgets: less work for the same results."""

import random

import numpy as np
import pytest

from reelspan.llm import byte_bpe, rolling, substring_dedup, suffix_sort
from reelspan.llm.queries import vocabulary


def test_pairs_are_sorted_without_a_trie(monkeypatch):
    rng = random.Random(1)
    parts = [bytes(rng.choices(b"abc", k=40)) + bytes([65 + k % 2]) * 24 for k in range(60) for _ in (0, 1)]
    raw, depth = b"".join(p[:40] + bytes([65 + k % 2]) * 24 for k, p in enumerate(parts)), 60
    at = np.arange(0, len(raw) - depth + 1, 64)
    monkeypatch.setattr(suffix_sort.BlindTrie, "insert", lambda *_: pytest.fail("a trie for two strings"))
    order, group = suffix_sort.sort_suffixes(suffix_sort.symbols(np.frombuffer(raw, np.uint8), depth + 16), at, depth)
    found = [raw[p : p + depth] for p in at[order].tolist()]
    assert found == sorted(raw[p : p + depth] for p in at.tolist()) and len(set(found)) == len(set(group.tolist())) == 120


def test_symbols_are_read_where_they_are_looked_up():
    raw = np.frombuffer(bytes(range(256)) * 4096, np.uint8)
    words = suffix_sort.symbols(raw, 16)
    assert words.strides == (1,) and len(words) == len(raw) + 24  # eight bytes a position before, and three copies
    assert [int(words[p]) for p in (0, 250, len(raw) - 3)] == [int.from_bytes(x, "big") for x in (bytes(range(8)), bytes([*range(250, 256), 0, 1]), b"\xfd\xfe\xff" + bytes(5))]


def test_widths_are_hashes():
    raw = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    total, at = rolling.running(raw), np.arange(481)
    assert np.array_equal(rolling.widths(total, 20), rolling.hashes(total, at, at + 20))


@pytest.mark.parametrize("tile", [61, 100, 1 << 18])
def test_minimisers_are_the_same_in_all_tiles(tile):
    """Plain minimisers: of each window its least gram's hash, of equal ones the leftmost; runs end with their text."""
    rng = random.Random(tile)
    rows = [b"", b"ab" * 60, *(bytes(rng.choices(b"ab ", k=rng.choice([3, 49, 50, 51, 130]))) for _ in range(20))]
    t = substring_dedup.Texts(list(range(len(rows))), rows, 50, tile)
    raw = b"".join(rows)
    total = rolling.running(np.frombuffer(raw, np.uint8))
    seen = []
    for a, b, seed, of in zip(t.begin.tolist(), t.stop.tolist(), t.seed.tolist(), t.of.tolist(), strict=True):
        for w in range(a, b):
            grams = rolling.hashes(total, np.arange(w, w + 31), np.arange(w, w + 31) + 20)
            assert seed == int(grams.min()) and t.starts[of] <= w and w + 50 <= t.ends[of]
            seen.append(w)
    assert seen == [p + a for p, x in zip(t.starts.tolist(), rows, strict=True) for a in range(len(x) - 49)]
    assert int(t.low) == (1 << (tile + 50).bit_length()) - 1


def test_chunks_have_the_ids_of_whole_texts():
    """Ids over all kinds of edges are the library's, new groups and a full memo included, and what stands before marks is encoded once."""
    tool = byte_bpe.ChunkEncoder(vocabulary("byte_bpe_50k.json"), most=60, group=200)
    rng = random.Random(3)
    parts = ["word", "Word", "it's", "'s", "don't.", " ", " ", " ", "\n", "\n", "\n\n", "\t", "\r\n", " ", "　", "é", "ß", "½", "²", "…", "»", "漢字", "\U0001f600", "<|endoftext|>", "<|endoftext", "|>", ".", ",", "_", "###", "12", "é", "\x00", "ẞ,", "ⅷ."]
    texts = ["", " ", "\n", "a\n", "\na", " \na", "a \n b", "a\n b", "\n\nA.", "foo<|endoftext|>.", "x. <|endoftext|>", "thon.\nEror, thon", *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(3000))]
    got = [np.frombuffer(x, "<u4").tolist() for x in tool.ids(texts)]
    assert got == [tool.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert tool.ids([]) == []

    fresh, seen = byte_bpe.ChunkEncoder(vocabulary("byte_bpe_50k.json")), []
    library = fresh.tokenizer

    class Spy:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(library, name)

    fresh.tokenizer = Spy()
    raw = fresh.ids(["a zomblique, zomblique. zomblique\nzomblique### zomblique", "a zomblique;\nzomblique!"])
    assert [np.frombuffer(x, "<u4").tolist() for x in raw] == [library.encode(x, add_special_tokens=False).ids for x in ("a zomblique, zomblique. zomblique\nzomblique### zomblique", "a zomblique;\nzomblique!")]
    assert sorted("".join(seen).split("zomblique")) == ["", "\n", " "]  # once after a space, once after a line feed
