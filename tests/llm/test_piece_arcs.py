"""BPE arcs and paths of made models, with tied ranks and pieces that rank before their halves, against plain merging."""

import random
import struct

import pytest

from reelspan.llm import piece_fst


def _field(n, raw):
    return bytes([n << 3 | 2, len(raw)]) + raw


def _model(pieces):
    kinds = [("<unk>", 0.0, piece_fst.UNKNOWN), *((p, s, piece_fst.NORMAL) for p, s in pieces)]
    rows = b"".join(_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in kinds)
    return rows + _field(2, b"\x18\x02")


@pytest.mark.parametrize("seed", range(60))
def test_paths_equal_plain_merging(seed):
    rng = random.Random(seed)
    some = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))}
    pool = [("a", -1.0), ("b", -1.0)]  # c is in no piece of its own
    pool += [(p, -float(rng.randint(1, 6 if seed % 2 else 1000))) for p in sorted(some)]
    if seed % 3 == 0:  # the halves of each piece exist, too
        pool += [(x, -float(rng.randint(1, 1000))) for p in sorted(some) for x in {p[: len(p) // 2], p[len(p) // 2 :]} if len(x) > 1 and x not in some]
    fst = piece_fst.PieceTransducer(_model(list(dict(pool).items())))
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 24)))
        assert fst.shortest_path(text) == fst.merged(text), text
    long = "".join(rng.choice("abc") for _ in range(3000))
    assert fst.shortest_path(long) == fst.merged(long)
