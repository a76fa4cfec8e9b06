"""Recordings by ranges against one pass over them and plain loops; the edges of a signal; odd files."""

import math
import struct

import numpy as np
import pytest

from reelspan.operators import audio
from reelspan.sources import recordings


def _wav(raw, kind=1, channels=1, bits=16, rate=16_000, before=b"", size=None, end=b""):
    shape = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF\0\0\0\0WAVE" + before + b"fmt " + struct.pack("<I", 16) + shape + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw + end


def _plain(y):
    """Frames by loops: RMS pads with zeros, crossings with the edge's sample, and the first sample of a frame crosses nothing."""
    out, n = [], len(y)
    for k in range(1 + n // 512 if n else 0):
        at = range(k * 512 - 1024, k * 512 + 1024)
        power = sum(y[i] ** 2 for i in at if 0 <= i < n) / 2048
        held = [y[min(max(i, 0), n - 1)] for i in at]
        signs = [x < 0 and abs(x) > 1e-10 for x in held]
        out.append((k, k * 0.032, math.sqrt(power), sum(a != b for a, b in zip(signs, signs[1:])) / 2048))
    return out


@pytest.mark.parametrize("y", [[k / 3000 - 0.4 for k in range(3000)], [0.0] * 2500, [-0.25], [0.5, -0.5] * 40, [-1e-11, 1e-11] * 600, [-0.5] * 700, []], ids=["ramp", "silence", "one", "short", "tiny", "negative", "none"])
def test_edges(spark, y):
    pcm = np.array(y, "<f4")
    got = audio.frame_features(spark.createDataFrame([(1, bytearray(pcm.tobytes()))], "video_id long, pcm binary")).orderBy("frame_idx").collect()
    want = _plain(pcm.astype(float).tolist())
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert tuple(r)[1:] == pytest.approx(w, abs=1e-9)


def test_ranges_and_formats(spark, tmp_path):
    rng = np.random.default_rng(3)
    y = (rng.uniform(-0.9, 0.9, 60_000) * np.sin(np.arange(60_000) / 9000)).round(3)
    whole = (y * 2**15).astype("<i2")
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    files = {
        "i2": (_wav(whole.tobytes(), before=odd, end=b"LIST\4\0\0\0abcd"), whole / 2**15),
        "open": (_wav(whole.tobytes(), size=0xFFFFFFFF), whole / 2**15),
        "stereo": (_wav(np.stack([whole, whole // 2], 1).astype("<i2").tobytes(), channels=2), (whole / 2**15 + (whole // 2) / 2**15) / 2),
        "i4": (_wav((y * 2**31).astype("<i4").tobytes(), bits=32), (y * 2**31).astype("<i4") / 2**31),
        "i3": (_wav(b"".join(int(x * 2**23).to_bytes(3, "little", signed=True) for x in y), bits=24), np.array([int(x * 2**23) for x in y]) / 2**23),
        "u1": (_wav((y * 127 + 128).astype("u1").tobytes(), bits=8), ((y * 127 + 128).astype("u1").astype(float) - 128) / 128),
        "f4": (_wav(y.astype("<f4").tobytes(), kind=3, bits=32), y.astype("<f4").astype(float)),
        "short": (_wav(whole[:5].tobytes()), whole[:5] / 2**15),
        "empty": (_wav(b""), whole[:0]),
    }
    bad = {"text": b"no sound", "rate": _wav(b"\0\0", rate=44_100), "law": _wav(b"\0\0", kind=6, bits=8), "cut": _wav(b"")[:30], "nothing": b""}
    for name, raw in [*((k, v[0]) for k, v in files.items()), *bad.items()]:
        (tmp_path / f"{name}.wav").write_bytes(raw)
    listed = recordings.list_files(spark, f"{tmp_path}/*.wav").unionByName(spark.createDataFrame([(f"file:{tmp_path}/nothing.wav", 0)], "path string, length long"))
    heads = recordings.headers(listed)
    name_of = lambda path: path.rsplit("/", 1)[1][:-4]
    errors = {name_of(r.path) for r in heads.where("error IS NOT NULL").collect()}
    assert errors == set(bad)
    got = {}
    for r in recordings.frames(heads, range_frames=17).orderBy("path", "frame_idx").collect():
        got.setdefault(name_of(r.path), []).append(tuple(r)[1:])
    assert set(got) == set(files) - {"empty"}
    for name, rows in got.items():
        signal = np.asarray(files[name][1], float)
        want = [x for at, rms, zcr in audio.signal_features(signal, 0, len(signal), 0, 1 + len(signal) // 512) for x in zip(at, at * 0.032, rms, zcr)]
        assert [r[0] for r in rows] == [w[0] for w in want], name
        assert np.allclose(np.array(rows), np.array(want), rtol=0, atol=1e-9), name
    assert np.allclose(np.array(got["i2"])[:20], np.array(_plain((whole / 2**15).tolist())[:20]), atol=1e-9)


def test_writing(spark, tmp_path):
    parts = [(7, 1, bytearray(b"\1\0" * 600)), (7, 0, bytearray(b"\2\0" * 600)), (8, 0, None), (9, 0, bytearray(b"\xff\xff"))]
    made = recordings.write_recordings(spark.createDataFrame(parts, "video_id long, part long, pcm binary"), str(tmp_path / "wav")).collect()
    raw = {r.video_id: open(r.path, "rb").read() for r in made}
    assert raw[7][44:] == b"\2\0" * 600 + b"\1\0" * 600 and raw[8][44:] == b"" and raw[9][44:] == b"\xff\xff"
    assert all(r.length == len(raw[r.video_id]) for r in made)
