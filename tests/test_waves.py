"""WAV files written here, read as chunks."""

import struct

import numpy as np
import pytest

from cadenza.sources import waves


def write(path, x, rate, bits=16, tag=1, extensible=False):
    x = np.atleast_2d(x.T).T
    if tag == 3:
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = np.round((x + 1) * 127.5).astype(np.uint8).tobytes()
    elif bits == 24:
        data = np.round(x * (2**23 - 1)).astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    else:
        data = np.round(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, x.shape[1], rate, rate * x.shape[1] * bits // 8, x.shape[1] * bits // 8, bits)
    fmt += struct.pack("<HHIH", 22, bits, 0, tag) + b"\0" * 14 if extensible else b""
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


def tone(rate, seconds, hertz=440.0):
    return 0.5 * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("waves")
    (folder / "deep").mkdir()
    write(folder / "same.wav", tone(22050, 1.5), 22050)
    write(folder / "stereo.WAV", np.stack([tone(44100, 1.5), np.zeros(66150)], axis=1), 44100, 24)
    write(folder / "deep" / "float.wav", tone(48000, 1.5), 48000, 32, 3, True)
    write(folder / "low.wav", tone(8000, 1.5), 8000, 8)
    write(folder / "long.wav", tone(22050, 3.0), 22050, 32)
    write(folder / "empty.wav", np.zeros(0), 22050)
    (folder / "broken.wav").write_bytes(b"RIFF....WAVEfmt ")
    (folder / "text.wav").write_bytes(b"hello")
    (folder / "other.mp3").write_bytes(b"x")
    rows = waves.load_waves(spark, str(folder), 10_000, 22050, 2.0).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["chunk"] or 0)):
        out.setdefault(r["path"].removeprefix(f"{folder}/"), []).append(r)
    return out


def test_rates_and_widths_give_the_same_tone(loaded):
    expected = tone(22050, 1.5)
    for name, scale, error in (("same.wav", 1, 1e-4), ("stereo.WAV", 0.5, 1e-3), ("deep/float.wav", 1, 1e-3), ("low.wav", 1, 2e-2)):
        rows = loaded[name]
        found = np.concatenate([r["samples"] for r in rows])
        assert [len(r["samples"]) for r in rows] == [10_000, 10_000, 10_000, 3075] and [r["chunk"] for r in rows] == [0, 1, 2, 3]
        assert np.abs(found - scale * expected)[200:-200].max() < error, name


def test_trimmed_empty_and_broken_files(loaded):
    assert sum(len(r["samples"]) for r in loaded["long.wav"]) == 44100
    assert [(r["chunk"], r["samples"], r["error"]) for r in loaded["empty.wav"]] == [(None, None, None)]
    assert loaded["text.wav"][0]["error"] == "no WAV file" and loaded["broken.wav"][0]["error"] == "no data"
    assert "other.mp3" not in loaded


def test_tones_beyond_the_new_rate_go(spark, tmp_path):
    write(tmp_path / "high.wav", tone(48000, 1.0, 15000.0), 48000)
    found = np.concatenate([r["samples"] for r in waves.load_waves(spark, str(tmp_path)).orderBy("chunk").collect()])
    assert np.abs(found[200:-200]).max() < 1e-3
