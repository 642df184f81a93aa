"""WAV files made here, read back."""

import io
import struct
import wave

import numpy as np
import pytest

from cadenza.sources import wav as W


def made(values, width=2, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        scaled = np.rint(np.asarray(values) * (2 ** (8 * width - 1) - 1)).astype("<i4")
        w.writeframes((scaled + 128).astype(np.uint8).tobytes() if width == 1 else scaled.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_round_trip_of_widths(width):
    v = 0.9 * np.sin(np.arange(101) / 5)
    wav = W.parse_wav(made(v, width))
    assert (wav.channels, wav.width, wav.rate, wav.frames) == (1, width, 8000, 101)
    assert np.allclose(W.samples_of(wav, 0), v, atol=2.0 ** (2 - 8 * width)) and W.parse_wav(W.canonical(wav)) == wav


def test_metadata_goes_and_channels_and_slices_are_read():
    v = np.sin(np.arange(40))
    plain = made(np.stack([v, -v], axis=1).ravel(), channels=2)
    note = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    more = plain[:4] + struct.pack("<I", len(plain) - 8 + len(note)) + plain[8:12] + note + plain[12:]
    wav = W.parse_wav(more)
    assert W.canonical(wav) == plain and np.allclose(W.samples_of(wav, 0, 5, 9), -W.samples_of(wav, 1, 5, 9), atol=1e-4) and len(W.samples_of(wav, 0, 5, 9)) == 4
    with pytest.raises(ValueError):
        W.samples_of(wav, 2)


def test_limits_of_uploads():
    v = np.zeros(16_000)
    assert W.parse_wav(made(v), W.UPLOADS).rate == 8000
    for bad in (made(v, rate=7999), made(v, rate=192_001), made(v[:15_999], channels=3), made(np.zeros(8000 * 120 + 1))):
        assert W.parse_wav(bad)
        with pytest.raises(ValueError, match="limits"):
            W.parse_wav(bad, W.UPLOADS)
    plain = made(v)
    wide = struct.pack("<4sIHHIIHHHHIH14s", b"fmt ", 40, W.EXTENSIBLE, 1, 8000, 16000, 2, 16, 22, 16, 4, 1, b"\0" * 14) + plain[36:]
    wide = plain[:4] + struct.pack("<I", 4 + len(wide)) + b"WAVE" + wide
    assert W.parse_wav(wide).frames == 16_000
    with pytest.raises(ValueError, match="PCM"):
        W.parse_wav(wide, W.UPLOADS)


def test_one_name_in_two_folders(spark, tmp_path):
    for k, name in enumerate(("a/x.wav", "b c+d/x.wav")):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(made(np.sin(np.arange(50) * (k + 1))))
    manifest = spark.createDataFrame([("a/x.wav", "1", "g1", "train"), ("b c+d/x.wav", "2", "g2", "test")], "file string, sample_id string, group_id string, partition string")
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        assert {(r.file, r.sample_id, r.status) for r in W.scan_manifest(spark, path, manifest).collect()} == {("a/x.wav", "1", "ok"), ("b c+d/x.wav", "2", "ok")}


@pytest.mark.parametrize("spoil", [lambda b: b[:-1], lambda b: b"RIFX" + b[4:], lambda b: b[:20] + b"\x03" + b[21:], lambda b: b[:32] + b"\x05" + b[33:], lambda b: b[:12] + b[36:], lambda b: b + b"junk"])
def test_broken_files_are_refused(spoil):
    with pytest.raises(ValueError):
        W.parse_wav(spoil(made(np.zeros(10))))


def test_folder_manifest_store_and_tables(spark, tmp_path):
    a, b = made(0.5 * np.sin(np.arange(80))), made(np.zeros(80))
    for name, content in (("a.wav", a), ("b.wav", b), ("copy.wav", a), ("bad.wav", b"RIFF"), ("extra.wav", made(0.1 * np.ones(8)))):
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in W.audit(spark, str(tmp_path)).collect()}
    assert rows["bad.wav"]["reason"] and rows["b.wav"]["constant"] and rows["a.wav"]["frames"] == 80 and rows["a.wav"]["pcm_sha256"] == rows["copy.wav"]["pcm_sha256"]
    manifest = spark.createDataFrame([("a.wav", "1", "g1", "train"), ("copy.wav", "2", "g2", "test"), ("b.wav", "3", "g3", "train"), ("bad.wav", "4", "g4", "train"), ("gone.wav", "5", "g5", "train")], "file string, sample_id string, group_id string, partition string")
    scanned = W.scan_manifest(spark, str(tmp_path), manifest)
    assert {r["file"]: r["status"] for r in scanned.collect()} == {"a.wav": "leaking", "copy.wav": "leaking", "b.wav": "ok", "bad.wav": "refused", "gone.wav": "missing", "extra.wav": "extra"}
    assert [(r["label"], r["sample_id"]) for r in W.support_set(scanned, spark.createDataFrame([("3", "x"), ("1", "y")], "sample_id string, label string")).collect()] == [("x", "3")]
    x = W.read_samples(spark, str(tmp_path / "a.wav"), 0, 0.001, 0.002).orderBy("n").collect()
    assert len(x) == 16 and x[0]["value"] == pytest.approx(0.5 * np.sin(8), abs=1e-4)
    assert sorted(r["copies"] for r in W.media_store(spark, str(tmp_path)).collect()) == [1, 1, 2]


def test_speed_traces_and_arrays(spark, tmp_path):
    for name, text in (("ok", "time_seconds,rpm\n0,60\n1,61\n2,59\n"), ("back", "time_seconds,rpm\n0,60\n2,61\n1,59\n"), ("short", "time_seconds,rpm\n0,60\n1,61\n"), ("odd", "time_seconds,rpm\n0,x\n2,61\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in W.read_rpm(spark, str(tmp_path / "*.csv"), 2.0).collect()}
    assert got == {"ok.csv": "ok", "back.csv": "unordered", "short.csv": "short", "odd.csv": "unordered"}
    np.savez(tmp_path / "a.npz", psd=np.arange(3), other=np.ones(2))
    assert [(r["n"], r["value"]) for r in W.read_arrays(spark, str(tmp_path), "psd").orderBy("n").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0)]
