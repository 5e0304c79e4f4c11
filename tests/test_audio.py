"""Audio in ranges and signals in chunks: equal to whole files and plain slices."""

import struct
import wave

import numpy as np
import pytest

from segspark.operators import fbank as B
from segspark.operators import sequence as Q
from segspark.plans import diarize as D
from segspark.sources import wav


def write(path, x, rate=16000, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        full = (np.asarray(x) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        raw = (full + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in full)
        w.writeframes(b"".join(raw[i : i + width] * channels for i in range(0, len(raw), width)))


def whole(spark, path):
    return {r.rec: (r.samplerate, r.x) for r in wav.read_wav(spark, path).collect()}


@pytest.mark.parametrize("chunk,split", [(1 << 16, 32 << 20), (100, 333), (7, 60)])
def test_ranges(spark, tmp_path, chunk, split):
    """Every cut gives the samples of the whole file, each once; widths, channels and odd headers included."""
    r = np.random.default_rng(1)
    for i, (width, channels, rate) in enumerate([(1, 1, 8000), (2, 1, 16000), (2, 2, 16000), (3, 1, 8000), (4, 2, 16000)]):
        write(tmp_path / f"f{i}.wav", r.uniform(-1, 1, 500 + 37 * i), rate, width, channels)
    write(tmp_path / "empty.wav", [])
    plain = (tmp_path / "f1.wav").read_bytes()
    # an extra chunk of odd length before the data, and a length that was never filled in
    (tmp_path / "odd.wav").write_bytes(plain[:36] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + plain[36:])
    (tmp_path / "open.wav").write_bytes(plain[:40] + b"\xff" * 4 + plain[44:])
    want = whole(spark, f"{tmp_path}/f*.wav")
    want |= {"odd": want["f1"], "open": want["f1"]}
    got = {}
    for row in wav.read_chunks(spark, f"{tmp_path}/*.wav", chunk, split).collect():
        assert row.first % chunk == 0 and row.total == len(want[row.rec][1]) and row.samplerate == want[row.rec][0]
        assert got.setdefault(row.rec, {}).setdefault(row.first, row.x) is row.x
    assert {rec: [v for _, x in sorted(parts.items()) for v in x] for rec, parts in got.items()} == {rec: x for rec, (_, x) in want.items()}


def test_refused_files(spark, tmp_path):
    write(tmp_path / "a.wav", [0.1] * 50, 44100)
    with pytest.raises(Exception, match="8000 or 16000"):
        wav.read_chunks(spark, str(tmp_path)).collect()
    (tmp_path / "a.wav").write_bytes(b"no audio at all")
    with pytest.raises(Exception, match="RIFF"):
        wav.read_chunks(spark, str(tmp_path)).collect()


def test_noise():
    stream = np.random.RandomState(3).rand(3000) * 2 - 1
    noise = B.Noise(3, 2900)
    small = type("Small", (B.Noise,), {"SPACING": 512})(3, 2900)
    for first, n in ((0, 10), (511, 3), (512, 600), (2899, 100)):
        assert (noise.take(first, n) == stream[first : first + n]).all() and (small.take(first, n) == stream[first : first + n]).all()


def test_features_do_not_depend_on_cuts(spark, tmp_path):
    """8 and 16 kHz together; a segment over several tasks and partitions; equal to the last bit."""
    r = np.random.default_rng(2)
    write(tmp_path / "wide.wav", r.normal(size=16000 * 20).clip(-4, 4) / 5)
    write(tmp_path / "narrow.wav", r.normal(size=8000 * 9).clip(-4, 4) / 5, 8000)
    vad = spark.createDataFrame([("wide", 0, 0.0, 14.013), ("wide", 1, 14.5, 14.509), ("wide", 2, 15.0, 16.7), ("wide", 3, 19.99, 25.0), ("narrow", 0, 0.3, 8.9), ("narrow", 1, 8.9, 8.93)], "rec string, segnum int, start double, end double")
    take = lambda df: sorted((x.rec, x.segnum, x.frame, tuple(x.feat)) for x in df.collect())
    chunks = wav.read_chunks(spark, f"{tmp_path}/*.wav", 5000, 100000)
    assert chunks.rdd.getNumPartitions() > 3
    one = take(D.audio_features(wav.read_wav(spark, f"{tmp_path}/*.wav"), vad))
    assert one == take(D.audio_features(chunks, vad, unit=300, chunk=5000))
    # against the plain formula on the whole segment
    from segspark.operators.sequence import mel_filterbank

    rate, x = whole(spark, f"{tmp_path}/narrow.wav")["narrow"]
    x = np.trunc(np.asarray(x) * 32768) + 8.0 * (np.random.RandomState(3).rand(len(x)) * 2 - 1)
    x = x[int(0.3 * rate) : int(8.9 * rate)]
    x = np.concatenate((x[:60][::-1], x, x[len(x) - 100 :][::-1]))
    bank = B.filterbank_matrix(mel_filterbank(spark, 256, 8000, 64, 20.0, 3700.0, htk_bug=False), 129, 64)
    frames = np.lib.stride_tricks.sliding_window_view(x, 200)[::80]
    logs = B.log_channels(B.emphasised(frames, 0.97, True) * (0.5 - 0.5 * np.cos(np.linspace(0, 2 * np.pi, 200))) ** 0.85, bank)
    size = min(300, len(logs))
    mean = [logs[b : b + size].mean(0) for b in np.clip(np.arange(len(logs)) - 150, 0, len(logs) - size)]
    got = np.array([f for rec, seg, _, f in one if (rec, seg) == ("narrow", 0)])
    assert got.shape == logs.shape and np.abs(got - (logs - mean)).max() < 1e-4
    # windows follow each file's own rate
    rows = D.extract(chunks, vad.where("segnum = 0")).collect()
    assert {x.rec for x in rows} == {"wide", "narrow"} and all(x.key.startswith(x.rec) for x in rows)
    assert max(x.end for x in rows if x.rec == "narrow") == 8.9


@pytest.mark.parametrize("window,shift,size", [(16, 8, 64), (5, 1, 20), (7, 9, 30), (16, 8, 1 << 16)])
def test_framing_in_chunks(spark, window, shift, size):
    r = np.random.default_rng(3)
    parts = {"a": r.normal(size=333), "b": r.normal(size=64), "c": r.normal(size=window), "d": r.normal(size=window - 1)}
    rows = [(rec, n, float(v), "x") for rec, x in parts.items() for n, v in enumerate(x)]
    signal = spark.createDataFrame(rows, "rec string, n long, x double, chunk string").repartition(4)
    got = {(x.rec, x.frame, x.k): x.x for x in Q.framing(signal, window, shift, size).collect()}
    want = {(rec, f, k): float(x[f * shift + k]) for rec, x in parts.items() for f in range((len(x) - window) // shift + 1) for k in range(window)}
    assert got == want
    bank = r.random((B.math.ceil(2 ** B.math.ceil(B.math.log2(window)) // 2 + 1), 3))
    feats = {(x.rec, x.frame): x.feat for x in B.log_filterbank(signal, np.hamming(window), window - shift, bank, chunk=size, energy="last", normalise_energy=False).collect()}
    assert set(feats) == {k[:2] for k in want} and all(len(f) == 4 for f in feats.values())


def test_signals_with_gaps(spark):
    gap = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0)], "rec string, n long, x double")
    with pytest.raises(Exception, match="not numbered"):
        Q.chunked(gap, 3).collect()
    null = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (None, 2, 3.0)], "rec string, n long, x double")
    assert [r.x for r in Q.chunked(null, 1).collect()] == [[1.0, None, 3.0]]
    assert Q.chunked(null.where("n > 9"), 1).count() == 0


@pytest.mark.parametrize("variance", [False, True])
@pytest.mark.parametrize("n,chunk", [(4, 6), (17, 6), (100, 12), (61, 1 << 14)])
def test_floating_norm_in_chunks(spark, variance, n, chunk):
    """A window of 6 frames; sequences over many chunks, two dimensions, a name of each kind."""
    r = np.random.default_rng(n)
    x = {("a", 0): r.normal(size=n), ("a", 1): r.normal(size=n) + 5, (None, 0): r.normal(size=max(1, n // 2))}
    df = spark.createDataFrame([(rec, f, d, float(v), 1) for (rec, d), xs in x.items() for f, v in enumerate(xs)], "rec string, frame int, d int, x double, chunk int").repartition(3)
    got = {(q.rec, q.d, q.frame): q.x for q in Q.floating_norm(df, 3, 2, variance, chunk).collect()}
    for (rec, d), xs in x.items():
        size = min(len(xs), 6)
        begin = np.clip(np.arange(len(xs)) - 3, 0, len(xs) - size)
        want = xs - np.array([xs[b : b + size].mean() for b in begin])
        if variance:
            want = want / np.sqrt([(want[b : b + size] ** 2).mean() for b in begin])
        assert np.allclose([got.pop((rec, d, f)) for f in range(len(xs))], want)
    assert not got


def test_floating_norm_of_gaps(spark):
    null = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, None), ("a", 2, 0, 5.0)], "rec string, frame long, d int, x double")
    assert [q.x for q in Q.floating_norm(null).orderBy("frame").collect()] == [-1.0, None, 3.0]
    with pytest.raises(Exception, match="not numbered"):
        Q.floating_norm(null.where("frame <> 1")).collect()
