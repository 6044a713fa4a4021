import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import audio


def test_wav_round_trip_is_exact():
    for n in (0, 1, 2, 63, 64, 1000, 100_001):
        raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        media = audio.to_wav(raw)
        assert audio.from_wav(media) == (raw, audio.RATE) and len(media) % 2 == 0
    with pytest.raises(ValueError):
        audio.from_wav(b"no sound")


@pytest.mark.parametrize("up,down", [(3, 8), (1, 2), (2, 3), (5, 4), (1, 1)])
@pytest.mark.parametrize("size", [1, 64, 70_001])
def test_resampling_against_direct_convolution(up, down, size):
    x = np.random.default_rng(0).normal(size=size).astype(np.float32)
    half = audio.TAPS * max(up, down)
    widened = np.zeros(len(x) * up)
    widened[::up] = x
    taps = audio.phases(up, down).T.ravel()
    want = np.convolve(widened, taps)[half : half + len(widened)][::down]
    assert len(want) == -(-size * up // down) and np.abs(audio.resample(x, up, down) - want).max() < 1e-4


def slow_log_mel(signal, rate):
    """Frame by frame with a written-out Fourier sum."""
    rows, at = [], 0
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    top = to_mel(rate / 2)
    edges = [to_hz(top * k / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    while True:
        part = np.zeros(audio.FRAME)
        part[: len(signal[at : at + audio.FRAME])] = signal[at : at + audio.FRAME]
        part *= [0.5 - 0.5 * np.cos(2 * np.pi * n / audio.FRAME) for n in range(audio.FRAME)]
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FFT))) ** 2 for k in range(audio.FFT // 2 + 1)]
        row = []
        for low, mid, high in zip(edges, edges[1:], edges[2:]):
            weights = [max(0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f in np.arange(len(power)) * rate / audio.FFT]
            row.append(10 * np.log10(max(np.dot(weights, power), 1e-10)))
        rows.append(row)
        at += audio.HOP
        if at + audio.FRAME - audio.HOP >= len(signal):
            return np.array(rows)


@pytest.mark.parametrize("size", [1, 199, 200, 201, 280, 1000, 1041])
def test_log_mel_against_fourier_sums(size):
    signal = np.random.default_rng(size).normal(size=size).astype(np.float32)
    got, energy = audio.log_mel(signal, 6000)
    want = slow_log_mel(signal, 6000)
    assert got.shape == want.shape and len(energy) == len(want) and np.abs(got - want).max() < 0.01


def test_windows_cover_every_frame_with_its_segment():
    rng = np.random.default_rng(4)
    quiet, loud = np.full(30_000, 128, np.uint8), rng.integers(0, 256, 30_000, dtype=np.uint8)
    raw = np.concatenate([quiet, loud, quiet, loud]).tobytes()
    stored = audio.to_stream(audio.clip_windows(audio.to_wav(raw)))
    windows = audio.from_stream(stored)
    assert windows.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (audio.FRAMES, audio.MELS))
    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = audio.log_mel(audio.resample(x), audio.RATE * audio.UP / audio.DOWN)
    values = windows.column("tensor").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert (values[: len(mels)] == mels).all() and (values[len(mels) :] == audio.FLOOR_DB).all()
    segment = np.array(windows.column("segments").combine_chunks().flatten())
    want = np.full(len(values), -1)
    for k, (a, b) in enumerate(audio.segments(energy)):
        want[a:b] = k
    assert (segment == want).all() and segment.max() == 1
    starts, ends = windows.column("start_ms").to_pylist(), windows.column("end_ms").to_pylist()
    assert starts[0] == 0 and starts[1:] == ends[:-1] and abs(ends[-1] - len(mels) * 1000 * audio.HOP / 6000) < 1
    with pytest.raises(ValueError):
        audio.from_stream(audio.to_stream(pa.RecordBatch.from_pydict({"x": [1]})))


def test_segments_find_bursts_and_keep_through_dips():
    e = np.full(400, -60.0)
    e[100:200] = -20
    e[150:153] = -45  # above the lower level
    e += np.linspace(0, 1, 400)
    found = audio.segments(e)
    assert any(a <= 101 and b >= 199 for a, b in found.tolist())
    assert len(audio.segments(np.full(50, -30.0))) == 0


def test_digest_and_edges(spark):
    rows = [(1, "heron " * 3000), (2, None), (3, ""), (4, "é" * 32), (5, "heron " * 3000), (5, "x" * 65), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS feature")
    got = audio.digest(docs).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        raw = (text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want = (doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert want in [tuple(r)[:5] for r in got]
    by = {r.doc_id: r for r in got}
    assert by[2].media_sha256 == by[3].media_sha256
    assert len({r.feature for r in got if r.n_bytes == 18000}) == 1
    for doc_id, text in rows:  # the feature string from the text, without Spark and storage
        windows = audio.clip_windows(audio.to_wav(audio.payload(text or "")))
        values = np.round(windows.column("tensor").to_numpy_ndarray() * 2).astype("<i2").tobytes()
        spans = np.array([windows.column("start_ms").to_pylist(), windows.column("end_ms").to_pylist()], "<i8").tobytes()
        segment = np.array(windows.column("segments").to_pylist(), "<i4")
        want = f"{windows.num_rows}:{segment.max() + 1}:{hashlib.sha256(spans + segment.tobytes() + values).hexdigest()[:32]}"
        assert want in [r.feature for r in got if r.doc_id == doc_id]
    assert audio.digest(docs.limit(0)).count() == 0


def test_distinct_texts_have_distinct_features(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = audio.digest(docs).select("payload_sha256", "feature").distinct().collect()
    assert len({r.feature for r in got}) >= 0.99 * len({r.payload_sha256 for r in got})


def test_features_as_rows(spark):
    rng = np.random.default_rng(2)
    loud = "".join(chr(c) for c in rng.integers(33, 127, 9000))
    docs = spark.createDataFrame([(1, "~" * 9000 + loud + "~" * 9000), (2, None)], "doc_id long, text string")
    media = audio.encode(docs)
    rows = sorted(audio.features(media, 2, 3).collect(), key=lambda r: (r.doc_id, r.window))
    stored = {r.doc_id: audio.from_stream(bytes(r.features)) for r in audio.stored_features(media, 2, 3).collect()}
    for doc_id, table in stored.items():
        own = [r for r in rows if r.doc_id == doc_id]
        assert [list(r.tensor) for r in own] == table.column("tensor").combine_chunks().storage.to_pylist()
        assert [list(r.segments) for r in own] == table.column("segments").to_pylist()
        assert [(r.start_ms, r.end_ms) for r in own] == list(zip(table.column("start_ms").to_pylist(), table.column("end_ms").to_pylist()))
    nothing = spark.createDataFrame([(3, 0, None)], "doc_id long, n_bytes long, media binary")
    assert audio.features(nothing).count() == 0 and audio.stored_features(nothing).first().features is None
