"""Audio columns: lossless 8-bit WAV, polyphase resampling, log-mel features, energy segments, tensors.

Media are WAV bytes of 8-bit mono samples. Features of a clip are made in four steps:

1. polyphase resampling by ``up / down`` with a windowed-sinc filter, one filter branch per phase;
2. log-mel energies of overlapping frames;
3. segments by hysteresis: a segment begins where the energy exceeds the upper level and ends where it
   falls below the lower one (levels lie between the clip's own quiet and loud quantiles);
4. windows over all frames from the first to the last, each a tensor of ``FRAMES x MELS`` values with the
   time span that it covers and the segment of each of its frames.

The windows of a clip are stored as an Arrow stream whose tensor column has Arrow's fixed-shape tensor
type. Clips are worked through in blocks, so memory beside the clip and its features is bounded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import text_or_empty, to_arrow

RATE = 16_000
#: The resampling ratio unless another is asked for, and filter zero crossings on each side.
UP, DOWN, TAPS = 3, 8, 12
FRAME, HOP, FFT, MELS = 200, 80, 256, 40
FRAMES = 32
#: Quiet and loud quantiles of a clip's frame energy, the parts of the way between them at which a
#: segment opens and closes, and frames a segment has at least.
QUIET, LOUD, OPEN, CLOSE, LEAST_FRAMES = 0.05, 0.95, 0.6, 0.3, 5
#: Frames that are worked on at once.
BLOCK = 8192
FLOOR_DB = -100.0

#: Windows of a clip as they are stored: frames beyond the last one hold ``FLOOR_DB`` and segment -1.
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
WINDOWS = pa.schema([("window", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("tensor", TENSOR), ("segments", pa.list_(pa.int32(), FRAMES))])

#: Bytes of results that a task gathers before it hands them on, about.
GATHERED = 4 << 20


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM samples with their header; an odd number of samples gets the pad byte of the format."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and their rate, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int) -> np.ndarray:
    """One row per phase: the windowed-sinc branch that makes outputs of that phase."""
    cut = 1 / max(up, down)
    half = TAPS * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n * cut) * cut * np.kaiser(len(n), 6.0) * up
    width = -(-len(h) // up)
    return np.stack([np.pad(h[p::up], (0, width - len(h[p::up]))) for p in range(up)]).astype(np.float32)


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``samples`` at up / down of their rate; beyond both ends the signal is zero."""
    n, branches = -(-len(samples) * up // down), phases(up, down)
    width, half = branches.shape[1], TAPS * max(up, down)
    padded = np.pad(samples.astype(np.float32), (width, width + down + half))
    out = np.zeros(n, np.float32)
    for j in range(min(up, n)):
        # Output j sits at j * down on the upsampled grid; its branch is that of phase (j * down + half) mod up.
        newest, p = divmod(j * down + half, up)  # newest input sample under the filter
        view = np.lib.stride_tricks.sliding_window_view(padded[newest + 1 :], width)[::down][: len(range(j, n, up))]
        for k in range(0, len(view), 4 * BLOCK):
            out[j::up][k : k + 4 * BLOCK] = view[k : k + 4 * BLOCK] @ branches[p][::-1]
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters at equal steps of the mel scale, as ``bins x MELS``."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    up, down = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(signal: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows (dB) of overlapping frames, and each frame's energy (dB).

    The last frame is filled up with zeros, so that no sample is left out; a short signal gives one frame.
    """
    signal = np.pad(signal, (0, max(0, FRAME - len(signal), -(len(signal) - FRAME) % HOP if len(signal) > FRAME else 0)))
    bank = mel_bank(rate)
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    mels, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for k in range(0, len(frames), BLOCK):
        part = frames[k : k + BLOCK] * WINDOW
        spectrum = np.fft.rfft(part, FFT)
        mels[k : k + BLOCK] = 10 * np.log10(np.maximum((spectrum.real**2 + spectrum.imag**2) @ bank, 1e-10))
        energy[k : k + BLOCK] = 10 * np.log10(np.maximum((part * part).mean(1), 1e-10))
    return mels, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """``(start, end)`` frames of segments by hysteresis; none in a clip whose levels are equal."""
    quiet, loud = np.quantile(energy, (QUIET, LOUD))
    if loud <= quiet:
        return np.zeros((0, 2), np.int64)
    high, low = quiet + OPEN * (loud - quiet), quiet + CLOSE * (loud - quiet)
    said = np.where(energy > high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(said != 0, np.arange(len(said)), -1))
    on = np.concatenate([[False], (last >= 0) & (said[last] == 1), [False]])
    turns = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    return turns[turns[:, 1] - turns[:, 0] >= LEAST_FRAMES]


def clip_windows(media: bytes, up: int = UP, down: int = DOWN) -> pa.RecordBatch:
    """The windows of a clip, with the schema ``WINDOWS``."""
    samples, rate = from_wav(media)
    mels, energy = log_mel(resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128, up, down), rate * up / down)
    segment = np.full(-(-len(mels) // FRAMES) * FRAMES, -1, np.int32)
    for k, (a, b) in enumerate(segments(energy).tolist()):
        segment[a:b] = k
    starts = np.arange(0, len(segment), FRAMES)
    ms = 1000 * HOP * down / (rate * up)
    values = np.concatenate([mels, np.full((len(segment) - len(mels), MELS), FLOOR_DB, np.float32)])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS)
    columns = [
        pa.array(np.arange(len(starts), dtype=np.int32)),
        pa.array(np.rint(starts * ms).astype(np.int64)),
        pa.array(np.rint(np.minimum(starts + FRAMES, len(mels)) * ms).astype(np.int64)),
        pa.ExtensionArray.from_storage(TENSOR, flat),
        pa.FixedSizeListArray.from_arrays(pa.array(segment), FRAMES),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=WINDOWS)


def to_stream(windows: pa.RecordBatch) -> bytes:
    """A record batch as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, windows.schema) as writer:
        writer.write_batch(windows)
    return sink.getvalue().to_pybytes()


def from_stream(stored: bytes) -> pa.Table:
    """The windows of a stored stream; another schema than ``WINDOWS`` is an error."""
    with pa.ipc.open_stream(stored) as reader:
        found = reader.read_all()
    if found.schema != WINDOWS:
        raise ValueError("not the features of a clip")
    return found


def payload(text: str) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8", "replace")
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def per_row(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str, *args) -> DataFrame:
    """The rows that ``fn(*row, *args)`` yields for each row of ``df``, handed on in batches of bounded bytes."""
    out_schema = to_arrow(schema)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for made in fn(*row, *args):
                    rows.append(made)
                    size += sum(len(x) if isinstance(x, (bytes, str)) else x.nbytes if isinstance(x, np.ndarray) else 8 for x in made)
                    if size > GATHERED:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out_schema.types)], schema=out_schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out_schema.types)], schema=out_schema)

    return df.mapInArrow(run, schema)


def encoded(doc_id: int | None, text: str) -> Iterator[tuple]:
    """The row of ``encode`` for a text."""
    yield doc_id, len(text.encode("utf-8", "replace")), to_wav(payload(text))


def with_features(doc_id: int | None, n_bytes: int, clip: bytes | None, up: int, down: int) -> Iterator[tuple]:
    """The row of ``stored_features`` for a clip."""
    yield doc_id, n_bytes, clip, None if clip is None else to_stream(clip_windows(clip, up, down))


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's payload as a WAV file; a null text counts as empty."""
    return per_row(docs.select("doc_id", text_or_empty()), encoded, "doc_id long,n_bytes long,media binary")


def stored_features(media: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """All columns ``doc_id, n_bytes, media`` of clips and ``features``: their windows as an Arrow stream of ``WINDOWS``.

    Null media have null features; repeated rows stay.
    """
    return per_row(media.select("doc_id", "n_bytes", "media"), with_features, "doc_id long,n_bytes long,media binary,features binary", up, down)


def features(media: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """One row per window of ``doc_id, media`` clips, with the tensor flat in row order; null media have no rows."""

    def run(doc_id, clip, up, down):
        if clip is not None:
            windows = clip_windows(clip, up, down)
            tensors = windows.column("tensor").to_numpy_ndarray()
            for k, (start, end, segment) in enumerate(zip(*(windows.column(c).to_pylist() for c in ("start_ms", "end_ms", "segments")))):
                yield doc_id, k, start, end, tensors[k].ravel(), segment

    return per_row(media.select("doc_id", "media"), run, "doc_id long,window int,start_ms long,end_ms long,tensor array<float>,segments array<int>", up, down)


def feature_digest(stored: bytes) -> str:
    """Windows, segments and a hash of a stored clip's spans, segments and values in half decibels."""
    windows = from_stream(stored).combine_chunks()
    values = windows.column("tensor").chunk(0).to_numpy_ndarray()
    segment = np.array(windows.column("segments").chunk(0).flatten())
    spans = np.stack([windows.column(c).to_numpy() for c in ("start_ms", "end_ms")])
    seen = hashlib.sha256(spans.astype("<i8").tobytes() + segment.astype("<i4").tobytes() + np.round(values * 2).astype("<i2").tobytes())
    return f"{len(values)}:{segment.max() + 1}:{seen.hexdigest()[:32]}"


def digest(docs: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """Store each whole text as a clip and its features as tensors, read both back, and return digests.

    One row passes through ``encode`` and ``stored_features`` in the same worker, so the stored bytes of a
    batch are never held together. A null or empty text is 64 zero bytes; equal texts give equal values;
    repeated rows stay; other columns are not read; an empty table gives no rows.
    """

    def run(doc_id, text, up, down):
        for _, n_bytes, media in encoded(doc_id, text):
            for *_, stored in with_features(doc_id, n_bytes, media, up, down):
                back, _ = from_wav(media)
                yield doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_digest(stored)

    schema = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string"
    return per_row(docs.select("doc_id", text_or_empty()), run, schema, up, down)
