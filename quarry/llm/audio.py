"""Audio columns: lossless 8-bit WAV storage and features of the stored sound (operator 7).

``to_wav`` stores a payload as the unsigned 8-bit mono samples of a RIFF/WAVE
file; ``from_wav`` reads a file's chunks back. The features are computed from
the samples read back:

* polyphase resampling by ``UP / DOWN`` with a windowed-sinc low-pass, whose
  taps are dealt to ``UP`` phases so that no zero is ever multiplied;
* log-mel energies over frames of ``FRAME`` samples that overlap by half;
* segments of frame energy by hysteresis: one opens above ``HIGH`` of the
  sound's energy range and closes below ``LOW``.

The log-mel frames of a sound are cut into tensors of the fixed shape ``TENSOR``,
``TENSOR[0]`` frames each, the last one filled with zeros; every tensor has the
start and end of its frames in milliseconds. No frame is averaged away, so a
long sound has many tensors. They are stored as columns of the Arrow type
``fixed_shape_tensor``, with their sound's number and time span, in Arrow IPC
streams of a few megabytes; a stream is a binary value of a Parquet table in the
shared folder, so any store that Spark writes can hold it.

``digests`` writes the media, reads them back, writes the features of what it
read, and reads these back in turn. Long sounds are processed ``BLOCK`` frames at
a time; sums are taken in one fixed order, so equal payloads have equal features
whatever their neighbours in a batch are.

Defined cases: a null text is an empty one, and an empty payload is one unit of
padding; a null doc_id stays null; repeated rows give repeated rows; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import per_batch, utf8, written

UNIT, PAD = 576, 255
RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, MELS, BLOCK = 256, 128, 16, 2048
TENSOR = (16, MELS)
LOW, HIGH = 0.4, 0.6


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of 576."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    odd = b"\0" * (len(samples) % 2)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + odd
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(file: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(file):
        kind, size = struct.unpack_from("<4sI", file, at)
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", file, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("only 8-bit mono is stored here")
        elif kind == b"data":
            return rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def phases() -> np.ndarray:
    """UP rows of TAPS taps: the low-pass dealt to the phases of the output."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h * UP / h.sum()).reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def resampled(x: np.ndarray) -> np.ndarray:
    """``x`` at UP / DOWN times its rate: output k uses phase k * DOWN mod UP and TAPS neighbours of x[k * DOWN // UP]."""
    n = len(x) * UP // DOWN
    wide = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(wide, TAPS)
    out = np.empty(n, np.float32)
    for r in range(UP):
        k = np.arange(r, n, UP)
        out[r::UP] = np.einsum("ij,j->i", windows[k * DOWN // UP], phases()[(r * DOWN) % UP])
    return out


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    """MELS triangles over the bins of a real spectrum, spaced evenly in mel."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, DOWN / UP / RATE)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None).T.astype(np.float32)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that open above HIGH and close below LOW of the energy's range."""
    low, high = energy.min(), energy.max()
    if high <= low:
        return []
    level = (energy - low) / (high - low)
    mark = np.where(level >= HIGH, 1, np.where(level < LOW, -1, 0))
    at = np.flatnonzero(mark)
    last = np.zeros(len(mark), np.int64)
    last[at] = at
    state = mark[np.maximum.accumulate(last)] == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], state, [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def log_mel(samples: bytes) -> np.ndarray:
    """(frames, MELS) log-mel energies of 8-bit samples; a sound shorter than a frame is one frame."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resampled(x)
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank()
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[at : at + BLOCK] = np.log1p(np.einsum("ij,jk->ik", power, bank))
    return out


def span(first: int, last: int, rate: int = RATE) -> tuple[float, float]:
    """Start and end in milliseconds of the frames from first to last."""
    ms = 1000 * DOWN / UP / rate
    return round(first * HOP * ms, 3), round((last * HOP + FRAME) * ms, 3)


def features(samples: bytes, rate: int = RATE) -> dict:
    """tensors (n, *TENSOR), spans (start and end in ms of each), n_frames, segments (start and end in ms)."""
    mel = log_mel(samples)
    n, size = len(mel), TENSOR[0]
    count = -(-n // size)
    tensors = np.concatenate([mel, np.zeros((count * size - n, MELS), np.float32)]).reshape(count, *TENSOR)
    found = segments(mel.sum(axis=1, dtype=np.float64))
    return {
        "tensors": tensors,
        "spans": [span(k * size, min(n, (k + 1) * size) - 1, rate) for k in range(count)],
        "n_frames": n,
        "segments": [span(a, b - 1, rate) for a, b in found],
    }


def tensor_column(tensors: list[np.ndarray]) -> pa.ExtensionArray:
    """Tensors as one Arrow column of a fixed shape."""
    stacked = np.concatenate(tensors) if tensors else np.zeros((0, *TENSOR), np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), TENSOR)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(stacked.reshape(-1)), TENSOR[0] * TENSOR[1])
    return pa.ExtensionArray.from_storage(kind, storage)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    """A stored stream as an Arrow table; tensors come back as ``fixed_shape_tensor``."""
    return pa.ipc.open_stream(data).read_all()


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a WAV file."""

    def run(batch: pa.RecordBatch) -> dict:
        data = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "n_bytes": [len(d) for d in data], "media": [to_wav(padded(d)) for d in data]}

    return docs.select(F.col("doc_id").cast("long"), utf8(F.col("text").cast("string"))).mapInArrow(per_batch(run, s := "doc_id long, n_bytes long, media binary"), s)


def featured(media: DataFrame) -> DataFrame:
    """(sounds, tensors): Arrow IPC streams of the features of a table (doc_id, n_bytes, media).

    ``sounds`` has a row per sound; ``tensors`` has (sound, start_ms, end_ms, tensor), where sound
    is the place in ``sounds`` of the same row.
    """

    def run(batch: pa.RecordBatch) -> dict:
        sounds: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "segments")}
        tensors, owner, spans = [], [], []
        for k, file in enumerate(batch.column(2).to_pylist()):
            rate, samples = from_wav(file)
            got = features(samples, rate)
            for name, value in zip(sounds, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(file), hashlib.sha256(file).hexdigest(), got["n_frames"], got["segments"])):
                sounds[name].append(value)
            tensors.append(got["tensors"])
            owner += [k] * len(got["spans"])
            spans += got["spans"]
        kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "segments": pa.list_(pa.list_(pa.float64(), 2))}
        rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in sounds.items())], names=["doc_id", "n_bytes", *sounds])
        start, end = (pa.array([s[k] for s in spans], pa.float64()) for k in (0, 1))
        cut = pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), start, end, tensor_column(tensors)], names=["sound", "start_ms", "end_ms", "tensor"])
        return {"sounds": [to_ipc(rows)], "tensors": [to_ipc(cut)]}

    return media.select("doc_id", "n_bytes", "media").mapInArrow(per_batch(run, s := "sounds binary, tensors binary"), s)


def described(streams: DataFrame) -> DataFrame:
    """One row per sound, from the stored streams.

    ``feature`` states segments, frames and mean level, then a hash over all frames and spans.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tensors int, segments array<array<double>>"

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f: [] for f in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tensors", "segments")}
        for rows, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sounds, parts = from_ipc(rows).to_pydict(), from_ipc(cut).combine_chunks()
            owner = parts["sound"].to_numpy()
            tensors = parts["tensor"].combine_chunks().to_numpy_ndarray() if len(owner) else np.zeros((0, *TENSOR), np.float32)
            spans = np.stack([parts["start_ms"].to_numpy(), parts["end_ms"].to_numpy()], axis=1)
            edge = np.searchsorted(owner, np.arange(len(sounds["doc_id"]) + 1))
            for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                level = np.round(tensors[a:b].reshape(-1, MELS)[: sounds["n_frames"][k]].astype(np.float64), 3) + 0.0
                digest = hashlib.sha256(level.astype("<f8").tobytes() + spans[a:b].astype("<f8").tobytes()).hexdigest()[:16]
                out["feature"].append(f"segments={len(sounds['segments'][k])};frames={len(level)};level={level.mean():.3f};mel={digest}")
                out["n_tensors"].append(b - a)
            for name in out:
                if name in sounds:
                    out[name] += sounds[name]
        return out

    return streams.mapInArrow(per_batch(run, schema, rows=1), schema)


def digests(docs: DataFrame) -> DataFrame:
    """Every whole text stored as a WAV file, read back, its features stored and read back."""
    media = written(stored(docs), "audio-media")
    return described(written(featured(media), "audio-features"))
