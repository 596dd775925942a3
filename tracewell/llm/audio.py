"""Media columns: texts stored as 8-bit PCM audio, and features read from the stored bytes.

Samples are resampled by a polyphase filter, cut into overlapping windows for a
log-mel filterbank, and segmented by energy with hysteresis. The media are written as one
table; another is made of the stored bytes and holds each document's features as Arrow
fixed-shape tensors (FRAMES x MELS) with the time span that each one covers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import BATCH_BYTES, materialise, prepare, slices, utf8

RATE, UP, DOWN = 8000, 3, 4
WINDOW, HOP, MELS, FRAMES = 256, 128, 20, 32
TAPS, BLOCK = 16, 4096
#: Decibels above and below a document's median frame: a segment starts above the first and lasts while above the second.
HIGH_DB, LOW_DB = 1.0, -0.5


def padded(data: bytes, unit: int = 64) -> bytes:
    """data with bytes 0 appended up to a positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as the unsigned 8-bit samples of a one-channel WAV file."""
    tail = payload + bytes(len(payload) % 2)
    header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(tail), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return header + tail


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit one-channel WAV file; other formats are a ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit one-channel PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def polyphase_bank() -> np.ndarray:
    """(TAPS + DOWN, UP): column p holds the filter phase that makes output UP*m+p out of the samples from DOWN*m on."""
    half = TAPS // 2
    bank = np.zeros((TAPS + DOWN, UP))
    cutoff = min(1.0, UP / DOWN)
    for p in range(UP):
        at = p * DOWN / UP + half  # this output's place among the samples of the window
        k = np.arange(int(at) - half + 1, int(at) + half + 1)
        h = cutoff * np.sinc(cutoff * (k - at)) * (0.5 + 0.5 * np.cos(np.pi * np.clip((k - at) / half, -1, 1)))
        bank[k, p] = h / h.sum()
    return bank.astype(np.float32)


def mel_bank(rate: float) -> np.ndarray:
    """(WINDOW/2+1, MELS) triangular filters, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, WINDOW // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


BANK, MEL, HANN = polyphase_bank(), mel_bank(RATE * UP / DOWN), np.hanning(WINDOW).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Unsigned 8-bit samples at RATE as floats in [-1, 1) at RATE*UP/DOWN; works through them in blocks."""
    groups = -(-len(samples) // DOWN)
    x = np.full(groups * DOWN + TAPS + DOWN, 128, np.uint8)
    x[TAPS // 2 : TAPS // 2 + len(samples)] = samples
    out = np.empty((groups, UP), np.float32)
    for m in range(0, groups, BLOCK * 8):
        n = min(groups, m + BLOCK * 8)
        part = (x[m * DOWN : n * DOWN + TAPS].astype(np.float32) - 128) / 128
        out[m:n] = np.lib.stride_tricks.sliding_window_view(part, TAPS + DOWN)[::DOWN] @ BANK
    return out.reshape(-1)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) log-mel energies of overlapping windows; the last window is filled with silence."""
    frames = max(1, -(-(len(y) - WINDOW) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (frames - 1) * HOP + WINDOW - len(y)), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    out = np.empty((frames, MELS), np.float32)
    for k in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(windows[k : k + BLOCK] * HANN, axis=1)
        out[k : k + BLOCK] = np.log(1e-6 + (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ MEL)
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans of loud passages: maximal runs above the low threshold that have a frame above the high one."""
    energy = mel.mean(axis=1) * (10 / np.log(10))
    middle = np.median(energy)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], energy > middle + LOW_DB, [False]]).astype(np.int8)))
    loud = np.concatenate([[0], np.cumsum(energy > middle + HIGH_DB)])
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if loud[b] > loud[a]]


def tensors(mel: np.ndarray) -> np.ndarray:
    """(n, FRAMES, MELS): consecutive frames, the last tensor filled with the level of silence."""
    n = -(-len(mel) // FRAMES)
    return np.concatenate([mel, np.full((n * FRAMES - len(mel), MELS), np.log(np.float32(1e-6)), np.float32)]).reshape(n, FRAMES, MELS)


#: A document's features: one row for each tensor, stored as an Arrow record batch. loud tells whether an energy segment overlaps the span.
TENSORS = pa.schema([("log_mel", pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("loud", pa.bool_())])
MS = 1000 * DOWN / (RATE * UP)


def packed_features(mel: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """The record batch of TENSORS of a document's frames, serialised."""
    values = tensors(mel).astype(np.float16)
    first = np.arange(len(values)) * FRAMES
    last = np.minimum(first + FRAMES, len(mel))
    edge = np.zeros(len(mel) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    loud = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), FRAMES * MELS)
    columns = [pa.ExtensionArray.from_storage(TENSORS.field(0).type, flat), pa.array((first * HOP * MS).astype(np.int64)), pa.array((((last - 1) * HOP + WINDOW) * MS).astype(np.int64)), pa.array(loud[last] > loud[first])]
    return pa.RecordBatch.from_arrays(columns, schema=TENSORS).serialize().to_pybytes()


def stored_features(data: bytes) -> pa.RecordBatch:
    """The record batch of TENSORS that packed_features() serialised."""
    return pa.ipc.read_record_batch(pa.py_buffer(data), TENSORS)


def summary(frames: int, spans: list[tuple[int, int]], batch: pa.RecordBatch) -> str:
    """Stored features in a line: frames, segments, mean level of the bands, and a checksum of all values at a hundredth."""
    mel = batch.column(0).to_numpy_ndarray().reshape(-1, MELS)[:frames].astype(np.float32)
    level = np.round(mel.mean(axis=0, dtype=np.float64), 1) + 0.0
    whole = zlib.crc32(np.round(mel * 100).astype("<i2").tobytes())
    return f"frames={frames};segments={len(spans)};loud={sum(b - a for a, b in spans)};mel={','.join(f'{v:.1f}' for v in level)};crc={whole:08x}"


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary) of every document, written to the shared folder.

    The media is a WAV file of the text's bytes, filled with bytes 0 up to a positive
    multiple of 64. Null and empty texts are 64 bytes of 0; repeated rows give repeated
    rows, null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES // 4):
                data, at = utf8(part.column(1))
                media = [to_wav(padded(data[a:b].tobytes())) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return materialise(df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n_bytes long, media binary"), "media")


def feature_table(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes long, payload_sha256 string, tail_crc32, media_bytes long, media_sha256 string, frames int, segments array<struct<start,end>>, features binary) of the stored media, written to the shared folder.

    All of it is computed from the stored bytes. segments are spans of frames; features
    is a record batch of TENSORS, see stored_features(). A null or empty text is
    64 bytes 0 in a file like any other; repeated rows give repeated rows, null ids stay,
    no media give no rows.
    """
    prepare(media.sparkSession)
    kind = media.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, segments array<struct<start:int,end:int>>, features binary"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments", "features"]

    def described(stored: bytes) -> tuple:
        back, _ = from_wav(stored)
        mel = log_mel(resample(np.frombuffer(back, np.uint8)))
        spans = segments(mel)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mel), [{"start": a, "end": b} for a, b in spans], packed_features(mel, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", BATCH_BYTES // 4):
                rows = [described(m) for m in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["id", "n_bytes", *names])

    return materialise(media.select("id", "n_bytes", "media").mapInArrow(run, schema), "features")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: lengths and checksums of its payload and media, and its stored features in a line; see media_table()."""
    stored = feature_table(media_table(docs, id_col, text_col))
    names = [c for c in stored.columns if c not in ("frames", "segments", "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = [summary(n, [(s["start"], s["end"]) for s in spans], stored_features(data)) for n, spans, data in zip(*(batch.column(c).to_pylist() for c in ("frames", "segments", "features")), strict=True)]
            yield batch.select(names).append_column("feature", pa.array(line, pa.string()))

    schema = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in names)
    return stored.mapInArrow(run, f"{schema}, feature string").withColumnRenamed("id", id_col)
