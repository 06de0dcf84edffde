"""Media columns: texts kept losslessly as 8-bit mono WAV clips, and audio features of the stored clips.

Storing: UTF-8 bytes, padded with spaces to a positive multiple of 192, become the unsigned samples of a WAV file at RATE.
Features of a clip: polyphase resampling by UP/DOWN, log-mel energies of overlapped Hann frames, and segments of high energy found
with two thresholds (hysteresis).  The frames are cut into windows of a fixed shape (WINDOW, MELS).  The windows of a batch of clips are
stored as an Arrow stream with a fixed-shape tensor column of float16 and the time span of each window, in milliseconds; segments
have time spans, too.  ``read_features`` reads these tensors back, one row a clip.  A clip is worked on alone and in blocks of BLOCK
samples, so equal clips give equal values and memory stays bounded for any length.

Edge cases: null and empty texts are 192 spaces; repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, materialize, prepare, table, text_bytes, tidied

UNIT, HEADER = 192, 44
RATE, UP, DOWN, TAPS = 12_000, 2, 3, 8
FRAME, HOP, MELS, WINDOW = 256, 128, 24, 32
BLOCK = HOP * DOWN * 2048  # samples in, a whole number of hops out
FLOOR = 1e-6


def wav_header(n: int) -> bytes:
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: a WAV file for each text."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n = np.diff(offsets)
            padded = np.maximum(-(-n // UNIT), 1) * UNIT
            at = np.concatenate([[0], np.cumsum(padded + HEADER)])
            out = np.full(at[-1], 32, np.uint8)
            out[np.arange(len(data)) + np.repeat(at[:-1] + HEADER - offsets[:-1], n)] = data
            if len(n):
                heads = np.frombuffer(b"".join(map(wav_header, padded.tolist())), np.uint8)
                out[(at[:-1, None] + np.arange(HEADER)).ravel()] = heads
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), binary_column(out, at)], names=["doc_id", "n_bytes", "media"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def samples(wav: bytes) -> np.ndarray:
    """The unsigned 8-bit samples of a stored clip; its header is checked."""
    n = len(wav) - HEADER
    if wav[:HEADER] != wav_header(n):
        raise ValueError("not a clip of this format")
    return np.frombuffer(wav, np.uint8, n, HEADER)


@cache
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase branches of a windowed-sinc low pass, the frame window and the mel filterbank."""
    t = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(t * cut) * cut * np.hamming(UP * TAPS) * UP
    branches = h.reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = np.linspace(mel(0), mel(rate / 2), MELS + 2)
    bins = mel(np.arange(FRAME // 2 + 1) * rate / FRAME)
    up, down = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1], (edges[None, 2:] - bins[:, None]) / np.diff(edges)[None, 1:]
    bank = np.clip(np.minimum(up, down), 0, None).astype(np.float32)
    return branches, np.hanning(FRAME).astype(np.float32), bank


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling of float32 samples by UP/DOWN: output m is branch (m * DOWN) % UP at input m * DOWN // UP."""
    branches = _filters()[0]
    n = len(x) * UP // DOWN
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1, np.float32), x]), TAPS)
    out = np.empty(n, np.float32)
    for first in range(UP):
        m = len(range(first, n, UP))
        start = first * DOWN // UP
        out[first::UP] = windows[start : start + (m - 1) * DOWN + 1 : DOWN][:m] @ branches[first * DOWN % UP] if m else 0
    return out


def log_mel(clip: np.ndarray) -> np.ndarray:
    """(frames, MELS) natural-log mel energies of unsigned 8-bit samples, block by block; at least one frame."""
    _, window, bank = _filters()
    parts, tail = [], np.zeros(0, np.float32)
    for a in range(0, len(clip), BLOCK):
        block = np.concatenate([clip[max(0, a - DOWN * TAPS) : a], clip[a : a + BLOCK]]).astype(np.float32) / 128 - 1
        skip = UP * TAPS if a else 0
        tail = np.concatenate([tail, resample(block)[skip:]])
        if a + BLOCK >= len(clip):  # the last frame is filled with silence
            n = max(1, -(-(len(tail) - FRAME + HOP) // HOP))
            tail = np.concatenate([tail, np.zeros(max(0, (n - 1) * HOP + FRAME - len(tail)), np.float32)])
        n = (len(tail) - FRAME) // HOP + 1
        if n > 0:
            frames = np.lib.stride_tricks.sliding_window_view(tail, FRAME)[::HOP][:n] * window
            spectrum = np.fft.rfft(frames, axis=1)
            power = spectrum.real**2 + spectrum.imag**2
            parts.append(np.log(np.maximum(power.astype(np.float32) @ bank, FLOOR)))
            tail = tail[n * HOP :]
    return np.concatenate(parts)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames between rising above the upper threshold and falling below the lower one; thresholds follow the clip's median."""
    energy = mel.mean(axis=1)
    middle = np.median(energy)
    state = np.where(energy > middle + 0.25, 1, np.where(energy < middle - 0.25, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[last] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


#: Milliseconds of a hop.
HOP_MS = HOP * 1000 * DOWN / (RATE * UP)
_SPAN = pa.struct([("start_ms", pa.float64()), ("stop_ms", pa.float64())])
_CLIP = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("segment_spans", pa.list_(_SPAN))])
CLIP = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segment_spans array<struct<start_ms:double,stop_ms:double>>"
STORED = f"clips array<struct<{CLIP.replace(' ', ':').replace(',:', ',')}>>, windows binary"
#: The columns of a stream of windows: the clip's place among the row's clips, its span and its tensor.
WINDOWS = pa.schema([("clip", pa.int32()), ("start_ms", pa.float64()), ("stop_ms", pa.float64()), ("log_mel", pa.fixed_shape_tensor(pa.float16(), (WINDOW, MELS)))])


def pack(mels: list[np.ndarray]) -> bytes:
    """The windows of some clips as an Arrow stream; a clip's last window is filled with silence."""
    many = np.array([-(-len(m) // WINDOW) for m in mels], np.int64)
    flat = np.full((int(many.sum()) * WINDOW, MELS), np.log(FLOOR), np.float16)
    at = np.cumsum(many) - many
    for m, k in zip(mels, at.tolist(), strict=True):
        flat[k * WINDOW : k * WINDOW + len(m)] = m
    place = np.arange(len(flat) // WINDOW) - np.repeat(at, many)
    frames = np.repeat([len(m) for m in mels], many)
    tensors = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel(), pa.float16()), WINDOW * MELS)
    columns = [pa.array(np.repeat(np.arange(len(mels), dtype=np.int32), many)), pa.array(place * WINDOW * HOP_MS), pa.array(np.minimum(frames, (place + 1) * WINDOW) * HOP_MS), pa.ExtensionArray.from_storage(WINDOWS.field("log_mel").type, tensors)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WINDOWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=WINDOWS))
    return sink.getvalue().to_pybytes()


def unpack(windows: bytes) -> pa.Table:
    """The windows of a stored row: WINDOWS, with the tensors as an Arrow extension column."""
    return pa.ipc.open_stream(windows).read_all()


def features(media: DataFrame) -> DataFrame:
    """STORED: checksums and segments of stored clips (doc_id, n_bytes, media), and the tensors of their windows; one row a batch."""
    kind = pa.schema([("clips", pa.list_(pa.struct(list(_CLIP)))), ("windows", pa.binary())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, mels = [], []
            for doc_id, n_bytes, wav in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                mel, payload = log_mel(samples(wav)), wav[HEADER:]
                mels.append(mel)
                spans = [{"start_ms": a * HOP_MS, "stop_ms": b * HOP_MS} for a, b in segments(mel)]
                rows.append(dict(zip(_CLIP.names, (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), spans), strict=True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([rows], kind.field(0).type), pa.array([pack(mels)])], schema=kind)

    prepare(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, STORED)


def read_features(stored: DataFrame) -> DataFrame:
    """One row a clip, from the stored tensors: CLIP, n_windows, log_mel (the bytes of its tensors) and window_spans."""
    kind = pa.schema([*_CLIP, ("n_windows", pa.int32()), ("log_mel", pa.binary()), ("window_spans", pa.list_(_SPAN))])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clips, windows in zip(batch.column(0), batch.column(1), strict=True):
                clips, t = clips.values, unpack(windows.as_py()).combine_chunks()
                n = np.bincount(t["clip"].to_numpy(), minlength=len(clips))
                at = np.concatenate([[0], np.cumsum(n)])
                data = t["log_mel"].combine_chunks().storage.flatten().to_numpy(zero_copy_only=False).astype("<f2").view(np.uint8) if len(t) else np.zeros(0, np.uint8)
                spans = pa.StructArray.from_arrays([t["start_ms"].combine_chunks(), t["stop_ms"].combine_chunks()], fields=list(_SPAN))
                more = [pa.array(n, pa.int32()), binary_column(data, at * WINDOW * MELS * 2), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)]
                yield pa.RecordBatch.from_arrays([*clips.flatten(), *more], schema=kind)

    return stored.select("clips", "windows").mapInArrow(run, f"{CLIP}, n_windows int, log_mel binary, window_spans array<struct<start_ms:double,stop_ms:double>>")


def op4_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(store(table(spark, sf_dir, "documents")), "media")
    rows = read_features(materialize(features(media), "features", "none"))
    feature = F.concat_ws(":", "n_windows", F.size("segment_spans"), F.sha2("log_mel", 256), F.sha2(F.to_json("segment_spans"), 256))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
