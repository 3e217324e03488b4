"""Media columns: texts stored as WAV audio, read back and fingerprinted.

A payload (the text's UTF-8 bytes, padded with 255 to a positive multiple of 576) is
written by the ``wave`` module as mono 8-bit samples and read back from the stored
bytes. Frames of 288 samples, half overlapping, go through a Hann window and a real FFT;
each of two frequency bands gives at most one peak a frame. A low peak is paired with
the high one a frame later, a high peak with the low one two frames later. A pair is
coded with its time as one integer: frame << 32 | first bin << 20 | second bin << 8 |
distance.

Magnitudes are compared on a rounded logarithmic scale, lower bin first, so equal
payloads have equal fingerprints. Long payloads are transformed in blocks of frames.

Defined cases: null text is empty text, stored as 576 bytes of padding, which has
no peak; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, text_buffers

UNIT = 576  # payloads are whole multiples of this
FRAME, HOP = 288, 144
RATE = 8000
BANDS = ((2, 48), (48, FRAME // 2 + 1))
#: Steps an octave on which magnitudes are compared, and the least power of a peak.
STEPS, FLOOR = 16, 1.0
BLOCK_FRAMES = 2048
_WINDOW = np.hanning(FRAME)


def payload(raw: bytes) -> bytes:
    short = -len(raw) % UNIT if raw else UNIT
    return raw + b"\xff" * short


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Bin of the peak of each frame and band; -1 where there is none."""
    frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(samples, np.uint8), FRAME)[::HOP]
    out = np.full((len(frames), len(BANDS)), -1, np.int64)
    for at in range(0, len(frames), BLOCK_FRAMES):
        part = frames[at : at + BLOCK_FRAMES].astype(np.float64)
        part -= part.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(part * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        level = np.rint(np.log2(np.maximum(power, FLOOR)) * (STEPS / 2)).astype(np.int32)
        for k, (lo, hi) in enumerate(BANDS):
            best = level[:, lo:hi].argmax(axis=1)
            found = np.take_along_axis(level[:, lo:hi], best[:, None], axis=1)[:, 0] > 0
            out[at : at + len(part), k] = np.where(found, best + lo, -1)
    return out


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs, ascending."""
    p = peaks(samples)
    codes = []
    for step, a, b in ((1, 0, 1), (2, 1, 0)):
        first, second = p[:-step, a], p[step:, b]
        t = np.flatnonzero((first >= 0) & (second >= 0))
        codes.append(t << 32 | first[t] << 20 | second[t] << 8 | step)
    return np.sort(np.concatenate(codes))


def media_rows(df: DataFrame, id_col: str, text_col: str, keep_media: bool = False) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprint[, media])."""
    fields = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "fingerprint": pa.list_(pa.int64())}

    def run(batches):
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            for lo in range(0, len(batch), 256):
                rows, media = [], []
                hi = min(lo + 256, len(batch))
                for i in range(lo, hi):
                    text = raw[offsets[i] : offsets[i + 1]].tobytes()
                    stored = to_wav(payload(text))
                    read = from_wav(stored)
                    rows.append((len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), fingerprint(read)))
                    media.append(stored if keep_media else None)
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), fields.values(), strict=True))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(media, pa.binary())] * keep_media, names=["id", *fields, *["media"] * keep_media])

    schema = f"id {id_type(df, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema + ", media binary" * keep_media)
