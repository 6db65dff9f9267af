"""Media columns: bytes kept as WAV files of 8-bit samples, and fingerprints from pairs of spectral peaks.

A fingerprint is an array of pairs. Each pair takes an anchor peak and a later peak and has a code
(anchor bin, bin of the other, frames between) and the anchor's frame, so that two recordings can be
aligned by the differences of the times of equal codes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from .common import with_columns

PAD, RATE = 64, 8000
#: Samples in a frame and from one frame to the next.
FRAME, HOP = 512, 256
#: Edges of the bands of frequency bins; a frame has at most one peak in each.
BANDS = [2, 12, 28, 60, 120, 257]
#: An anchor is paired with the strongest peak of each of so many frames behind it.
FAN = 2
#: Frames that are transformed at once: it bounds the memory that a long recording takes.
BLOCK = 1024

_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD if data else PAD)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getsampwidth() != 1 or f.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return f.readframes(f.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin (0: none) and magnitude of the peak of each frame and band, by a short-time Fourier transform.

    The last frame is filled with silence. A peak is the first largest bin of its band, if it is
    above the mean of the frame's spectrum.
    """
    n = max(1, -(-len(samples) // HOP))
    bins, power = np.zeros((n, len(BANDS) - 1), np.int64), np.zeros((n, len(BANDS) - 1), np.float32)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        x = np.zeros((b - a - 1) * HOP + FRAME, np.float32)
        part = samples[a * HOP : a * HOP + len(x)]
        x[: len(part)] = part
        x[: len(part)] -= 128
        spectrum = np.abs(np.fft.rfft(sliding_window_view(x, FRAME)[::HOP] * _WINDOW))
        mean = spectrum.mean(axis=1)
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            at = spectrum[:, low:high].argmax(axis=1) + low
            top = spectrum[np.arange(b - a), at]
            bins[a:b, k] = np.where(top > mean, at, 0)
            power[a:b, k] = np.where(top > mean, top, 0)
    return bins, power


def pairs(bins: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs of a frame's strongest peak with the strongest of the next FAN frames."""
    strongest = np.take_along_axis(bins, power.argmax(axis=1)[:, None], axis=1)[:, 0]
    times, codes = [], []
    for gap in range(1, FAN + 1):
        anchor, other = strongest[:-gap], strongest[gap:]
        t = np.flatnonzero((anchor > 0) & (other > 0))
        times.append(t)
        codes.append((anchor[t] << 16) | (other[t] << 4) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray, str]:
    """Times and codes of the fingerprint, and a short string of it all: frames, peaks, pairs and a digest."""
    bins, power = peaks(np.frombuffer(samples, np.uint8))
    t, c = pairs(bins, power)
    digest = hashlib.md5(bins.astype("<i8").tobytes() + t.astype("<i8").tobytes() + c.astype("<i8").tobytes()).hexdigest()
    return t, c, f"stft{FRAME}/{HOP} frames={len(bins)} peaks={int((bins > 0).sum())} pairs={len(t)} md5={digest}"


FINGERPRINT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_times array<int>, peak_codes array<int>"


def wav_fingerprints(df: DataFrame, text: str = "text", keep_media: bool = False) -> DataFrame:
    """df with the WAV form of each whole text (UTF-8), read back, and its fingerprint.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, peak_times and
    peak_codes, and with keep_media the WAV file itself as media. A null or empty text is 64 bytes 0. Equal texts
    get equal values. Rows are kept as they are, repeated ones too; columns of these names are replaced.
    Long texts are transformed in blocks of frames.
    """

    def make():
        def columns(texts):
            rows = []
            for data in texts.cast(pa.binary()).to_pylist():
                media = to_wav(padded(data))
                payload = from_wav(media)
                t, c, feature = features(payload)
                row = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, t.astype(np.int32), c.astype(np.int32))
                rows.append((*row, media) if keep_media else row)
            return list(map(list, zip(*rows)))

        return columns

    return with_columns(df, text, FINGERPRINT + ", media binary" * keep_media, make)
