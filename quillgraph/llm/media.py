"""Texts as audio: WAV files, short-time Fourier transforms and spectral-peak fingerprints.

A payload (the text as UTF-8, filled up with spaces to a positive multiple of 192 bytes) is written by the wave module as
8-bit mono samples and read back from the file. Frames of 192 samples, 96 apart, go through a Hann window and a real
Fourier transform. The strongest bin of a frame is a peak if no frame within NEAR of it is stronger (the earlier of equal
ones counts). Each peak is paired with the next FAN peaks within SPAN frames; a pair is a code of both bins and their
distance, stored with the time of the first: two arrays of equal length, times and codes.

Defined results: a null text counts as empty (one frame of spaces); equal texts have equal values; frames are worked off
in blocks, so memory does not grow with a text beyond the text itself; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import slices

STEP, FRAME, HOP, RATE = 192, 192, 96, 8000
NEAR, FAN, SPAN, BLOCK = 4, 3, 64, 8192
_HANN = np.hanning(FRAME).astype(np.float32)

FIELDS = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, n_frames bigint, times array<int>, codes array<int>"
)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (max(STEP, -(-len(raw) // STEP) * STEP) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return f.readframes(f.getnframes())


def strongest(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin (1 to 96) and power of every frame's strongest bin, powers rounded so that equal frames are equal anywhere."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, power = np.empty(len(frames), np.int32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), BLOCK):
        part = (frames[at : at + BLOCK].astype(np.float32) - 128) * _HANN
        spectrum = np.fft.rfft(part, axis=1)[:, 1:]
        energy = np.round(np.log2(spectrum.real**2 + spectrum.imag**2 + 1), 3)
        bins[at : at + BLOCK] = energy.argmax(axis=1)
        power[at : at + BLOCK] = np.take_along_axis(energy, bins[at : at + BLOCK, None], axis=1)[:, 0]
    return bins + 1, power


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Times and codes of peak pairs, number of frames."""
    bins, power = strongest(samples)
    n = len(bins)
    peak = np.ones(n, bool)
    for shift in range(1, min(NEAR, n - 1) + 1):
        peak[shift:] &= power[shift:] > power[:-shift]
        peak[:-shift] &= power[:-shift] >= power[shift:]
    at = np.flatnonzero(peak)
    times, codes = [], []
    for ahead in range(1, FAN + 1):
        first, second = at[:-ahead], at[ahead:]
        close = second - first <= SPAN
        first, second = first[close], second[close]
        times.append(first)
        codes.append((bins[first] << 14) | (bins[second] << 7) | (second - first))
    times, codes = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((codes, times))
    return times[order], codes[order], n


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    for batch in slices(batches):
        out: list[list] = [[] for _ in names[1:]]
        for text in batch.column(1).to_pylist():
            n_bytes = len((text or "").encode())
            stored = to_wav(payload_of(text))
            payload = from_wav(stored)
            times, codes, frames = fingerprint(np.frombuffer(payload, np.uint8))
            feature = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
            row = (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{frames}:{len(codes)}:{feature}", frames, times, codes)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=names)


def media_features(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rows, FIELDS)


def media_files(documents: DataFrame) -> DataFrame:
    """doc_id, media binary: the WAV files themselves, as a column to be written where the caller wants them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_wav(payload_of(t)) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id bigint, media binary")
