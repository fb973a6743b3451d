"""Media columns: texts stored as WAV, read back with the wave module, and fingerprinted.

A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, are the unsigned 8-bit samples of
a mono WAV file held in a binary column. Features come from the stored bytes alone: a short-time Fourier
transform (Hann frames of 192 samples, a hop of 96), the strongest bin of each frame, and pairs of
such peaks up to three frames apart. A pair is coded as bin1 << 9 | bin2 << 2 | distance; pairs are kept as two
arrays, the frame number and the code.

Defined cases: a null text is an empty one, one block of blanks; equal texts have equal values, since
each text is transformed by itself; rows repeat if they do in the input; an empty table gives an empty
result; other columns are ignored. A long text is transformed in pieces of ``PIECE`` frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import table

RATE, FRAME, HOP, REACH, PIECE, UNIT = 8000, 192, 96, 3, 4096, 192
STORED = "doc_id long, n_bytes long, wav binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<int>, codes array<int>"


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


WINDOW = np.hanning(FRAME).astype(np.float64)


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin above 0 of each frame, 0 for a silent frame."""
    found = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for k in range(0, len(frames), PIECE):
        x = frames[k : k + PIECE].astype(np.float64) - 128.0
        power = np.abs(np.fft.rfft(x * WINDOW, axis=1))[:, 1:]
        best = power.argmax(axis=1)
        found.append(np.where(power[np.arange(len(best)), best] > 1e-9, best + 1, 0))
    return np.concatenate(found)


def pairs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and codes of the peak pairs, by frame, then distance."""
    n = len(bins)
    at = [np.arange(max(n - d, 0)) for d in range(1, REACH + 1)]
    code = [(bins[: max(n - d, 0)] << 9) | (bins[d:] << 2) | d for d in range(1, REACH + 1)]
    frame, value = np.concatenate(at), np.concatenate(code)
    order = np.argsort(frame, kind="stable")
    return frame[order].astype(np.int32), value[order].astype(np.int32)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            ids, texts = batch.column("doc_id").slice(k, 512), batch.column("text").slice(k, 512)
            sizes, files = [], []
            for t in texts:
                raw = (t.as_py() or "").encode("utf-8")
                sizes.append(len(raw))
                files.append(to_wav(raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "wav"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for i, n, stored in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("wav").to_pylist(), strict=True):
            payload = from_wav(stored)
            frame, code = pairs(peaks(np.frombuffer(payload, np.uint8)))
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), frame, code))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)


def store_wav(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` → ``doc_id, n_bytes, wav``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, STORED)


def fingerprints(stored: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, wav`` → sizes and digests of what is stored, and the time-coded peak pairs."""
    return stored.select("doc_id", "n_bytes", "wav").mapInArrow(_features, FEATURES)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(store_wav(table(spark, sf_dir, "documents")))
    coded = F.arrays_zip("frames", "codes")
    feature = F.concat_ws(":", F.size("codes").cast("string"), F.sha2(F.to_json(coded), 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.size("codes").alias("n_pairs"), F.size(F.array_distinct("codes")).alias("n_codes"))
