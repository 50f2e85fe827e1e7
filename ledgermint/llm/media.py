"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload is stored as a mono WAV of unsigned 8-bit samples and read back by the wave module. The
short-time Fourier transform of its samples (Hann windows that overlap by half, so that every sample
has the same weight in all; the ends are mirrored; the shortest payload has several frames) gives a
spectrogram. Its peaks are local maxima over a neighbourhood of frames and bins: a frame's largest
value in each cell of `BINS` bins that exceeds the largest ones of the cells beside it, in its frame
and the frames before and after, and the mean of its frame. Every peak is paired with the next ones
of later frames, and each pair is (time, frequency, later frequency, time between), a time-coded array.

A payload of one block that is nearly all padding may have all its peaks in one frame, and no pair then.
Null and empty texts are stored as one padded block. Features depend on the payload alone, so equal
texts have equal values. Rows stand alone: nothing is shuffled, an empty table gives an empty result.
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

from .common import small_batches, table

#: The payload is padded with spaces to a multiple of this many bytes.
BLOCK = 192
RATE = 8000
FRAME, HOP = 128, 64
#: Bins of a cell, and how often a peak exceeds its frame's mean.
BINS, RISE = 8, 1.5
#: A peak is paired with this many of the peaks of later frames.
FAN = 2
#: Frames that are transformed at once; bounds memory.
FRAMES_AT_ONCE = 4096
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """`payload` as a mono WAV file of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """(time, bin) of the spectral peaks, in order; frame t has its middle at sample t * HOP."""
    n = -(-len(samples) // HOP) + 1
    padded = _mirrored(samples.astype(np.float32), FRAME // 2, (n - 1) * HOP + FRAME)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    found = []
    for a in range(0, n, FRAMES_AT_ONCE):
        first, end = max(0, a - 1), min(n, a + FRAMES_AT_ONCE)
        part = frames[first : end + 1]  # with the frames beside
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _WINDOW)).astype(np.float32)[:, : FRAME // 2]
        cells = power.reshape(len(power), -1, BINS)
        top = cells.argmax(axis=2)
        high = np.take_along_axis(cells, top[:, :, None], 2)[:, :, 0]
        bins = top + np.arange(cells.shape[1]) * BINS
        # the largest of its cell, larger than the tops of the cells around it, and well above its frame
        around = np.pad(high, 1)
        near = lambda t, c: around[1 + t : 1 + t + len(high), 1 + c : 1 + c + high.shape[1]]
        peak = high > RISE * power.mean(axis=1, keepdims=True)
        for c in (-1, 0, 1):
            peak &= (high > near(-1, c)) & (high >= near(1, c))
        peak &= (high > near(0, -1)) & (high >= near(0, 1))
        t, c = np.nonzero(peak[a - first : end - first])
        found.append(np.stack([t + a, bins[a - first :][t, c]], axis=1))
    return np.concatenate(found)


def _mirrored(samples: np.ndarray, before: int, length: int) -> np.ndarray:
    """`samples` from `before` on in a row of `length`, mirrored at both ends."""
    if len(samples) < 2:
        return np.full(length, samples[0] if len(samples) else 32, np.float32)
    return np.pad(samples, (before, length - before - len(samples)), "reflect")


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Rows of (time, frequency bin, later bin, frames between), one frame at least, for pairs of following peaks, ordered by time."""
    p = peaks(samples)
    later = np.searchsorted(p[:, 0], p[:, 0], "right")
    pairs = []
    for k in range(FAN):
        own = np.flatnonzero(later + k < len(p))
        to = later[own] + k
        pairs.append(np.stack([p[own, 0], p[own, 1], p[to, 1], p[to, 0] - p[own, 0]], axis=1))
    pairs = np.concatenate(pairs)
    return pairs[np.lexsort((pairs[:, 3], pairs[:, 2], pairs[:, 1], pairs[:, 0]))]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprint[, media]) of each row.

    `fingerprint` is array<struct<time, low, high, gap>> in frames and bins; `media` is the WAV file.
    """
    pair = pa.struct([(c, pa.int32()) for c in ("time", "low", "high", "gap")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text"):
                rows, prints, files = [], [], []
                for cell in batch.column(1):
                    raw = (cell.as_py() or "").encode()
                    media = write_wav(raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)))
                    back = read_wav(media)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest()))
                    prints.append(fingerprint(np.frombuffer(back, np.uint8)))
                    files.append(media if keep_media else b"")
                sizes = np.cumsum([0, *map(len, prints)]).astype(np.int32)
                flat = np.concatenate([*prints, np.empty((0, 4), np.int64)]).astype(np.int32)
                marks = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], fields=list(pair)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                cols = [batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], marks]
                names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"]
                if keep_media:
                    cols.append(pa.array(files, pa.binary()))
                    names.append("media")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<struct<time:int,low:int,high:int,gap:int>>"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema + ", media binary" * keep_media)


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` stored as WAV and read back; `feature` lists time:low:high:gap of each pair."""
    media = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    feature = F.array_join(F.transform("fingerprint", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("time", "low", "high", "gap")])), ",")
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
