"""Media columns: texts as 8-bit audio, stored as fixed-shape Arrow tensors with time spans, and features read from what is stored.

The bytes of a text, padded with spaces to frames of 192, are samples at 16 kHz.
A media value is an Arrow stream with one row for each frame: a fixed-shape
tensor of 192 unsigned 8-bit samples, and the frame's start and end in
microseconds. Features are computed from the samples that are read back from
those bytes:

* polyphase resampling by 2/3 with a windowed-sinc low-pass,
* log-mel energies of Hann frames of 256 samples that overlap by half,
* segments of sound by hysteresis: a segment begins at a frame whose energy is
  1 dB above the median and ends before the first frame that is not half a dB
  above it.

A text is handled by itself, in blocks, so equal texts give equal values in any
company and memory is a few times one text's size.

Defined cases: a null or empty text is one frame of spaces; rows with equal
doc_id are all returned; an empty table gives no rows. Columns other than
doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

#: Fixed values of the contract.
FRAME = 192
PAD = b" "

RATE = 16_000
UP, DOWN = 2, 3
TAPS = 14
WINDOW, HOP = 256, 128
MELS = 20
ON_DB, OFF_DB = 1.0, 0.5
BLOCK_FRAMES = 4096


def stored(payload: bytes) -> bytes:
    """The payload, whole frames, as an Arrow stream of fixed-shape tensors with time spans."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    step = FRAME * 1_000_000 // RATE
    start = np.arange(len(samples), dtype=np.int64) * step
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(samples), pa.array(start), pa.array(start + step)], ["samples", "start_us", "end_us"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def samples_of(media: bytes) -> np.ndarray:
    """The samples of a media value."""
    parts = [b.column("samples").to_numpy_ndarray().ravel() for b in pa.ipc.open_stream(media)]
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _low_pass() -> np.ndarray:
    """TAPS x UP matrix: from TAPS inputs in a row to the UP outputs that fall in the DOWN inputs at their middle."""
    t = np.arange(TAPS)[:, None] - (TAPS // 2 - 1) - np.arange(UP)[None, :] * DOWN / UP
    cutoff = 0.9 * UP / DOWN
    taps = cutoff * np.sinc(cutoff * t) * np.cos(np.pi * t / (TAPS + 2)) ** 2
    return (taps / taps.sum(axis=0)).astype(np.float32)


def _mel_bank() -> np.ndarray:
    """(WINDOW / 2 + 1) x MELS triangles, even on the mel scale."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, WINDOW // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_TAPS, _BANK, _HANN = _low_pass(), _mel_bank(), np.hanning(WINDOW + 1)[:WINDOW].astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x, a multiple of DOWN long, at UP / DOWN of its rate."""
    before = TAPS // 2 - 1
    padded = np.concatenate([np.zeros(before, np.float32), x, np.zeros(TAPS, np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[: len(x) : DOWN]
    step = BLOCK_FRAMES * FRAME // DOWN
    return np.concatenate([(seen[a : a + step] @ _TAPS).ravel() for a in range(0, len(seen), step)])


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x MELS, in dB; a frame for each HOP samples begun."""
    padded = np.concatenate([y, np.zeros(WINDOW - HOP, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    parts = []
    for a in range(0, len(frames), BLOCK_FRAMES):
        spectrum = np.fft.rfft(frames[a : a + BLOCK_FRAMES] * _HANN, axis=1)
        parts.append(10 * np.log10((spectrum.real**2 + spectrum.imag**2) @ _BANK + np.float32(1e-6)))
    return np.concatenate(parts)


def segments(mel: np.ndarray) -> np.ndarray:
    """First and end frame of each segment of sound."""
    energy = mel.mean(axis=1)
    middle = np.median(energy)
    event = np.where(energy >= middle + ON_DB, 1, np.where(energy < middle + OFF_DB, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    sound = (last >= 0) & (event[last] > 0)
    return np.flatnonzero(np.diff(sound.view(np.int8), prepend=0, append=0)).reshape(-1, 2)


def audio_columns(docs: DataFrame, with_mel: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media, payload_sha256, tail_crc32, feature, spans and log_mel (an Arrow stream of fixed-shape tensors) of every row.

    payload_bytes, payload_sha256 and tail_crc32 are of the samples read back from media.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = FRAME * 1_000_000 // RATE
        for batch in slices(batches, "text", 1 << 20):
            columns: list[list] = [[] for _ in range(8)]
            for raw in text_bytes(batch.column("text")):
                media = stored(raw + PAD * (-len(raw) % FRAME if raw else FRAME))
                samples = samples_of(media)
                back = samples.tobytes()
                mel = log_mel(resample((samples.astype(np.float32) - 128) / 128))
                spans = segments(mel)
                feature = f"{len(mel)} {len(spans)} {int((spans[:, 1] - spans[:, 0]).sum())} " + ",".join(f"{x:.1f}" for x in mel.mean(axis=0, dtype=np.float64).tolist())
                tensor = None
                if with_mel:
                    sink = pa.BufferOutputStream()
                    whole = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(mel)], ["log_mel"])
                    with pa.ipc.new_stream(sink, whole.schema) as out:
                        out.write_batch(whole)
                    tensor = sink.getvalue().to_pybytes()
                row = (len(raw), len(back), media, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), feature, [{"start_us": a, "end_us": b} for a, b in (spans * step).tolist()], tensor)
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start_us", pa.int64()), ("end_us", pa.int64())])), pa.binary()]
            names = ["n_bytes", "payload_bytes", "media", "payload_sha256", "tail_crc32", "feature", "spans", "log_mel"]
            n = len(names) - (not with_mel)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns[:n], kinds[:n], strict=True))], ["doc_id", *names[:n]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_bytes long, payload_bytes long, media binary, payload_sha256 string, tail_crc32 long, feature string, spans array<struct<start_us:long,end_us:long>>"
    return docs.select("doc_id", "text").mapInArrow(measure, ddl + ", log_mel binary" * with_mel)


def op3_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_columns(table(spark, sf_dir, "documents"), with_mel=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
