import cmath
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from helpers import table

from tidelog.llm import audio


def test_payload_round_trip(docs, empty):
    rows = docs.collect()
    found = audio.audio_columns(docs).collect()
    assert len(found) == len(rows)
    source = {}
    for r in rows:
        source.setdefault(r.doc_id, r.text)
    for r in found:
        raw = (source[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert audio.samples_of(r.media).tobytes() == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert all(0 <= s.start_us < s.end_us <= len(payload) * 1_000_000 // audio.RATE for s in r.spans)
        import pyarrow as pa

        assert pa.ipc.open_stream(r.log_mel).read_all().column("log_mel").combine_chunks().to_numpy_ndarray().shape == (len(payload) // 192, audio.MELS)
    assert audio.audio_columns(empty).count() == 0


def test_equal_texts_equal_values(spark, rows):
    found = audio.audio_columns(table(spark, rows, ["media", "feature"])).select("doc_id", "media", "feature").collect()
    by = {r.doc_id: r for r in found}
    assert by[3].media == by[40].media == by[41].media and by[3].feature == by[41].feature


def test_blocks_do_not_show(monkeypatch):
    x = np.random.default_rng(0).normal(size=192 * 50).astype(np.float32)
    whole = audio.log_mel(audio.resample(x))
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    assert np.allclose(whole, audio.log_mel(audio.resample(x)), atol=1e-4)


def test_tone_and_segments():
    t = np.arange(16_000 * 2 // 192 * 192) / 16_000
    x = (np.sin(2 * np.pi * 1000 * t) * ((t > 0.5) & (t < 0.9))).astype(np.float32)
    y = audio.resample(x)
    assert len(y) == len(x) * 2 // 3
    spectrum = np.abs(np.fft.rfft(y))
    assert abs(np.argmax(spectrum) * (16_000 * 2 / 3) / len(y) - 1000) < 5
    spans = audio.segments(audio.log_mel(y)) * 192 / 16_000
    assert len(spans) == 1 and abs(spans[0][0] - 0.5) < 0.03 and abs(spans[0][1] - 0.9) < 0.03


def brute_feature(payload):
    """The feature of a payload, sample by sample: windowed-sinc resampling, a plain Fourier sum, triangles on the mel scale, hysteresis."""
    x = [(b - 128) / 128 for b in payload]
    cutoff = 0.9 * audio.UP / audio.DOWN
    middle = audio.TAPS // 2 - 1
    y = []
    for first in range(0, len(x), audio.DOWN):
        for phase in range(audio.UP):
            at = phase * audio.DOWN / audio.UP  # of the output, from the first of the inputs it falls in
            taps = []
            for k in range(audio.TAPS):
                d = k - middle - at
                sinc = 1.0 if d == 0 else math.sin(math.pi * cutoff * d) / (math.pi * cutoff * d)
                taps.append(cutoff * sinc * math.cos(math.pi * d / (audio.TAPS + 2)) ** 2)
            inputs = [x[first + k - middle] if 0 <= first + k - middle < len(x) else 0.0 for k in range(audio.TAPS)]
            y.append(sum(t * v for t, v in zip(taps, inputs, strict=True)) / sum(taps))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    rate = audio.RATE * audio.UP / audio.DOWN
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    frames = []
    for first in range(0, len(y), audio.HOP):
        frame = [(y[first + i] if first + i < len(y) else 0.0) * (0.5 - 0.5 * math.cos(2 * math.pi * i / audio.WINDOW)) for i in range(audio.WINDOW)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / audio.WINDOW) for i, v in enumerate(frame))) ** 2 for k in range(audio.WINDOW // 2 + 1)]
        row = []
        for m in range(audio.MELS):
            total = 0.0
            for k, e in enumerate(power):
                f = k * rate / audio.WINDOW
                total += e * max(0.0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1])))
            row.append(10 * math.log10(total + 1e-6))
        frames.append(row)
    energy = [sum(r) / len(r) for r in frames]
    median = float(np.median(energy))
    sound, spans = False, []
    for i, e in enumerate(energy):
        if not sound and e >= median + audio.ON_DB:
            sound = True
            spans.append([i, len(energy)])
        elif sound and e < median + audio.OFF_DB:
            sound = False
            spans[-1][1] = i
    return len(frames), spans, [sum(r[m] for r in frames) / len(frames) for m in range(audio.MELS)]


def test_feature_matches_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "short", "a quiet line " * 40 + "LOUD \u00ff\u00fe~~~ " * 12 + "and quiet again " * 30, "".join(chr(rng.randint(32, 0x2FF)) for _ in range(700))]
    found = {r.doc_id: r for r in audio.audio_columns(table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    some = 0
    for i, t in enumerate(texts):
        raw = t.encode()
        frames, spans, means = brute_feature(raw + b" " * (-len(raw) % 192 if raw else 192))
        n, count, covered, shown = found[i].feature.split(" ")
        step = audio.FRAME * 1_000_000 // audio.RATE
        assert (int(n), int(count), int(covered)) == (frames, len(spans), sum(b - a for a, b in spans))
        assert [(s.start_us, s.end_us) for s in found[i].spans] == [(a * step, b * step) for a, b in spans]
        assert [float(v) for v in shown.split(",")] == pytest.approx(means, abs=0.06)  # one decimal
        some += len(spans)
    assert some
