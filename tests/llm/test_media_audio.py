import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from tagloom.llm import media_audio as m


def brute_log_mel(payload):
    """Frame by frame, with a resampler that fills in zeros and a plain Fourier sum."""
    x = np.frombuffer(payload, np.uint8) / 128 - 1
    branches, window, bank = m._filters()
    up = np.zeros(len(x) * m.UP + m.UP * m.TAPS)
    up[: len(x) * m.UP : m.UP] = x
    h = branches[:, ::-1].T.ravel()
    y = np.array([sum(h[j] * up[k * m.DOWN - j] for j in range(len(h)) if k * m.DOWN >= j) for k in range(len(x) * m.UP // m.DOWN)])
    n = max(1, -(-(len(y) - m.FRAME + m.HOP) // m.HOP))
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * m.HOP + m.FRAME - len(y)))])
    f = np.exp(-2j * np.pi * np.outer(np.arange(m.FRAME // 2 + 1), np.arange(m.FRAME)) / m.FRAME)
    power = [np.abs(f @ (y[i * m.HOP : i * m.HOP + m.FRAME] * window)) ** 2 for i in range(n)]
    return np.log(np.maximum(np.array(power) @ bank, m.FLOOR))


def test_store_round_trip_and_checksums(spark):
    texts = {1: None, 2: "", 3: "é" * 96, 4: "a" * 193, 5: "a" * 193, 6: "long text " * 30000}
    df = spark.createDataFrame([(k, v, b"x") for k, v in texts.items()], "doc_id long, text string, media binary")
    clips = m.materialize(m.store(df), "t")
    for r in clips.collect():
        raw = (texts[r.doc_id] or "").encode()
        w = wave.open(io.BytesIO(bytes(r.media)))
        assert w.readframes(w.getnframes()) == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and w.getsampwidth() == 1
    stored = m.materialize(m.features(clips), "f")
    got = {r.doc_id: r for r in m.read_features(stored).collect()}
    for k, text in texts.items():
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        wav = m.wav_header(len(payload)) + payload
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert len(r.log_mel) == r.n_windows * m.WINDOW * m.MELS * 2 and len(r.window_spans) == r.n_windows
    assert got[4].log_mel == got[5].log_mel and got[1].log_mel == got[2].log_mel
    tables = [m.unpack(bytes(r.windows)) for r in stored.collect()]
    assert all(t.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float16(), (m.WINDOW, m.MELS)) for t in tables)
    assert sum(len(t) for t in tables) == sum(r.n_windows for r in got.values())
    for k, text in texts.items():
        r, raw = got[k], (text or "").encode()
        if len(raw) < 1000:
            want = brute_log_mel(raw.ljust(max(192, -(-len(raw) // 192) * 192)))
            mel = np.frombuffer(r.log_mel, "<f2").reshape(-1, m.MELS)
            assert np.allclose(mel[: len(want)], want, atol=0.02) and np.allclose(mel[len(want) :], np.log(m.FLOOR), atol=0.02)
            assert r.window_spans[-1].stop_ms == len(want) * m.HOP_MS and r.window_spans[0].start_ms == 0
            assert [(s.start_ms, s.stop_ms) for s in r.segment_spans] == [(a * m.HOP_MS, b * m.HOP_MS) for a, b in m.segments(want)]
    assert m.store(df.limit(0)).count() == 0


def test_resampling_keeps_a_tone_and_blocks_join():
    t = np.arange(m.BLOCK * 2 + 999) / m.RATE
    clip = np.round(128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8)
    y = m.resample(clip[:6000].astype(np.float32) / 128 - 1)
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(np.argmax(spectrum) * (m.RATE * m.UP / m.DOWN) / len(y) - 1000) < 5
    x = clip.astype(np.float32) / 128 - 1
    h = m._filters()[0]
    brute = [sum(h[k * m.DOWN % m.UP][j] * (x[k * m.DOWN // m.UP - m.TAPS + 1 + j] if k * m.DOWN // m.UP - m.TAPS + 1 + j >= 0 else 0) for j in range(m.TAPS)) for k in range(40)]
    assert np.allclose(y[:40], brute, atol=1e-5)
    whole = m.resample(x)
    mel = m.log_mel(clip)
    k = m.BLOCK * m.UP // m.DOWN // m.HOP  # frames over the first join
    _, window, bank = m._filters()
    for i in range(k - 3, k + 3):
        p = np.abs(np.fft.rfft(whole[i * m.HOP : i * m.HOP + m.FRAME] * window)) ** 2
        assert np.allclose(mel[i], np.log(np.maximum(p.astype(np.float32) @ bank, m.FLOOR)), atol=1e-2)


def test_hysteresis():
    e = np.zeros((12, m.MELS)) + np.array([0, 0, 0, 1, 0.1, 0, 1, -1, 0, 0, 0.1, 1])[:, None]
    assert m.segments(e) == [(3, 7), (11, 12)]
