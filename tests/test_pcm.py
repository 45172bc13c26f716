"""Audio in pieces: the same frames and descriptors however a track is cut."""

import numpy as np

from crate.operators import pcm, signal


def plain(x, sr, frame, hop, bands):
    """The descriptor of whole samples, frame by frame."""
    if not len(x):
        return np.zeros(2 * bands + 10)
    x = np.pad(x, (0, max(0, frame - len(x))))
    freqs, rows = np.fft.rfftfreq(frame, 1 / sr), []
    top = 2595 * np.log10(1 + sr / 2 / 700)
    edge = [min(frame // 2, int((frame + 1) * 700 * (10 ** (top * k / (bands + 1) / 2595) - 1) / sr)) for k in range(bands + 2)]
    for a in range(0, len(x) - frame + 1, hop):
        part = x[a : a + frame]
        mag = np.abs(np.fft.rfft(part * np.hanning(frame)))
        mels = [sum(mag[i] * (i - lo) / (mid - lo) for i in range(lo, mid)) + sum(mag[i] * (hi - i) / (hi - mid) for i in range(mid, hi)) for lo, mid, hi in zip(edge, edge[1:], edge[2:], strict=False)]
        p = mag + 1e-10
        c = (p * freqs).sum() / p.sum()
        roll = next(f for f, s in zip(freqs, np.cumsum(p), strict=True) if s >= 0.85 * p.sum())
        rows.append([*np.log1p(mels), c, np.sqrt((p * (freqs - c) ** 2).sum() / p.sum()), roll, np.mean(np.sign(part[1:]) != np.sign(part[:-1])), np.sqrt(np.mean(part**2))])
    m, s = np.mean(rows, 0), np.std(rows, 0)
    v = np.concatenate([m[:bands], s[:bands], np.column_stack([m, s])[bands:].ravel()])
    return v / np.linalg.norm(v)


def cut(rng, track, x, n):
    at = [0, *sorted(rng.choice(np.arange(1, len(x)), n - 1, replace=False).tolist()), len(x)] if n > 1 else [0, len(x)]
    return [(track, a, [float(v) for v in x[a:b]]) for a, b in zip(at, at[1:], strict=False)]


def test_pieces(spark):
    rng = np.random.default_rng(3)
    sr, frame, hop, bands = 8000, 256, 64, 40
    long = np.sin(np.arange(9000) * 0.2) * np.linspace(0, 1, 9000) + rng.normal(0, 0.05, 9000)
    sounds = {1: (long, 1), 2: (long, 20), 3: (long[:100], 3), 4: (long[:256], 1), 5: (long[:1023], 300), 6: (np.array([]), 1), 7: (np.zeros(3000), 2)}
    rows = [r for k, (x, n) in sounds.items() for r in cut(rng, k, x, n)]
    rows += [(None, 0, [1.0]), (2, None, [1.0]), (2, -5, [1.0] * 9), (2, 400, []), (2, 500, None)]
    pieces = spark.createDataFrame(rows, "track_id long, offset long, samples array<double>").repartition(5)
    for page in (64, 1000, 1 << 18):
        got = {r.track_id: np.array(r.vector) for r in pcm.descriptor(pieces, sr, frame, hop, bands, page).collect()}
        assert sorted(got) == sorted(sounds) and all(len(v) == 2 * bands + 10 for v in got.values())
        for k, (x, _) in sounds.items():
            assert np.allclose(got[k], plain(x, sr, frame, hop, bands), atol=1e-9), (k, page)
        assert np.allclose(got[1], got[2], atol=1e-12)
    whole = spark.createDataFrame([(k, x.tolist()) for k, (x, _) in sounds.items()], "track_id long, samples array<double>")
    want = {(r.track_id, r.frame_idx): r.mag for r in signal.stft(whole, frame, hop).collect()}
    have = {(r.track_id, r.frame_idx): r.mag for r in pcm.stft(pieces, frame, hop, 700).collect()}
    assert want.keys() == have.keys() and all(np.allclose(want[k], have[k], atol=1e-12) for k in want)
    assert pcm.descriptor(pieces.limit(0)).count() == 0


def test_gaps_and_overlaps(spark):
    rows = [(1, 0, [1.0] * 10), (1, 20, [2.0] * 12), (1, 8, [3.0] * 4), (1, 8, [3.0] * 4), (1, 8, [5.0, None])]
    pieces = spark.createDataFrame(rows, "track_id long, offset long, samples array<double>")
    x = [1.0] * 8 + [3.0] * 4 + [0.0] * 8 + [2.0] * 12
    whole = signal.stft(spark.createDataFrame([(1, x)], "track_id long, samples array<double>"), 16, 8)
    for page in (8, 24, 1000):
        assert np.allclose([r.mag for r in pcm.stft(pieces, 16, 8, page).orderBy("frame_idx").collect()], [r.mag for r in whole.orderBy("frame_idx").collect()])
