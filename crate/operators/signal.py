"""Features of audio frames: rows (track_id, frame_idx, mag array<double>), one magnitude a frequency bin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of pitch classes, and the key profiles of Krumhansl and Kessler, from the tonic up.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def stft(pcm: DataFrame, frame: int = 2048, hop: int = 512) -> DataFrame:
    """Frames of rows (track_id, samples): Hann-windowed magnitudes; a short track is padded to one frame."""
    window = np.hanning(frame)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for track, samples in zip(batch["track_id"], batch["samples"], strict=True):
                x = np.asarray(samples if samples is not None else [], float)
                x = np.pad(x, (0, max(0, frame - len(x))))
                at = range(0, len(x) - frame + 1, hop)
                yield pd.DataFrame({"track_id": track, "frame_idx": np.arange(len(at)), "mag": [np.abs(np.fft.rfft(x[a : a + frame] * window)) for a in at]})

    return pcm.select("track_id", "samples").mapInPandas(run, "track_id long, frame_idx long, mag array<double>")


def loudness(samples: Column) -> Column:
    """tanh of three times the root mean square, 0 for an empty track."""
    squares = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(samples) > 0, F.tanh(3 * F.sqrt(squares / F.size(samples)))).otherwise(0.0)


def onsets(frames: DataFrame) -> DataFrame:
    """track_id, frame_idx, env: summed rises of log magnitude since the frame before, less the track's mean."""
    w = Window.partitionBy("track_id").orderBy("frame_idx")
    logs = frames.select("track_id", "frame_idx", F.transform("mag", F.log1p).alias("m")).withColumn("p", F.lag("m").over(w))
    rise = F.aggregate(F.zip_with("m", "p", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    flux = logs.select("track_id", "frame_idx", F.coalesce(rise, F.lit(0.0)).alias("flux"))
    return flux.withColumn("env", F.col("flux") - F.avg("flux").over(Window.partitionBy("track_id"))).drop("flux")


def lag_products(env: DataFrame, lags: list[int]) -> DataFrame:
    """track_id, lag, ac: autocorrelation of an onset curve at the lags given, over that at lag 0."""
    shifted = env.select("track_id", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), (F.col("frame_idx") - F.col("lag")).alias("frame_idx"), F.col("env").alias("later"))
    products = shifted.join(env, ["track_id", "frame_idx"]).groupBy("track_id", "lag").agg(F.sum(F.col("env") * F.col("later")).alias("p"))
    power = env.groupBy("track_id").agg(F.sum(F.col("env") * F.col("env")).alias("p0"))
    return products.join(power, "track_id").select("track_id", "lag", F.when(F.col("p0") > 0, F.col("p") / F.col("p0")).otherwise(0.0).alias("ac"))


def tempo(env: DataFrame, frames_per_sec: float, low: float = 40.0, high: float = 240.0, fold: float = 90.0) -> DataFrame:
    """track_id, bpm, strength, regularity: the strongest lag between two tempi, folded to [fold, 2 fold); 0 where there is none."""
    first, last = max(1, int(frames_per_sec * 60 / high)), int(-(-frames_per_sec * 60 // low))
    ac = lag_products(env, list(range(first, 2 * last + 1)))
    band = ac.filter(F.col("lag") <= last)
    peak = band.groupBy("track_id").agg(F.max(F.struct("ac", (-F.col("lag")).alias("o"))).alias("s")).select("track_id", F.col("s.ac").alias("top"), (-F.col("s.o")).alias("lag"))
    twice = ac.select("track_id", F.col("lag").alias("lag2"), F.col("ac").alias("ac2"))
    found = peak.withColumn("lag2", F.col("lag") * 2).join(twice, ["track_id", "lag2"], "left")
    raw = 60 * frames_per_sec / F.col("lag")
    folded = raw / F.pow(F.lit(2.0), F.floor(F.log2(raw / fold)))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    some = F.col("top") > 0
    return found.select("track_id", F.when(some, folded).otherwise(0.0).alias("bpm"), F.when(some, unit(F.col("top"))).otherwise(0.0).alias("strength"), F.when(some, unit(F.coalesce("ac2", F.lit(0.0)))).otherwise(0.0).alias("regularity"))


def chroma(frames: DataFrame, bin_pitch: list[int | None]) -> DataFrame:
    """track_id, chroma (12 sums of mean magnitudes): bin_pitch has the pitch class of each bin, None for the first bin."""
    pitch = F.array(*[F.lit(p).cast("int") for p in bin_pitch])
    rows = frames.select("track_id", F.posexplode("mag").alias("i", "x")).withColumn("pc", F.get(pitch, F.col("i"))).filter("pc is not null")
    means = rows.groupBy("track_id", "i", "pc").agg(F.avg("x").alias("x")).groupBy("track_id", "pc").agg(F.sum("x").alias("x"))
    full = means.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("pc", "x"))).alias("m"))
    return full.select("track_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("chroma"))


def bin_pitches(frame: int, sr: int) -> list[int | None]:
    """Pitch class of each bin of a real transform, from A = 440 Hz; the bin at 0 Hz has none."""
    import math

    return [None, *[round(69 + 12 * math.log2(k * sr / frame / 440)) % 12 for k in range(1, frame // 2 + 1)]]


def key_estimate(chromas: DataFrame) -> DataFrame:
    """track_id, music_key, score: the rotated profile that correlates best; null where none does. Ties: lower tonic, major first."""
    rows = [(t, m, [p[(i - t) % 12] for i in range(12)]) for t in range(12) for m, p in ((0, MAJOR_PROFILE), (1, MINOR_PROFILE))]
    literal = F.array(*[F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("minor"), F.array(*[F.lit(float(x)) for x in p]).alias("p")) for t, m, p in rows])
    uneven = chromas.filter(F.array_max("chroma") > F.array_min("chroma"))  # silence has no key
    pairs = uneven.select("track_id", "chroma", F.explode(literal).alias("k")).select("track_id", "k.tonic", "k.minor", F.explode(F.arrays_zip(F.col("chroma").alias("c"), F.col("k.p").alias("p"))).alias("z"))
    score = pairs.groupBy("track_id", "tonic", "minor").agg(F.corr("z.c", "z.p").alias("score")).withColumn("score", F.round(F.when(F.isnan("score"), None).otherwise(F.col("score")), 9))
    n = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc_nulls_last("score"), "tonic", "minor"))
    best = score.withColumn("n", n).filter("n = 1")
    name = F.concat(F.get(F.array(*[F.lit(p) for p in PITCHES]), F.col("tonic")), F.when(F.col("minor") == 1, " min").otherwise(" maj"))
    found = best.select("track_id", F.when(F.col("score") > 0, name).alias("music_key"), "score")
    return chromas.select("track_id").join(found, "track_id", "left")


def danceability(strength: Column, regularity: Column, energy: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * strength + 0.35 * regularity + 0.15 * energy))


def analysis(frames: DataFrame, energy: DataFrame, frame: int, hop: int, sr: int) -> DataFrame:
    """track_id, bpm, music_key, energy, danceability of frames and of energy (track_id, energy)."""
    beat, key = tempo(onsets(frames), sr / hop), key_estimate(chroma(frames, bin_pitches(frame, sr)))
    rows = energy.join(beat, "track_id", "left").join(key, "track_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    dance = danceability(zero(F.col("strength")), zero(F.col("regularity")), F.col("energy"))
    return rows.select("track_id", F.round(zero(F.col("bpm")), 2).alias("bpm"), "music_key", F.round("energy", 4).alias("energy"), F.round(dance, 4).alias("danceability"))


def band_sums(frames: DataFrame, bin_range: list[int | None]) -> DataFrame:
    """track_id, frame_idx, band, e: summed magnitudes of each frame by named range."""
    of = F.array(*[F.lit(r).cast("int") for r in bin_range])
    rows = frames.select("track_id", "frame_idx", F.posexplode("mag").alias("i", "x")).withColumn("band", F.get(of, F.col("i"))).filter("band is not null")
    return rows.groupBy("track_id", "frame_idx", "band").agg(F.sum("x").alias("e"))


def groove(bands: DataFrame) -> DataFrame:
    """track_id, band, share, flux, dynamics: a band's share of the energy, how much it moves from frame to frame, and how it swells."""
    frame, track = Window.partitionBy("track_id", "frame_idx"), Window.partitionBy("track_id", "band")
    rows = bands.withColumn("share", F.col("e") / (F.sum("e").over(frame) + 1e-9)).withColumn("en", F.col("e") / (F.max("e").over(track) + 1e-9))
    rows = rows.withColumn("d", F.abs(F.col("en") - F.lag("en").over(track.orderBy("frame_idx"))))
    return rows.groupBy("track_id", "band").agg(F.round(F.avg("share"), 4).alias("share"), F.round(F.avg("d"), 4).alias("flux"), F.round(F.stddev_pop("en"), 4).alias("dynamics"))


def band_profile(bands: DataFrame) -> DataFrame:
    """track_id, band, level: root of the mean energy of each band, of unit length over a track's bands."""
    means = bands.groupBy("track_id", "band").agg(F.sqrt(F.avg("e")).alias("r"))
    total = F.sqrt(F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("track_id")))
    return means.select("track_id", "band", F.round(F.when(total > 0, F.col("r") / total).otherwise(0.0), 4).alias("level"))


def timeline(bands: DataFrame, bins: int = 100, start: float | None = None, end: float | None = None, rate: float = 1.0) -> DataFrame:
    """track_id, bin, band, level: mean energy over even stretches of a track, against its greatest, square-rooted.

    With start or end (seconds; rate: frames a second) only frames from one to the other count, the span being 0.05 seconds at least. Bin b begins
    at frame floor(b * frames / bins); a span of no more frames than bins has a bin for each frame.
    """
    track = Window.partitionBy("track_id")
    rows = bands
    if start is not None or end is not None:
        first = max(0.0, start or 0.0)
        rows = rows.filter(F.col("frame_idx") >= F.lit(int(first * rate)))
        if end is not None:
            rows = rows.filter(F.col("frame_idx") < F.lit(int(max(end, first + 0.05) * rate)))
        rows = rows.withColumn("frame_idx", F.col("frame_idx") - F.lit(int(first * rate)))
    n = F.max("frame_idx").over(track) + 1
    at = F.when(n <= bins, F.col("frame_idx")).otherwise(F.floor(((F.col("frame_idx") + 1) * bins - 1) / n))
    rows = rows.withColumn("bin", at.cast("long")).groupBy("track_id", "bin", "band").agg(F.avg("e").alias("x"))
    top = F.max("x").over(Window.partitionBy("track_id"))
    return rows.select("track_id", "bin", "band", F.round(F.sqrt(F.when(top > 0, F.col("x") / top).otherwise(0.0)), 4).alias("level"))


def windows(tracks: DataFrame, size: float, hop: float, least_fill: float = 0.4, most: int = 120) -> DataFrame:
    """track_id, nth, start, end of sliding windows over tracks (track_id, duration); the last must be filled by least_fill."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor((F.col("duration") - least_fill * size) / hop).cast("int") + 1))
    rows = tracks.filter("duration > 0").select("track_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("nth"))
    start = F.col("nth") * F.lit(float(hop))
    return rows.select("track_id", "nth", start.alias("start"), F.least(start + size, F.col("duration")).alias("end"))


def mel_filters(bands: int, frame: int, sr: int) -> list[tuple[int, int, float]]:
    """(band, bin, weight) of triangles between bins that are even on the mel scale, from 0 Hz to half the rate."""
    mel, hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    last = frame // 2
    edges = np.minimum(np.floor((frame + 1) * hz(np.linspace(0, mel(sr / 2), bands + 2)) / sr), last)
    bins, out = np.arange(last + 1), []
    for b in range(bands):
        lo, mid, hi = edges[b : b + 3]
        w = np.minimum((bins - lo) / max(mid - lo, 1e-9), (hi - bins) / max(hi - mid, 1e-9))
        out += [(b, int(i), float(w[i])) for i in np.flatnonzero(w > 0)]
    return out


def even_windows(tracks: DataFrame, size: float, most: int = 24) -> DataFrame:
    """track_id, nth, start, end: windows side by side over a whole track (track_id, duration), the last one flush with its end.

    A track shorter than a window is one window to be padded. Of more than `most` windows as many are taken at even steps, both ends with them.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / size).cast("int"))
    rows = tracks.filter("duration > 0").withColumn("_n", n)
    picked = F.when(F.col("_n") <= most, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.round(i * (F.col("_n") - 1) / F.lit(most - 1)).cast("int")))
    rows = rows.select("track_id", "duration", F.posexplode(picked).alias("nth", "_at"))
    start = F.greatest(F.lit(0.0), F.least(F.col("_at") * F.lit(float(size)), F.col("duration") - size))
    return rows.select("track_id", F.col("nth").cast("long").alias("nth"), F.round(start, 6).alias("start"), F.round(start + size, 6).alias("end"))


def excerpts(tracks: DataFrame, size: float = 30.0) -> DataFrame:
    """track_id, nth, start, end of three excerpts that begin at 15, 42.5 and 70 % of a track; ends may lie beyond it and are padded."""
    at = F.posexplode(F.array(*[F.lit(x) for x in (0.15, 0.425, 0.7)])).alias("nth", "part")
    rows = tracks.filter("duration > 0").select("track_id", "duration", at)
    return rows.select("track_id", F.col("nth").cast("long").alias("nth"), F.round(F.col("duration") * F.col("part"), 6).alias("start"), F.round(F.col("duration") * F.col("part") + size, 6).alias("end"))
