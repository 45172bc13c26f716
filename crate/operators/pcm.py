"""Frames and descriptors of audio stored in pieces: rows (track_id, offset, samples), offset being the place of a piece's first sample.

A track is cut anew into pages of even length, each with the samples that its last frames reach beyond it, so that a track of any
length is many tasks' work and frames over the borders of pieces are whole. Results don't depend on how a track is cut: a gap between
pieces is silent, and where pieces overlap the one that begins later counts (of two that begin together the longer, then the greater).
Null samples are zeros; a piece without samples, a null offset or track_id or an offset below 0 adds nothing, except that a track of
empty pieces only is one frame of silence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crate.operators.signal import mel_filters

#: Samples of a page (about: a page is a whole number of hops).
PAGE = 1 << 18


def stft(pieces: DataFrame, frame: int = 2048, hop: int = 512, page: int = PAGE) -> DataFrame:
    """track_id, frame_idx, mag: what signal.stft gives for whole tracks."""
    window = np.hanning(frame)
    return _by_page(pieces, frame, hop, page, lambda x: [("mag", list(np.abs(np.fft.rfft(x * window))))], "frame_idx long, mag array<double>")


def descriptor(pieces: DataFrame, sr: int = 22050, frame: int = 2048, hop: int = 512, bands: int = 40, page: int = PAGE) -> DataFrame:
    """track_id, vector of unit length: means of log-mel bands, their spreads, then mean and spread of centroid, bandwidth,
    85 % roll-off, zero crossings and root mean square of a track's frames. Zeros for a track without samples.

    A page gives number, mean and squared deviations of its frames, which are added up by track.
    """
    window, freqs = np.hanning(frame), np.arange(frame // 2 + 1) * sr / frame
    mel = np.zeros((frame // 2 + 1, bands))
    for band, i, weight in mel_filters(bands, frame, sr):
        mel[i, band] = weight

    def measured(x: np.ndarray) -> list[tuple[str, list]]:
        spectrum = np.abs(np.fft.rfft(x * window))
        power = spectrum + 1e-10
        total = power.sum(1)
        centre = power @ freqs / total
        width = np.sqrt((power * (freqs - centre[:, None]) ** 2).sum(1) / total)
        roll = freqs[(np.cumsum(power, 1) >= 0.85 * total[:, None]).argmax(1)]
        crossings = (np.diff(np.sign(x)) != 0).mean(1)
        values = np.column_stack([np.log1p(spectrum @ mel), centre, width, roll, crossings, np.sqrt((x * x).mean(1))])
        mean = values.mean(0)
        return [("n", [len(x)]), ("mean", [mean]), ("dev", [((values - mean) ** 2).sum(0)])]

    stats = _by_page(pieces, frame, hop, page, measured, "n long, mean array<double>, dev array<double>")
    each = Window.partitionBy("track_id", "k")
    rows = stats.select("track_id", "n", F.posexplode(F.arrays_zip("mean", "dev")).alias("k", "z")).select("track_id", "n", "k", "z.mean", "z.dev")
    rows = rows.withColumn("all", F.sum("n").over(each)).withColumn("m", F.sum(F.col("n") * F.col("mean")).over(each) / F.col("all"))
    spread = F.sqrt(F.sum(F.col("dev") + F.col("n") * F.pow(F.col("mean") - F.col("m"), 2)) / F.first("all"))
    parts = rows.groupBy("track_id", "k").agg(F.first("m").alias("m"), spread.alias("s"))
    # Bands: all means, then all spreads; the rest: pairs.
    at = lambda nth: F.when(F.col("k") < bands, F.col("k") + nth * bands).otherwise(2 * F.col("k") + nth)
    placed = parts.select("track_id", F.inline(F.array(F.struct(at(0).alias("i"), F.col("m").alias("x")), F.struct(at(1).alias("i"), F.col("s").alias("x")))))
    whole = placed.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    some = pieces.filter("offset >= 0").groupBy("track_id").agg(F.max(F.coalesce(F.size("samples"), F.lit(0)) > 0).alias("some"))
    sized = whole.withColumn("norm", norm).join(some, "track_id")
    return sized.select("track_id", F.transform("vector", lambda x: F.when(F.col("some") & (F.col("norm") > 0), x / F.col("norm")).otherwise(0.0)).alias("vector"))


def _by_page(pieces: DataFrame, frame: int, hop: int, page: int, of: Callable, schema: str) -> DataFrame:
    """track_id and what `of` makes of the frames (a row each) of every page; with frame_idx where the schema has it."""
    page = max(1, page // hop) * hop
    reach = page + max(0, frame - hop)
    size = F.coalesce(F.size("samples"), F.lit(0))
    known = pieces.filter("track_id is not null and offset >= 0").select("track_id", F.col("offset").cast("long").alias("offset"), F.col("samples").cast("array<double>").alias("samples"))
    # From the first page whose frames reach a piece to the page of its last sample.
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - reach) / page) + 1)
    last = F.greatest(first, F.floor((F.col("offset") + size - 1) / page))
    rows = known.withColumn("page", F.explode(F.sequence(first, last)))
    start, end = F.greatest(F.col("offset"), F.col("page") * page), F.least(F.col("offset") + size, F.col("page") * page + reach)
    cut = F.slice(F.col("samples"), (start - F.col("offset") + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))
    cuts = rows.select("track_id", "page", "offset", size.alias("size"), (start - F.col("page") * page).alias("at"), F.coalesce(cut, F.array().cast("array<double>")).alias("samples"))
    indexed = "frame_idx" in schema

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        placed = [(o, n, tuple(s) if tie else (), int(a), np.nan_to_num(np.asarray(s, float))) for o, n, a, s, tie in zip(group["offset"], group["size"], group["at"], group["samples"], group.duplicated(["offset", "size"], keep=False), strict=True)]
        length = max((a + len(s) for *_, a, s in placed if len(s)), default=0)
        if key[1] == 0:
            length = max(length, frame)  # a shorter track is padded
        x = np.zeros(length)
        for *_, a, s in sorted(placed, key=lambda p: p[:3]):
            x[a : a + len(s)] = s
        if length < frame:
            return pd.DataFrame()
        views = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop][: page // hop]
        found = pd.DataFrame(dict(of(views)))
        if indexed:
            found.insert(0, "frame_idx", np.arange(len(found)) + int(key[1]) * (page // hop))
        found.insert(0, "track_id", key[0])
        return found

    return cuts.groupBy("track_id", "page").applyInPandas(run, f"track_id {pieces.schema['track_id'].dataType.simpleString()}, {schema}")
