"""Movies to regions and traces.

``movie`` has one row a frame: recording, frame (1, 2, ... without gaps), height, width and pixels (row-major array).
Frames are never exploded to pixels and never sorted or windowed as whole recordings: passes over pixels are vectorized by
chunks of frames (``recording, chunk``), so one long recording spreads over many tasks. What a recording has once (template,
masks) is sent once a chunk.

Maps (mean, spread, correlation, peak ratio, mask) travel as bands of ``BAND`` image rows: recording, band, height, width and one
array of doubles a map. Tasks add up and smooth bands, the latter with the neighbouring bands' rows as a border; rows of
single pixels are made last, by ``pixels_of``, for tables. Operators that take maps take such rows too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionspark.functions import images, kernels
from motionspark.operators import rounds
from motionspark.runtime import checkpointed, ship_package


def frames_of(pdf: pd.DataFrame) -> np.ndarray:
    h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
    return np.array(pdf["pixels"].tolist(), float).reshape(-1, h, w)


#: Frames of a chunk: a few hundred megabytes of the largest frames, in one task.
CHUNK = 50


def chunk_of(size: int) -> Column:
    return F.floor((F.col("frame") - 1) / size).cast("int")


def by_chunk(movie: DataFrame, side: DataFrame, run, schema: str, size: int = CHUNK) -> DataFrame:
    """``run(frames, side)`` of each chunk of frames with its recording's row of ``side``; recordings without one are left
    out. Which chunks there are is read from the frame numbers alone."""
    ship_package(movie.sparkSession)
    dealt = movie.withColumn("chunk", chunk_of(size))
    sides = movie.select("recording", chunk_of(size).alias("chunk")).distinct().join(side, "recording")
    # names of its own, for both sides come from one table
    sides = sides.select(*[F.col(c).alias(f"side_{c}") for c in sides.columns])

    def both(frames: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if not len(frames) or not len(one):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return run(frames.sort_values("frame"), one.rename(columns=lambda c: c.removeprefix("side_")).iloc[0])

    return dealt.groupBy("recording", "chunk").cogroup(sides.groupBy("side_recording", "side_chunk")).applyInPandas(both, schema)


def frame_changes(movie: DataFrame, size: int = CHUNK) -> DataFrame:
    """recording, frame and d: the median absolute pixel difference to the frame before. The last frame of a chunk goes to
    the next chunk too."""
    ship_package(movie.sparkSession)
    at = chunk_of(size)
    dealt = movie.withColumn("chunk", F.explode(F.when(F.col("frame") % size == 0, F.array(at, at + 1)).otherwise(F.array(at))))

    def change(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        images = frames_of(pdf).reshape(len(pdf), -1)
        d = [float(np.median(np.abs(b - a))) for a, b in zip(images[:-1], images[1:], strict=True)]
        return pd.DataFrame({"recording": key[0], "frame": pdf["frame"].to_numpy()[1:], "d": d})

    return dealt.select("recording", "chunk", "frame", "height", "width", "pixels").groupBy("recording", "chunk").applyInPandas(change, "recording string, frame int, d double")


def quiet_window(movie: DataFrame, fps: float, least: int = 200, seconds: float = 10) -> DataFrame:
    """recording, start, activity: the first frame of the window with the least change between successive frames (median
    absolute pixel difference, moving median of 0.5 s, moving mean of the window)."""
    quick = frame_changes(movie)
    half = max(1, int(0.5 * fps + 0.5))
    win = max(least, int(seconds * fps + 0.5))
    calm = quick.withColumn("m", F.expr(f"percentile(d, 0.5) over (partition by recording order by frame rows between {half // 2} preceding and {half - half // 2 - 1} following)"))
    ahead = Window.partitionBy("recording").orderBy("frame").rowsBetween(0, win - 1)
    whole = calm.withColumns({"activity": F.avg("m").over(ahead), "k": F.count("*").over(ahead), "n": F.count("*").over(Window.partitionBy("recording"))})
    best = whole.filter(F.col("k") == F.least(F.lit(win), "n")).groupBy("recording").agg(F.min(F.struct("activity", "frame")).alias("b"))
    return best.select("recording", F.col("b.frame").alias("start"), F.col("b.activity").alias("activity"))


#: Image rows of a band, and recordings whose sums a task holds before it hands the oldest on.
BAND = 64
HELD_RECORDINGS = 4


def band_frame(recording: str, shape: tuple[int, int], size: int, images_: dict[str, np.ndarray], **extra) -> pd.DataFrame:
    """The bands of ``size`` image rows each as rows."""
    h, w = shape
    rows = []
    for k in range(0, h, size):
        rows.append({"recording": recording, "band": k // size, "height": h, "width": w, **extra, **{c: v[k : k + size].ravel() for c, v in images_.items()}})
    return pd.DataFrame(rows)


def band_schema(*columns: str, extra: str = "") -> str:
    return ", ".join(["recording string, band int, height int, width int", *([extra] if extra else []), *(f"{c} array<double>" for c in columns)])


def assembled(bands: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    """Whole images from all bands of a recording."""
    bands = bands.sort_values("band")
    return [np.concatenate([np.asarray(v, float) for v in bands[c]]).reshape(-1, int(bands["width"].iloc[0])) for c in columns]


def pixels_of(bands: DataFrame, *columns: str) -> DataFrame:
    """recording, y, x and the maps ``columns``: one row a pixel."""
    each = bands.select("recording", "band", "width", F.posexplode(F.arrays_zip(*columns)).alias("k", "v"))
    y, x = F.col("band") * BAND + F.floor(F.col("k") / F.col("width")), F.col("k") % F.col("width")
    return each.select("recording", y.cast("int").alias("y"), x.cast("int").alias("x"), *[F.col(f"v.{c}").alias(c) for c in columns])


def bands_of(maps: DataFrame) -> DataFrame:
    """Maps as bands, whether they come as bands or as rows of pixels (pixels that are not there are 0)."""
    if "band" in maps.columns:
        return maps
    columns, size = [c for c in maps.columns if c not in ("recording", "y", "x")], BAND
    sizes = maps.groupBy("recording").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    rows = maps.select("recording", "y", "x", *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("band", F.floor(F.col("y") / BAND).cast("int")).join(sizes, "recording")

    def run(key, pdf):
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        out = {"recording": key[0], "band": key[1], "height": h, "width": w}
        for c in columns:
            image = np.zeros((min(size, h - key[1] * size), w))
            image[pdf["y"] - key[1] * size, pdf["x"]] = pdf[c]
            out[c] = image.ravel()
        return pd.DataFrame([out])

    return rows.groupBy("recording", "band").applyInPandas(run, band_schema(*columns))


def pixel_sums(movie: DataFrame) -> DataFrame:
    """recording, band, height, width, n, mean and m2 (squared deviations) of each band, over the frames that a task saw. A task holds the images of
    ``HELD_RECORDINGS`` recordings at most."""
    ship_package(movie.sparkSession)
    size, most = BAND, HELD_RECORDINGS

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for name, part in pdf.groupby("recording", sort=False):
                x = frames_of(part)
                n, mean = len(x), x.mean(0)
                m2 = ((x - mean) ** 2).sum(0)
                if name in held:
                    n0, mean0, m20 = held.pop(name)
                    gap = mean - mean0
                    mean, m2 = mean0 + gap * n / (n0 + n), m20 + m2 + gap * gap * n0 * n / (n0 + n)
                    n += n0
                held[name] = n, mean, m2
                while len(held) > most:
                    old = next(iter(held))
                    n, mean, m2 = held.pop(old)
                    yield band_frame(old, mean.shape, size, {"mean": mean, "m2": m2}, n=n)
        for name, (n, mean, m2) in held.items():
            yield band_frame(name, mean.shape, size, {"mean": mean, "m2": m2}, n=n)

    return movie.select("recording", "height", "width", "pixels").mapInPandas(run, band_schema("mean", "m2", extra="n long"))


def mean_std_bands(movie: DataFrame) -> DataFrame:
    """Mean and sample spread of each pixel, as bands."""

    def merge(key, pdf):
        n, mean, m2 = 0, 0.0, 0.0
        for r in pdf.itertuples():
            gap, k = np.asarray(r.mean) - mean, n + r.n
            mean, m2, n = mean + gap * r.n / k, m2 + np.asarray(r.m2) + gap * gap * n * r.n / k, k
        std = np.sqrt(m2 / (n - 1)) if n > 1 else np.zeros_like(mean)
        return pd.DataFrame([{"recording": key[0], "band": key[1], "height": pdf["height"].iloc[0], "width": pdf["width"].iloc[0], "mean": mean, "std": std}])

    return pixel_sums(movie).groupBy("recording", "band").applyInPandas(merge, band_schema("mean", "std"))


def template(movie: DataFrame, quiet: DataFrame, frames: int) -> DataFrame:
    """The mean image of each recording's quiet window. Sums leave a task as one image a recording."""
    inside = movie.join(quiet.select("recording", "start"), "recording").filter((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + frames))

    def whole(key, pdf):
        return pd.DataFrame([{"recording": key[0], "template": assembled(pdf, "mean")[0].ravel()}])

    return mean_std_bands(inside).groupBy("recording").applyInPandas(whole, "recording string, template array<double>")


def estimate_shifts(movie: DataFrame, templates: DataFrame, most: int, half_limit: int, rescues: int = 5, factor: float = 2.0, up: int = 50) -> DataFrame:
    """dx (right), dy (up) of each frame against its recording's fixed template, in steps of ``1 / up`` pixels.

    All frames are independent: the template does not follow the frames as a sequential registration's would. A frame
    whose shift comes near its window is looked at again in a wider one; after ``rescues`` tries it is unstable."""
    schema = "recording string, frame int, dx_px double, dy_px double, rescue_count int, unstable_tracking boolean"

    def run(frames: pd.DataFrame, one: pd.Series) -> pd.DataFrame:
        rows = []
        for r in frames.itertuples():
            image, base = (np.asarray(v, float).reshape(r.height, r.width) for v in (r.pixels, one["template"]))
            limit, tries = most, 0
            x, y = images.shift_between(image, base, limit, up)
            while max(abs(x), abs(y)) > 0.9 * limit and tries < rescues and limit < half_limit:
                limit, tries = min(half_limit, max(limit + 10, int(np.ceil(factor * limit)))), tries + 1
                x, y = images.shift_between(image, base, limit, up)
            rows.append((r.recording, int(r.frame), x, -y, tries, max(abs(x), abs(y)) > 0.9 * limit))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return by_chunk(movie, templates, run, schema)


def motion_quality(shifts: DataFrame, limit: float = 50) -> DataFrame:
    """excessive_motion if a shift is beyond the limit, high_motion if the range of the shifts of one axis is, else good."""
    most = F.max(F.greatest(F.abs("dx_px"), F.abs("dy_px")))
    span = F.greatest(*[F.max(c) - F.min(c) for c in ("dx_px", "dy_px")])
    got = shifts.groupBy("recording").agg(most.alias("max_shift"), span.alias("shift_range"))
    return got.withColumn("motion_quality", F.when(F.col("max_shift") > limit, "excessive_motion").when(F.col("shift_range") > limit, "high_motion").otherwise("good"))


def align_shifts(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """A shift for every frame: frames beyond the last known shift repeat it, surplus shifts go."""
    order = Window.partitionBy("recording").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    both = frames.select("recording", "frame").join(shifts.select("recording", "frame", F.struct("dx_px", "dy_px").alias("s")), ["recording", "frame"], "left")
    filled = F.last("s", ignorenulls=True).over(order)
    return both.select("recording", "frame", filled.alias("s")).select("recording", "frame", "s.dx_px", "s.dy_px")


def apply_shifts(movie: DataFrame, shifts: DataFrame) -> DataFrame:
    """Frames moved back by their shifts, as whole 16-bit values."""
    ship_package(movie.sparkSession)

    def run(batches):
        for pdf in batches:
            moved = [np.clip(np.floor(images.translate(np.asarray(r.pixels, float).reshape(r.height, r.width), -r.dx_px, r.dy_px) + 0.5), 0, 65535).astype(np.int32).ravel() for r in pdf.itertuples()]
            yield pdf.assign(pixels=moved)[["recording", "frame", "height", "width", "pixels"]]

    return movie.join(shifts, ["recording", "frame"]).mapInPandas(run, "recording string, frame int, height int, width int, pixels array<int>")


def sample_frames(movie: DataFrame, n: int) -> DataFrame:
    """The frames round(linspace(1, last, n)) of each recording."""
    last = movie.groupBy("recording").agg(F.max("frame").alias("last"))
    step = (F.col("last") - 1) / F.lit(float(max(1, n - 1)))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.round(1 + k * step).cast("int")))
    wanted = last.select("recording", F.explode(places).alias("frame"))
    return movie.join(wanted, ["recording", "frame"], "left_semi")


def pixel_mean_std(movie: DataFrame) -> DataFrame:
    """Mean and sample spread of each pixel, as rows."""
    return pixels_of(mean_std_bands(movie), "mean", "std")


def smoothed(bands: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """``bands`` with the maps named in ``sigmas`` under a Gaussian filter of that width, the image's border repeated. A band is sent to
    its neighbours as far as the filter reaches, so an image of any height spreads over tasks."""
    ship_package(bands.sparkSession)
    reach = -(-max(int(np.ceil(2 * v)) for v in sigmas.values()) // BAND)
    last = F.ceil(F.col("height") / BAND).cast("int") - 1
    dealt = bands.withColumn("to", F.explode(F.sequence(F.greatest(F.lit(0), F.col("band") - reach), F.least(last, F.col("band") + reach))))
    maps = [f.name for f in bands.schema if f.dataType.simpleString() == "array<double>"]

    def run(key, pdf):
        pdf = pdf.sort_values("band")
        own = int(np.flatnonzero(pdf["band"] == key[1])[0])
        width = int(pdf["width"].iloc[0])
        above = sum(len(v) for v in pdf[maps[0]].iloc[:own]) // width
        out = {c: pdf[c].iloc[own] for c in ["recording", "band", "height", "width", *maps]}
        rows = len(out[maps[0]]) // width
        for c, sigma in sigmas.items():
            image = np.concatenate([np.asarray(v, float) for v in pdf[c]]).reshape(-1, width)
            out[c] = images.smooth(image, sigma)[above : above + rows].ravel()
        return pd.DataFrame([out])

    return dealt.select("recording", "band", "height", "width", *maps, "to").groupBy("recording", "to").applyInPandas(run, band_schema(*maps))


def brain_mask(maps: DataFrame, sigma: float = 10, least: int = 5000, widen: int = 5) -> DataFrame:
    """``maps`` (mean, std) with ``in_mask`` (1 or 0 in bands, boolean in rows). The product of both, each scaled to one, is smoothed by bands; the
    level, holes and parts of the mask need the whole image, which is one task's work."""
    ship_package(maps.sparkSession)
    as_rows = "y" in maps.columns
    bands = bands_of(maps.select("recording", "y", "x", "mean", "std") if as_rows else maps)
    range_of = bands.groupBy("recording").agg(*[f(g(c)).alias(f"_{k}_{c}") for c in ("mean", "std") for k, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))])
    eps = float(np.finfo(float).eps)
    unit = lambda c: F.transform(c, lambda v: (v - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + eps))
    both = bands.join(range_of, "recording").withColumn("both", F.zip_with(unit("mean"), unit("std"), lambda a, b: a * b))
    both = smoothed(both.select(*bands.columns, "both"), {"both": sigma})
    maps_ = [c for c in both.columns if c not in ("recording", "band", "height", "width", "both")]

    def run(pdf):
        pdf = pdf.sort_values("band")
        mask = images.mask_of(assembled(pdf, "both")[0], least, widen)
        cut = np.cumsum([len(v) for v in pdf["both"]])[:-1]
        return pdf.drop(columns="both").assign(in_mask=np.split(mask.ravel().astype(float), cut))

    got = both.groupBy("recording").applyInPandas(run, band_schema(*maps_, "in_mask"))
    return pixels_of(got, "mean", "std", "in_mask").withColumn("in_mask", F.col("in_mask") > 0) if as_rows else got


def cn_pnr_bands(movie: DataFrame, chunk: int = 50) -> DataFrame:
    """Neighbour correlation and peak-to-noise ratio, averaged over blocks of ``chunk`` frames in their order, as bands. A block leaves its
    task as one image."""
    ship_package(movie.sparkSession)
    dealt, size = movie.withColumn("chunk", chunk_of(chunk)), BAND

    def run(key, pdf):
        cn, pnr = images.correlation_maps(frames_of(pdf.sort_values("frame")))
        return band_frame(key[0], cn.shape, size, {"cn": cn, "pnr": pnr})

    def mean(key, pdf):
        return pd.DataFrame([{"recording": key[0], "band": key[1], "height": pdf["height"].iloc[0], "width": pdf["width"].iloc[0], **{c: np.mean(np.stack(pdf[c]), axis=0) for c in ("cn", "pnr")}}])

    parts = dealt.select("recording", "chunk", "frame", "height", "width", "pixels").groupBy("recording", "chunk").applyInPandas(run, band_schema("cn", "pnr"))
    return parts.groupBy("recording", "band").applyInPandas(mean, band_schema("cn", "pnr"))


def cn_pnr_maps(movie: DataFrame, chunk: int = 50) -> DataFrame:
    """The maps of ``cn_pnr_bands`` as rows, before masking and smoothing."""
    return pixels_of(cn_pnr_bands(movie, chunk), "cn", "pnr")


def finished_maps(bands: DataFrame, blur: tuple[float, float] = (1.5, 1.0)) -> DataFrame:
    """``bands`` (cn, pnr, in_mask and others) whose correlation and peak maps are 0 outside the mask and then smoothed: what statistics,
    limits and seeds are taken from."""
    masked = bands.withColumns({c: F.zip_with(c, "in_mask", lambda v, m: F.when(m > 0, v).otherwise(0.0)) for c in ("cn", "pnr")})
    return smoothed(masked, dict(zip(("cn", "pnr"), blur, strict=True)))


def recording_maps(movie: DataFrame, chunk: int = 50, mask: tuple[float, int, int] = (10, 5000, 5), blur: tuple[float, float] = (1.5, 1.0)) -> DataFrame:
    """All maps of each recording as bands (mean, std, in_mask, and finished cn and pnr), from its sampled frames. ``mask`` are the parameters
    of ``brain_mask``."""
    still = brain_mask(mean_std_bands(movie), *mask)
    moving = cn_pnr_bands(movie, chunk).select("recording", "band", "cn", "pnr")
    return finished_maps(still.join(moving, ["recording", "band"]), blur)


PERCENTILES = (25, 50, 75, 90, 95)


def map_stats(maps: DataFrame, min_corr: float = 0.3, min_pnr: float = 3.0) -> DataFrame:
    """Statistics of the two maps within the mask (``in_mask``; without that column, of all pixels), the class of the data,
    and the least limits that count, lowered where the signal is weak."""
    ship_package(maps.sparkSession)
    bands = bands_of(maps)
    names = [f"{c}_{k}" for c in ("cn", "pnr") for k in ("mean", "median", "std", "min", "max", *(f"p{p}" for p in PERCENTILES))]
    held = ["recording", "band", "width", "cn", "pnr", *(["in_mask"] if "in_mask" in bands.columns else [])]

    def run(key, pdf):
        mask = assembled(pdf, "in_mask")[0] > 0 if "in_mask" in pdf else np.ones_like(assembled(pdf, "cn")[0], bool)
        out = {"recording": key[0]}
        for c in ("cn", "pnr"):
            v = np.sort(assembled(pdf, c)[0][mask])
            if len(v):
                measures = [v.mean(), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v.std(ddof=1) if len(v) > 1 else 0.0, v[0], v[-1], *(kernels.hazen(v, p) for p in PERCENTILES)]
                out |= dict(zip((n for n in names if n.startswith(f"{c}_")), map(float, measures), strict=True))
        return pd.DataFrame([out], columns=["recording", *names]) if len(out) > 1 else pd.DataFrame(columns=["recording", *names])

    wide = bands.select(*held).groupBy("recording").applyInPandas(run, f"recording string, {', '.join(f'{n} double' for n in names)}").withColumn("cn_range", F.col("cn_max") - F.col("cn_min"))
    wide = wide.withColumn("cn_uniform", (F.col("cn_range") < 0.15) & (F.col("cn_median") > 0.7))
    quality = F.when(F.col("pnr_max") < min_pnr, "low_pnr").when(F.col("cn_max") < min_corr, "poor_correlation").otherwise("normal")
    weak = F.col("pnr_p75") < min_pnr
    return wide.withColumns({"data_quality": quality, "weak_signal_mode": weak, "effective_min_pnr": F.when(weak, 0.75 * min_pnr).otherwise(F.lit(float(min_pnr))), "effective_min_corr": F.when(weak, 0.80 * min_corr).otherwise(F.lit(float(min_corr)))})


def threshold_levels(stats: DataFrame, min_corr: float | None = None, min_pnr: float | None = None) -> DataFrame:
    """Strict, medium and relaxed limits of each recording, none below the least limits of ``map_stats`` (or those given
    here in their place); and whether its correlation map is too even to count."""
    least_c = F.col("effective_min_corr") if min_corr is None else F.lit(float(min_corr))
    least_p = F.col("effective_min_pnr") if min_pnr is None else F.lit(float(min_pnr))
    c, p = F.greatest(least_c, F.least("cn_p75", F.lit(0.6))), F.greatest(least_p, F.least("pnr_p75", F.lit(6.0)))
    row = lambda k, name, a, b: F.struct(F.lit(k).alias("level"), F.lit(name).alias("name"), a.alias("cn"), b.alias("pnr"))
    levels = F.array(row(1, "strict", c, p), row(2, "medium", F.greatest(least_c, 0.7 * c), F.greatest(0.8 * least_p, 0.7 * p)), row(3, "relaxed", least_c, least_p))
    return stats.select("recording", "cn_uniform", F.inline(levels))


def find_regions(maps: DataFrame, levels: DataFrame, g_sig: float = 3.0, least: int = 12, most: int = 120, grow: bool = True, blur: tuple[float, float] | None = (1.5, 1.0)) -> DataFrame:
    """Seeds (grow=False: y, x, score, level) or grown regions (one row a pixel with roi_id) of each recording; ``maps`` has mean, cn, pnr
    and in_mask. Rows of raw maps are finished by ``blur`` first; finished ones (bands) come with ``blur`` None. Where the
    correlation map is even (``cn_uniform``) only the peak map gives seeds. Seeds are thinned out by ``thinned`` before regions are
    grown from them in order, each in a window of its own, so one recording's image is one task."""
    ship_package(maps.sparkSession)
    bands = bands_of(maps)
    bands = finished_maps(bands, blur) if blur else bands
    seeds = thinned(seed_candidates(bands, levels, g_sig), 1.5 * g_sig)
    if not grow:
        return seeds.select("recording", F.col("place").alias("roi_id"), "y", "x", "score", "level")
    listed = seeds.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("place", "y", "x", "level"))).alias("seeds"))

    def run(pdf):
        cn, pnr, mean, mask = assembled(pdf, "cn", "pnr", "mean", "in_mask")
        found = [(int(r["y"]), int(r["x"]), int(r["level"])) for r in pdf["seeds"].iloc[0]]
        name = pdf["recording"].iloc[0]
        rows = [(name, k + 1, int(a), int(b), 0.0, level) for k, (level, cells) in enumerate(images.grow(found, cn, pnr, mean, mask > 0, g_sig, least, most)) for a, b in cells]
        return pd.DataFrame(rows, columns=["recording", "roi_id", "y", "x", "score", "level"])

    joined = bands.select("recording", "band", "width", "mean", "cn", "pnr", "in_mask").join(listed, "recording")
    return joined.groupBy("recording").applyInPandas(run, "recording string, roi_id int, y int, x int, score double, level int")


def seed_candidates(bands: DataFrame, levels: DataFrame, g_sig: float = 3.0) -> DataFrame:
    """recording, y, x, score, level and place (1 is the best score; ties by y and x) of every candidate: regional maxima of the maps smoothed at three
    scales, plateaus included, over the limits of each level; the first level that finds a pixel keeps it."""
    even = F.bool_or("cn_uniform") if "cn_uniform" in levels.columns else F.lit(False)
    limits = levels.groupBy("recording").agg(even.alias("cn_uniform"), F.transform(F.array_sort(F.collect_list(F.struct("level", "cn", "pnr"))), lambda s: F.array(s["cn"], s["pnr"])).alias("levels"))
    scales = (0.5 * g_sig, g_sig, 1.5 * g_sig)
    inside = bands.withColumns({c: F.zip_with(c, "in_mask", lambda v, m: F.when(m > 0, v).otherwise(0.0)) for c in ("cn", "pnr", "mean")})
    wide = inside.withColumns({f"{c}_{k}": F.col(c) for c in ("cn", "pnr") for k in range(3)} | {"mean_0": F.col("mean")})
    wide = smoothed(wide, {f"{c}_{k}": s for c in ("cn", "pnr") for k, s in enumerate(scales)} | {"mean_0": g_sig})

    def run(pdf):
        cn, pnr, mask, m, *rest = assembled(pdf, "cn", "pnr", "in_mask", "mean_0", *(f"{c}_{k}" for c in ("cn", "pnr") for k in range(3)))
        found = images.seeds(cn, pnr, mask > 0, [tuple(v) for v in pdf["levels"].iloc[0]], rest[:3], rest[3:], bool(pdf["cn_uniform"].iloc[0]), m)
        name = pdf["recording"].iloc[0]
        return pd.DataFrame([(name, y, x, score, level, k) for k, (y, x, score, level) in enumerate(found, 1)], columns=["recording", "y", "x", "score", "level", "place"])

    return wide.join(limits, "recording").groupBy("recording").applyInPandas(run, "recording string, y int, x int, score double, level int, place int")


def thinned(seeds: DataFrame, spacing: float) -> DataFrame:
    """``seeds`` without those nearer than ``spacing`` to a better one that stays. Pairs meet in cells of a grid, and rounds settle all seeds whose
    better neighbours are settled, so one recording's seeds spread over tasks."""
    seeds = checkpointed(seeds)
    cell = lambda c: F.floor(F.col(c) / spacing)
    home = seeds.select("recording", F.col("place").alias("i"), F.col("y").alias("yi"), F.col("x").alias("xi"), cell("y").alias("cy"), cell("x").alias("cx"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = seeds.withColumn("_o", around).select("recording", F.col("place").alias("j"), F.col("y").alias("yj"), F.col("x").alias("xj"), (cell("y") + F.col("_o.a")).alias("cy"), (cell("x") + F.col("_o.b")).alias("cx"))
    pairs = home.join(near, ["recording", "cy", "cx"]).filter((F.col("i") < F.col("j")) & (F.hypot(F.col("yi") - F.col("yj"), F.col("xi") - F.col("xj")) < spacing))
    gone = rounds.first_come(pairs.select("recording", "i", "j"))
    return seeds.join(gone.select("recording", F.col("node").alias("place")), ["recording", "place"], "left_anti")


def neuropil_masks(masks: DataFrame, height: int, width: int, inner: float = 3.0, outer: float | None = None) -> DataFrame:
    """A ring around each region: within ``outer`` of it, not within ``inner``, and on no region."""
    outer = max(2.5 * inner, inner + 4) if outer is None else outer
    offsets = lambda r: [(a, b) for a in range(-int(r), int(r) + 1) for b in range(-int(r), int(r) + 1) if a * a + b * b <= r * r]

    def widened(r):
        o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets(r)]))
        moved = masks.withColumn("o", o).select("recording", "roi_id", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"))
        return moved.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()

    ring = widened(outer).join(widened(inner), ["recording", "roi_id", "y", "x"], "left_anti")
    return ring.join(masks.select("recording", "y", "x").distinct(), ["recording", "y", "x"], "left_anti").select("recording", "roi_id", "y", "x")


def extract_traces(movie: DataFrame, masks: DataFrame, how: str = "mean") -> DataFrame:
    """recording, roi_id, frame and the mean or median of the pixels of each region."""
    pixels = masks.groupBy("recording").agg(F.collect_list(F.struct(F.col("roi_id").cast("long").alias("roi_id"), "y", "x")).alias("cells"))
    value = np.mean if how == "mean" else np.median

    def run(frames: pd.DataFrame, one: pd.Series) -> pd.DataFrame:
        stack = frames_of(frames)
        roi, y, x = (np.array([c[k] for c in one["cells"]]) for k in ("roi_id", "y", "x"))
        parts = [pd.DataFrame({"recording": one["recording"], "roi_id": r, "frame": frames["frame"].to_numpy(), "f": value(stack[:, y[roi == r], x[roi == r]], axis=1)}) for r in np.unique(roi)]
        return pd.concat(parts)

    return by_chunk(movie, pixels, run, "recording string, roi_id long, frame int, f double")


def global_signal(movie: DataFrame, masks: DataFrame, frames: int, least: int = 100) -> DataFrame:
    """The mean of pixels outside all regions on ``frames`` sampled frames, drawn through all frames by a monotone cubic;
    recordings with few such pixels take the mean of all."""
    last = movie.groupBy("recording").agg(F.max("frame").alias("last"))
    cells = masks.groupBy("recording").agg(F.collect_set(F.struct("y", "x")).alias("cells"))
    side = last.join(cells, "recording", "left").select("recording", F.coalesce("cells", F.array().cast("array<struct<y: int, x: int>>")).alias("cells"))

    def outside(pdf: pd.DataFrame, one: pd.Series) -> pd.DataFrame:
        stack = frames_of(pdf)
        free = np.ones(stack.shape[1:], bool)
        for c in one["cells"]:
            free[c["y"], c["x"]] = False
        g = stack[:, free].mean(1) if free.sum() > least else stack.mean((1, 2))
        return pd.DataFrame({"recording": one["recording"], "frame": pdf["frame"].to_numpy(), "g": g})

    points = by_chunk(sample_frames(movie, frames), side, outside, "recording string, frame int, g double").join(last, "recording")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        at = np.arange(1, int(pdf["last"].iloc[0]) + 1)
        g = kernels.pchip(pdf["frame"].to_numpy(float), pdf["g"].to_numpy(float), at) if len(pdf) > 2 else np.interp(at, pdf["frame"], pdf["g"])
        return pd.DataFrame({"recording": pdf["recording"].iloc[0], "signal": [g.tolist()]})

    return points.groupBy("recording").applyInPandas(run, "recording string, signal array<double>")


def roi_shape(masks: DataFrame, px_um: float) -> DataFrame:
    """Shape of each region from its pixels."""
    ship_package(masks.sparkSession)
    cells = F.collect_list(F.struct("y", "x"))

    @F.pandas_udf("area int, extent double, major double, minor double, eccentricity double, solidity double, perimeter double, compactness double")
    def measure(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([images.shape(np.array([c["y"] for c in v]), np.array([c["x"] for c in v])) for v in p])

    got = masks.groupBy("recording", "roi_id").agg(cells.alias("p")).select("recording", "roi_id", measure("p").alias("m")).select("recording", "roi_id", "m.*")
    um2 = F.col("area") * px_um * px_um
    return got.withColumns({"area_um2": um2, "diameter_um": 2 * F.sqrt(um2 / F.lit(float(np.pi))), "aspect": F.try_divide("major", "minor")})


def reject_shape(shapes: DataFrame) -> DataFrame:
    """``c_shape`` and ``why_shape``: the first limit of shape that a region fails."""
    x = lambda c: F.col(c).cast("double")
    limits = [
        (F.col("compactness") < 0.20, "compactness", "Low compactness (%.2f < 0.20)", "compactness"), (F.col("extent") < 0.35, "extent", "Low extent (%.2f < 0.35) - stringy", "extent"),
        (F.col("extent") > 0.95, "extent", "High extent (%.2f > 0.95) - rectangular", "extent"), (F.col("aspect") > 3, "aspect", "High aspect ratio (%.1f > 3.0)", "aspect"),
        (F.col("solidity") < 0.55, "solidity", "Low solidity (%.2f < 0.55)", "solidity"), (F.col("eccentricity") > 0.93, "eccentricity", "High eccentricity (%.2f > 0.93)", "eccentricity"),
    ]
    category = F.coalesce(*[F.when(c, f"shape_{k}") for c, k, _, _ in limits])
    reason = F.coalesce(*[F.when(c, F.format_string(text, x(v))) for c, _, text, v in limits])
    return shapes.withColumns({"c_shape": category, "why_shape": reason})


def perimeter(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of which one of the four neighbours is not in the same mask."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    near = mask.withColumn("o", around).select(*keys, "y", "x", (F.col("y") + F.col("o.a")).alias("ny"), (F.col("x") + F.col("o.b")).alias("nx"))
    inside = mask.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    return near.join(inside, [*keys, "ny", "nx"], "left_anti").select(*keys, "y", "x").distinct()


def reject_edge(masks: DataFrame, field: DataFrame, most: float = 0.20) -> DataFrame:
    """Share of a region's perimeter on the perimeter of the field of view's mask, and whether it is too much."""
    own = perimeter(masks.select("recording", "roi_id", "y", "x"), ["recording", "roi_id"])
    edge = perimeter(field.select("recording", "y", "x"), ["recording"]).withColumn("on_edge", F.lit(1))
    both = own.join(edge, ["recording", "y", "x"], "left").groupBy("recording", "roi_id").agg((F.count("on_edge") / F.count("*")).alias("contact"))
    touches = F.col("contact") > most
    return both.withColumns({"c_edge": F.when(touches, "edge_contact"), "why_edge": F.when(touches, F.format_string(f"Edge contact (%.0f%% > {100 * most:.0f}%%)", 100 * F.col("contact")))})


def zero_roi_diagnostics(stats: DataFrame, counts: DataFrame, seeds: DataFrame | None = None, min_corr: float = 0.3, min_pnr: float = 3.0, least: int = 12, most: int = 120, g_sig: float = 3.0) -> DataFrame:
    """Metric and value (as text) rows of recordings without regions: measures of their maps, the limits that were asked for, and how many ``seeds`` were left."""
    empty = stats.join(counts.filter("n_rois > 0"), "recording", "left_anti")
    found = seeds.groupBy("recording").agg(F.count("*").alias("n_seeds")) if seeds is not None else empty.select("recording", F.lit(0).alias("n_seeds"))
    empty = empty.join(found, "recording", "left")
    number = lambda c, places: F.format_string(f"%.{places}f", F.col(c).cast("double"))
    values = {
        "n_rois": F.lit("0"), "cn_median": number("cn_median", 4), "cn_range": number("cn_range", 4), "cn_max": number("cn_max", 4), "pnr_median": number("pnr_median", 2), "pnr_max": number("pnr_max", 2), "min_pnr_thresh": F.lit(f"{min_pnr:.1f}"),
        "min_corr_thresh": F.lit(f"{min_corr:.2f}"), "min_area": F.lit(str(least)), "max_area": F.lit(str(most)), "n_seeds": F.coalesce("n_seeds", F.lit(0)).cast("string"), "data_quality": F.col("data_quality"), "gSig": F.lit(f"{g_sig:g}"),
    }
    return empty.select("recording", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])))


def detection_thresholds(stats: DataFrame, levels: DataFrame, rois: DataFrame, min_corr: float = 0.3, min_pnr: float = 3.0) -> DataFrame:
    """One row a recording: its number of regions, measures of its maps, the limits of the last level (the given ones where
    the correlation map is even, for then there are no levels) and the method that found its regions."""
    last = levels.groupBy("recording").agg(F.max(F.struct("level", "cn", "pnr")).alias("x"))
    used = rois.groupBy("recording").agg(F.count_distinct("roi_id").alias("n_rois"), F.min("level").alias("least"))
    method = F.when(F.col("cn_uniform"), "pnr_only").when(F.col("least").isNull(), "none").when(F.col("least") <= 3, "cn_pnr").when(F.col("least") == 4, "pnr_only").otherwise("fallback")
    limit = lambda c, given: F.when(F.col("cn_uniform") | F.col("x").isNull(), given).otherwise(F.col(f"x.{c}"))
    joined = stats.join(last, "recording", "left").join(used, "recording", "left")
    return joined.select("recording", F.coalesce("n_rois", F.lit(0)).alias("n_rois"), "cn_median", "cn_range", "cn_max", "pnr_median", "pnr_max", limit("cn", min_corr).alias("cn"), limit("pnr", min_pnr).alias("pnr"), "cn_uniform", method.alias("method"))
