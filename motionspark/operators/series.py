"""Motion series of recordings: steps, runs, drift, settling, repositions, bursts, spectra and timecourses.

``frames`` has recording, frame (from 1), dx_um, dy_um, fps and px_um. All windows and groups use the recording as key, so
one shuffle by recording serves a whole chain of these operators.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionspark.functions.stats import hazen, sample_std, share, values_of
from motionspark.runtime import ship_package

FLAT_UM, FLAT_PX = 0.05, 0.25
PEG = 0.98


def in_series():
    return Window.partitionBy("recording").orderBy("frame")


def length(x: Column, y: Column) -> Column:
    """By squares, not hypot, which rounds otherwise: bins and ranks hold these values to the last bit."""
    return F.sqrt(x * x + y * y)


def to_um(df: DataFrame) -> DataFrame:
    """Shifts in micrometres, and the time of each frame."""
    return df.withColumns({
        "dx_um": F.col("dx_px") * F.col("px_um"), "dy_um": F.col("dy_px") * F.col("px_um"), "time_s": (F.col("frame") - 1) / F.col("fps"), "time_min": (F.col("frame") - 1) / F.col("fps") / 60,
    })


def step_size(df: DataFrame) -> DataFrame:
    """``step_um``: distance to the frame before; 0 at frame 1, NULL beside a missing shift."""
    x, y = (F.col(c) - F.lag(c).over(in_series()) for c in ("dx_um", "dy_um"))
    gap = length(x, y)
    return df.withColumn("step_um", F.when(F.col("frame") == 1, 0.0).otherwise(gap))


#: Share of the smaller side that a search window of a calcium recording takes.
WINDOW_SHARE = {"auto": 0.40, "auto_conservative": 0.10, "auto_loose": 0.45, "auto_extreme": 0.50}
#: Modes of a movement recording: a share, a length in micrometres, or all that fits.
MOVEMENT_WINDOWS = {"auto": 0.30, "auto_conservative": 50.0, "auto_loose": None}


def max_shift(df: DataFrame, mode: str = "auto", value: float | tuple[float, float] | None = None, stage: str = "calcium") -> DataFrame:
    """The search window from height, width and px_um: ``max_shift_px_y`` and ``max_shift_px_x``, the same in micrometres,
    and the smaller of the two as ``max_shift_px`` and ``max_shift_um``. ``value`` of the fixed modes is one length or two
    (y, x). A window is at least 1 px and at most half a side less one: of its own side for the fixed modes of a calcium
    recording, else of the smaller side."""
    half = lambda side: (F.floor(side / 2) - 1).cast("double")
    small = F.least("height", "width")
    most = (half(small), half(small))
    if mode in ("fixed_um", "fixed_px") and value is not None:
        lengths = value if isinstance(value, tuple) else (value, value)
        px = [F.round(F.lit(float(v)) / (F.col("px_um") if mode == "fixed_um" else F.lit(1.0))) for v in lengths]
        most = (half(F.col("height")), half(F.col("width"))) if stage == "calcium" else most
    elif stage == "calcium" and mode in WINDOW_SHARE:
        px = [F.round(F.lit(WINDOW_SHARE[mode]) * small)] * 2
    elif stage == "movement" and mode in MOVEMENT_WINDOWS:
        length = MOVEMENT_WINDOWS[mode]
        px = [most[0] if length is None else F.round(F.lit(length) / F.col("px_um")) if length > 1 else F.round(F.lit(length) * small)] * 2
    else:
        raise ValueError(f"unknown mode {mode} of stage {stage}, or no value")
    y, x = (F.greatest(F.lit(1.0), F.least(m, v)) for m, v in zip(most, px, strict=True))
    um = F.col("px_um")
    return df.withColumns({"max_shift_px_y": y, "max_shift_px_x": x, "max_shift_um_y": y * um, "max_shift_um_x": x * um, "max_shift_px": F.least(y, x), "max_shift_um": F.least(y, x) * um})


def rescue_cap(df: DataFrame) -> DataFrame:
    """``rescue_cap_px``: the widest window a failed registration may use, at least the first one."""
    small = F.least("height", "width")
    cap = F.greatest(F.lit(1.0), F.least((F.floor(small / 2) - 1).cast("double"), F.round(small * 0.5)))
    return df.withColumn("rescue_cap_px", F.greatest(cap, F.col("max_shift_px")))


def pegged(df: DataFrame, limit_x: float | None = None, limit_y: float | None = None) -> DataFrame:
    """``is_pegged``: a shift beyond 0.98 of its limit; without limits given, of the recording's own ``max_shift_um_x`` and
    ``max_shift_um_y``, or of ``max_shift_um`` where it has only that."""
    axis = lambda c: F.col(c if c in df.columns else "max_shift_um")
    x = axis("max_shift_um_x") if limit_x is None else F.lit(float(limit_x))
    y = axis("max_shift_um_y") if limit_y is None else F.lit(float(limit_y))
    over = (F.abs("dx_um") > PEG * x) | (F.abs("dy_um") > PEG * y)
    return df.withColumn("is_pegged", F.coalesce(over, F.lit(False)))


def islands(df: DataFrame, flag: str) -> DataFrame:
    """``island``: the same number for the frames of one unbroken run of ``flag``; needs frames without gaps."""
    flagged = Window.partitionBy("recording", F.coalesce(F.col(flag), F.lit(False))).orderBy("frame")
    return df.withColumn("island", F.row_number().over(in_series()) - F.row_number().over(flagged))


def runs(df: DataFrame, flag: str) -> DataFrame:
    """recording, start, end, length and duration_s of the runs of ``flag``."""
    held = islands(df, flag).filter(F.col(flag))
    found = held.groupBy("recording", "island").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("length"), F.first("fps").alias("fps"))
    return found.select("recording", "start", "end", "length", (F.col("length") / F.col("fps")).alias("duration_s"))


def longest_run(df: DataFrame, flag: str) -> DataFrame:
    """recording and longest (0 without a run)."""
    held = islands(df, flag).groupBy("recording", "island", flag).agg(F.count("*").alias("n"))
    return held.groupBy("recording").agg(F.coalesce(F.max(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias("longest"))


def above_mask(df: DataFrame, value: str, threshold: float, min_consec: int) -> DataFrame:
    """``above``: frames in runs of at least ``min_consec`` frames over the threshold."""
    raised = islands(df.withColumn("_over", F.coalesce(F.col(value) > threshold, F.lit(False))), "_over")
    size = F.count("*").over(Window.partitionBy("recording", "_over", "island"))
    return raised.withColumn("above", F.col("_over") & ((size >= min_consec) if min_consec > 1 else F.lit(True))).drop("_over", "island")


def frac_above(df: DataFrame, value: str, threshold: float, min_consec: int) -> DataFrame:
    """recording and frac_above: the share of such frames."""
    return above_mask(df, value, threshold, min_consec).groupBy("recording").agg(share(F.col("above")).alias("frac_above"))


def nan_frac() -> Column:
    return F.avg((F.col("dx_um").isNull() | F.col("dy_um").isNull()).cast("double"))


def flatline() -> Column:
    """Both spreads under the floor; a missing shift makes it false."""
    floor = F.greatest(F.lit(FLAT_UM), FLAT_PX * F.first("px_um"))
    whole = F.count_if(F.col("dx_um").isNull() | F.col("dy_um").isNull()) == 0
    return F.coalesce(whole & (sample_std(F.col("dx_um")) < floor) & (sample_std(F.col("dy_um")) < floor), F.lit(False))


def excursion_um() -> Column:
    return F.greatest(F.max("dx_um") - F.min("dx_um"), F.max("dy_um") - F.min("dy_um"))


def excursion(df: DataFrame, field_um: float, warn: float = 0.25, leave: float = 0.40) -> DataFrame:
    """Greatest range of a recording, its share of the field of view, and the two flags."""
    part = df.groupBy("recording").agg(excursion_um().alias("excursion_um"))
    frac = F.col("excursion_um") / field_um
    return part.select("recording", "excursion_um", frac.alias("excursion_frac"), (frac > warn).alias("boundary_warning"), (frac > leave).alias("boundary_exit"))


def step_stats(df: DataFrame) -> DataFrame:
    """Median, mean, spread, P95, P99, path length and shares of small steps of each recording."""
    step = F.col("step_um")
    got = df.groupBy("recording").agg(
        values_of(step).alias("v"), F.avg(step).alias("mean_step"), sample_std(step).alias("sd_step"), F.sum(step).alias("cum_path"), share(step <= 0.10).alias("below_010"), share(step <= 0.20).alias("below_020")
    )
    return got.select("recording", hazen(F.col("v"), 50).alias("median_step"), "mean_step", "sd_step", hazen(F.col("v"), 95).alias("p95_step"), hazen(F.col("v"), 99).alias("p99_step"), "cum_path", "below_010", "below_020")


def median_window(fps: float, seconds: float = 60) -> int:
    return max(3, 2 * int(seconds * fps / 2) + 1)


def whole_series(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over pandas frames of whole recordings in the order of their frames. A call for each recording would cost more than the
    work on a short one, so Arrow batches of frames, sorted by recording, go to Python as they are, with as many recordings as they
    hold; the last one of a batch waits for the next. A task holds one recording and one batch."""

    def batches(pdfs):
        held: list[pd.DataFrame] = []
        for pdf in pdfs:
            names = pdf["recording"].to_numpy(object)
            if not len(names):
                continue
            before = np.flatnonzero(names != names[-1])
            cut = before[-1] + 1 if len(before) else 0
            if cut or (held and held[-1]["recording"].iloc[-1] != names[-1]):
                yield run(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return df.repartition("recording").sortWithinPartitions("recording", "frame").mapInPandas(batches, schema)


def series_starts(pdf: pd.DataFrame) -> np.ndarray:
    """The first row of each recording in rows sorted by recording."""
    names = pdf["recording"].to_numpy(object)
    return np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])


def moving_medians(values: np.ndarray, starts: np.ndarray, win: int) -> np.ndarray:
    """Moving median of ``win`` values inside each series; series follow each other and begin at ``starts``. One pass of pandas'
    rolling median over all of them, with gaps between two that no window spans."""
    n = np.diff(np.append(starts, len(values)))
    before, after = (min(k, n.max()) for k in (win // 2, win - win // 2 - 1))
    at = np.arange(len(values)) + max(before, after) * np.repeat(np.arange(len(n)), n)
    padded = np.full(at[-1] + 1 + after, np.nan)
    padded[at] = values
    return pd.Series(padded).rolling(before + after + 1, min_periods=1).median().to_numpy()[at + after]


def rolling_median(df: DataFrame, columns: list[str], win: int) -> DataFrame:
    """``<column>_s``: moving median of ``win`` frames, shrinking at both ends, missing values left out.

    A window function would sort the window again at every frame; here each series goes through pandas' rolling median once."""
    ship_package(df.sparkSession)
    schema = df.schema.simpleString()[7:-1] + "".join(f",{c}_s:double" for c in columns)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = series_starts(pdf)
        return pdf.assign(**{f"{c}_s": moving_medians(pdf[c].to_numpy(float), starts, win) for c in columns})

    return whole_series(df, smooth, schema)


def net_drift(df: DataFrame, win: int) -> DataFrame:
    """Distance, rate and angle between the smoothed first and last positions. Only the two half windows at the ends are
    needed, so no series is smoothed. Angles come from the C library, whose last bit SQL has too: Java's differs in a sixth of them, which
    moves an angle over the edge of a sector."""
    ship_package(df.sparkSession)

    @F.pandas_udf("double")
    def angle(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([math.degrees(math.atan2(b, a)) for b, a in zip(y, x, strict=True)], dtype="float64")

    n = F.max("frame").over(Window.partitionBy("recording"))
    first, last = F.col("frame") <= win - win // 2, F.col("frame") >= F.col("n") - win // 2
    at = lambda c, where: F.median(F.when(where, F.col(c)))
    ends = df.withColumn("n", n).groupBy("recording").agg(
        (at("dx_um", last) - at("dx_um", first)).alias("drift_dx"), (at("dy_um", last) - at("dy_um", first)).alias("drift_dy"), ((F.max("n") - 1) / F.greatest(F.lit(1.0), F.max("fps"))).alias("duration_s")
    )
    drift = length(F.col("drift_dx"), F.col("drift_dy"))
    return ends.select("recording", "duration_s", drift.alias("net_drift"), (drift / F.greatest(F.lit(1e-9), "duration_s")).alias("drift_rate"), F.when(drift.isNotNull(), angle("drift_dy", "drift_dx")).alias("drift_angle"))


def settle(df: DataFrame, base: float = 10, least: float = 0.5, part: float = 0.2) -> DataFrame:
    """``settle_min`` and ``post``: whether a frame comes after the settling time."""
    n = F.count("*").over(Window.partitionBy("recording"))
    minutes = (n - 1) / F.greatest(F.lit(1.0), F.col("fps")) / 60
    settle_min = F.least(F.lit(float(base)), F.greatest(F.lit(float(least)), part * minutes))
    frames = F.least(n.cast("double"), F.round(settle_min * 60 * F.col("fps")))
    return df.withColumn("settle_min", settle_min).withColumn("post", F.col("frame") > frames)


def reposition_mask(df: DataFrame, fps: float = 1.0, threshold: float = 2.0, sustain_s: float = 2.0, shift: float = 2.0, around_s: float = 2.0, more_than: int = 10, widen_s: float = 0.5) -> DataFrame:
    """``reposition``: frames of sustained fast steps between two different base positions, widened on both sides.

    ``fps`` is the stage's frame rate. All windows have the recording as key, so nothing is joined or shuffled anew: the
    medians before and after are taken at each frame and read at a run's two ends, and a frame belongs to a widened event
    if a frame of the event lies within the widening of it."""
    reach, wide, sustain = (int(x * fps + 0.5) for x in (around_s, widen_s, sustain_s))
    whole, run = Window.partitionBy("recording"), Window.partitionBy("recording", "_hi", "island")
    raised = islands(df.withColumn("_hi", F.coalesce(F.col("step_um") > threshold, F.lit(False))), "_hi")
    near = lambda c, lo, hi: F.expr(f"percentile({c}, 0.5) over (partition by recording order by frame rows between {lo} and {hi})")
    raised = raised.withColumns({
        "_xa": near("dx_um", f"{reach} preceding", "1 preceding"), "_ya": near("dy_um", f"{reach} preceding", "1 preceding"), "_xb": near("dx_um", "1 following", f"{reach} following"), "_yb": near("dy_um", "1 following", f"{reach} following"),
        "_n": F.max("frame").over(whole), "_s": F.min("frame").over(run), "_e": F.max("frame").over(run),
    })
    at = lambda c, edge: F.max(F.when(F.col("frame") == F.col(edge), F.col(c))).over(run)
    raised = raised.withColumn("_moved", F.hypot(at("_xb", "_e") - at("_xa", "_s"), at("_yb", "_e") - at("_ya", "_s")))
    before = F.greatest(F.lit(1), F.col("_s") - 1) - F.greatest(F.lit(1), F.col("_s") - reach) + 1
    after = F.least(F.col("_e") + reach, "_n") - F.least(F.col("_e") + 1, "_n") + 1
    event = F.col("_hi") & (F.col("_e") - F.col("_s") + 1 >= sustain) & (before > more_than) & (after > more_than) & F.coalesce(F.col("_moved") > shift, F.lit(False))
    around = in_series().rowsBetween(-wide, wide)
    marked = raised.withColumn("_event", event.cast("int")).withColumn("reposition", F.max("_event").over(around) == 1)
    return marked.select(*df.columns, "reposition")


def settled_columns(df: DataFrame, spike: float, min_consec: int) -> DataFrame:
    """``kept`` (settled, no reposition), ``above`` (kept frames in spike runs of the compacted series), and the first and
    last kept frame of the recording as ``lo`` and ``hi``."""
    whole = Window.partitionBy("recording")
    kept = df.withColumn("kept", F.col("post") & ~F.col("reposition")).withColumn("_over", F.coalesce(F.col("step_um") > spike, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("recording", "kept").orderBy("frame")) - F.row_number().over(Window.partitionBy("recording", "kept", "_over").orderBy("frame"))
    size = F.count("*").over(Window.partitionBy("recording", "kept", "_over", "_island"))
    marked = kept.withColumn("_island", place).withColumn("above", F.col("kept") & F.col("_over") & (size >= max(1, min_consec)))
    own = F.when(F.col("kept"), F.col("frame"))
    return marked.withColumns({"lo": F.min(own).over(whole), "hi": F.max(own).over(whole)}).drop("_over", "_island")


def settled_aggregates(win: int) -> list[Column]:
    """The aggregates of ``settled_columns`` by recording; percentiles come from the array ``v_ps``."""
    k = F.col("kept")
    own = lambda c: F.when(k, F.col(c))
    half = win // 2
    at = lambda c, mid: F.median(F.when(F.col("frame").between(F.col(mid) - half, F.col(mid) + win - half - 1), F.col(c)))
    floor = F.greatest(F.lit(FLAT_UM), FLAT_PX * F.first("px_um"))
    gaps = F.count_if(k & (F.col("dx_um").isNull() | F.col("dy_um").isNull()))
    still = F.coalesce((gaps == 0) & (sample_std(own("dx_um")) < floor) & (sample_std(own("dy_um")) < floor), F.lit(False))
    return [
        F.count_if(k).alias("n_post"), values_of(own("step_um")).alias("v_ps"), F.collect_list(F.when(k & F.col("step_um").isNotNull(), F.struct("frame", "step_um"))).alias("path_ps"), F.avg(own("step_um")).alias("mean_step_ps"), F.avg(F.when(k, F.col("is_pegged").cast("double"))).alias("pegged_ps"),
        still.alias("flatline_ps"), F.avg(F.when(k, F.col("above").cast("double"))).alias("spike_frac_ps"), length(at("dx_um", "hi") - at("dx_um", "lo"), at("dy_um", "hi") - at("dy_um", "lo")).alias("net_drift_ps"),
    ]


SETTLED = ("med_step_ps", "mean_step_ps", "p95_step_ps", "p99_step_ps", "cum_path_ps", "net_drift_ps", "drift_rate_ps", "pegged_ps", "flatline_ps", "spike_frac_ps", "jitter_ratio")


def settled_metrics(got: DataFrame) -> DataFrame:
    """The settled metrics from the aggregates, NULL for recordings with fewer than two kept frames; needs ``fps``. The path is
    added in the order of the frames, so recordings with the same steps have the same path and tie in every rank."""
    v = F.col("v_ps")
    path = F.aggregate(F.array_sort("path_ps"), F.lit(0.0), lambda a, x: a + x["step_um"])
    got = got.withColumn("cum_path_ps", F.when(F.size("path_ps") > 0, path)).drop("path_ps")
    duration = (F.col("n_post") - 1) / F.greatest(F.lit(1.0), F.col("fps"))
    wide = got.withColumns({
        "med_step_ps": hazen(v, 50), "p95_step_ps": hazen(v, 95), "p99_step_ps": hazen(v, 99), "drift_rate_ps": F.col("net_drift_ps") / F.greatest(F.lit(1e-9), duration), "jitter_ratio": jitter_ratio("cum_path_ps", "net_drift_ps"),
    })
    return wide.withColumns({c: F.when(F.col("n_post") >= 2, F.col(c)) for c in SETTLED}).drop("v_ps")


def post_settle_stats(df: DataFrame, limit_x: float, limit_y: float, spike: float, min_consec: int, win: int) -> DataFrame:
    """The metrics of the settled, compacted frames; recordings with fewer than two such frames are left out. The drift is
    taken between full windows of the whole series around the first and last kept frame."""
    marked = settled_columns(pegged(df, limit_x, limit_y), spike, min_consec)
    got = settled_metrics(marked.groupBy("recording").agg(F.max("fps").alias("fps"), *settled_aggregates(win)))
    return got.filter("n_post >= 2").select("recording", "n_post", *SETTLED)


def compacted(df: DataFrame) -> DataFrame:
    """Settled frames without repositions, numbered anew from 1; ``frame_was`` keeps the old number."""
    kept = df.filter(F.col("post") & ~F.col("reposition"))
    return kept.withColumnRenamed("frame", "frame_was").withColumn("frame", F.row_number().over(Window.partitionBy("recording").orderBy("frame_was")))


def jitter_ratio(path: str, drift: str, most: float = 1000) -> Column:
    return F.least(F.lit(float(most)), F.col(path) / F.greatest(F.lit(1e-9), F.col(drift)))


def settle_ratio(df: DataFrame, floor: float = 0.02) -> DataFrame:
    """Median step after over before settling; NULL for short recordings or a still start."""
    clean = F.col("post") & ~F.col("reposition")
    got = df.groupBy("recording").agg(
        F.median(F.when(~F.col("post"), F.col("step_um"))).alias("pre"), F.median(F.when(clean, F.col("step_um"))).alias("after"), F.count_if(clean).alias("n_post"),
        ((F.count("*") - 1) / F.greatest(F.lit(1.0), F.max("fps")) / 60).alias("minutes"), F.max("settle_min").alias("settle_min"),
    )
    usable = (F.col("minutes") >= 2 * F.col("settle_min")) & (F.col("n_post") >= 2) & (F.col("pre") >= floor)
    return got.select("recording", F.when(usable, F.col("after") / F.col("pre")).alias("settle_ratio"))


def auto_settle(df: DataFrame, threshold: float, win: int, hold: int) -> DataFrame:
    """Minute at which the moving median of the step first stays under the threshold for ``hold`` frames; NULL if it never does."""
    ship_package(df.sparkSession)

    def first_calm(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = series_starts(pdf)
        calm = moving_medians(pdf["step_um"].to_numpy(float), starts, win) < threshold
        place = np.arange(len(pdf))
        new = np.zeros(len(pdf), bool)
        new[starts] = True
        since = np.maximum.accumulate(np.where(new | ~np.roll(calm, 1), place, 0))  # where the run that a calm frame is in began
        held = np.flatnonzero(calm & (place - since + 1 >= max(1, hold)))
        series, first = np.unique(np.searchsorted(starts, held, "right") - 1, return_index=True)
        minute = np.full(len(starts), np.nan)
        begin = since[held[first]]
        minute[series] = (pdf["frame"].to_numpy(float)[begin] - 1) / (60 * np.maximum.reduceat(pdf["fps"].to_numpy(float), starts)[series])
        return pd.DataFrame({"recording": pdf["recording"].to_numpy(object)[starts], "auto_settle_min": pd.array(minute, dtype="Float64")})

    return whole_series(df.select("recording", "frame", "fps", "step_um"), first_calm, "recording string, auto_settle_min double")


def bursts(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Rising edges over each threshold, and their rate a minute."""
    over = lambda t: F.coalesce(F.col("step_um") > t, F.lit(False))
    marked = df.withColumns({f"e{k}": (over(t) & ~F.lag(over(t)).over(in_series())) for k, t in enumerate(thresholds)})
    got = marked.groupBy("recording").agg(*[F.count_if(f"e{k}").alias(f"n{k}") for k in range(len(thresholds))], F.greatest(F.lit(1e-9), F.count("*") / (60 * F.max("fps"))).alias("minutes"))
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("n_bursts"), (F.col(f"n{k}") / F.col("minutes")).alias("rate_per_min")) for k, t in enumerate(thresholds)])
    return got.select("recording", F.inline(rows))


def welch(x: np.ndarray, fps: float, longest: int = 2048, least: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Welch spectrum with Hamming windows that overlap by half; a plain periodogram if the window is longer
    than the series. ``x`` may hold several series of one length, as rows."""
    x = np.asarray(x, float)
    known = np.isfinite(x).any(-1, keepdims=True)
    mean = np.nanmean(np.where(known, x, 0.0), -1, keepdims=True)
    x = np.where(known, np.nan_to_num(x - mean), 0.0)
    n = x.shape[-1]
    win = min(longest, max(least, n // 4))
    if win > n:
        p = np.abs(np.fft.rfft(x)) ** 2 / n
        return np.arange(p.shape[-1]) * fps / n, p
    nfft = max(256, 1 << (win - 1).bit_length())
    taper = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(win) / (win - 1))
    step = win - win // 2
    parts = np.lib.stride_tricks.sliding_window_view(x, win, axis=-1)[..., ::step, :]
    p = (np.abs(np.fft.rfft(parts * taper, nfft)) ** 2).mean(-2) / (fps * (taper**2).sum())
    p[..., 1 : p.shape[-1] - (nfft % 2 == 0)] *= 2
    return np.arange(p.shape[-1]) * fps / nfft, p


def spectra(df: DataFrame, longest: int = 2048, least: int = 128) -> DataFrame:
    """recording and lines: the spectrum of each recording's steps as an array of k, f and p. Recordings of one length are transformed
    together."""
    ship_package(df.sparkSession)

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = series_starts(pdf)
        n = np.diff(np.append(starts, len(pdf)))
        names, steps, rates = pdf["recording"].to_numpy(object)[starts], pdf["step_um"].to_numpy(float), pdf["fps"].to_numpy(float)[starts]
        out = []
        for size, fps in sorted(set(zip(n.tolist(), rates.tolist(), strict=True))):
            own = np.flatnonzero((n == size) & (rates == fps))
            f, p = welch(steps[starts[own][:, None] + np.arange(size)], fps, longest, least)
            out.append(pd.DataFrame({"recording": names[own], "f": [f] * len(own), "p": list(p)}))
        return pd.concat(out)

    got = whole_series(df.select("recording", "frame", "fps", "step_um"), spectrum, "recording string, f array<double>, p array<double>")
    return got.select("recording", F.transform(F.arrays_zip("f", "p"), lambda x, k: F.struct(k.cast("int").alias("k"), x["f"].alias("f"), x["p"].alias("p"))).alias("lines"))


def psd(df: DataFrame, longest: int = 2048, least: int = 128) -> DataFrame:
    """recording, k, f and p: the spectrum of each recording's steps."""
    return spectra(df, longest, least).select("recording", F.inline("lines"))


def peak_and_bands(lines: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """What ``dominant_peak`` and ``band_power`` find, from ``spectra``: a row holds a recording's lines, so nothing is shuffled or sorted."""
    best = F.array_max(F.transform(F.filter("lines", lambda x: x["f"].between(0.01, 0.5)), lambda x: F.struct(x["p"].alias("p"), (-x["f"]).alias("g"))))
    strips = F.zip_with(F.slice("lines", F.lit(1), F.size("lines") - 1), F.slice("lines", F.lit(2), F.size("lines")), lambda a, b: F.struct(a["f"].alias("f"), b["f"].alias("f2"), ((b["f"] - a["f"]) * (a["p"] + b["p"]) / 2).alias("area")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, s: a + s["area"])
    inside = lambda b: F.filter("s", lambda x: (x["f"] >= b[0]) & (x["f2"] <= b[1]))
    got = lines.filter(F.size("lines") > 0).select("recording", best.alias("b"), strips.alias("s"))
    got = got.select("recording", -F.col("b.g"), F.col("b.p"), total(F.col("s")), *[total(inside(b)) for b in bands.values()])
    got = got.toDF("recording", "dom_f", "dom_p", "all", *[f"a_{k}" for k in bands])
    return got.select("recording", "dom_f", "dom_p", F.when(F.col("dom_f") > 0, 1 / F.col("dom_f") / 60).alias("dom_period_min"), *[F.when(F.col("all") > 0, F.col(f"a_{k}") / F.col("all")).alias(f"frac_{k}") for k in bands])


def dominant_peak(spectra: DataFrame, lo: float = 0.01, hi: float = 0.5) -> DataFrame:
    """Frequency and power of the strongest line in the band, and its period in minutes."""
    best = spectra.filter(F.col("f").between(lo, hi)).groupBy("recording").agg(F.max(F.struct("p", (-F.col("f")).alias("g"))).alias("b"))
    f = -F.col("b.g")
    return best.select("recording", f.alias("dom_f"), F.col("b.p").alias("dom_p"), F.when(f > 0, 1 / f / 60).alias("dom_period_min"))


def band_power(spectra: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of the power, by trapezoids, in each band; NULL without power."""
    line = Window.partitionBy("recording").orderBy("f")
    strips = spectra.withColumns({"f2": F.lead("f").over(line), "p2": F.lead("p").over(line)}).withColumn("area", (F.col("f2") - F.col("f")) * (F.col("p") + F.col("p2")) / 2)
    inside = lambda b: (F.col("f") >= b[0]) & (F.col("f2") <= b[1])
    got = strips.groupBy("recording").agg(F.sum("area").alias("all"), *[F.coalesce(F.sum(F.when(inside(b), F.col("area"))), F.lit(0.0)).alias(f"a_{k}") for k, b in bands.items()])
    return got.select("recording", *[F.when(F.col("all") > 0, F.col(f"a_{k}") / F.col("all")).alias(f"frac_{k}") for k in bands])


def mean_psd(spectra: DataFrame) -> DataFrame:
    """Mean power at each frequency over recordings that share a grid."""
    return spectra.groupBy("f").agg(F.avg("p").alias("mean_p"), F.count("*").alias("n_recordings"))


def resampled(spectra: DataFrame, first: DataFrame) -> DataFrame:
    """``spectra`` at the frequencies of ``first`` (column f), linearly between a recording's own lines and, outside them,
    along the line through its two last ones; NULL for a recording with one line."""
    return resampled_lines(spectra.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("f", "p"))).alias("lines")).filter(F.size("lines") > 0), first)


def resampled_lines(lines: DataFrame, first: DataFrame) -> DataFrame:
    """``resampled`` of recordings whose lines are in an array (f, p and more) in the order of f, each looked up once."""
    ship_package(lines.sparkSession)
    grid = [r["f"] for r in first.select("f").distinct().orderBy("f").collect()]  # half a spectrum's length, 1,025 at most

    @F.pandas_udf("array<double>")
    def at_grid(f: pd.Series, p: pd.Series) -> pd.Series:
        out, x = [], np.array(grid, float)
        for a, b in zip(f, p, strict=True):
            if len(a) < 2:
                out.append([None] * len(x))
                continue
            k = np.clip(np.searchsorted(a, x, "right"), 1, len(a) - 1)  # the number of own lines up to x says which two to draw through
            out.append(b[k - 1] + (x - a[k - 1]) * ((b[k] - b[k - 1]) / (a[k] - a[k - 1])))
        return pd.Series(out)

    got = lines.select("recording", at_grid(F.col("lines")["f"], F.col("lines")["p"]).alias("p"))
    return got.select("recording", F.inline(F.arrays_zip(F.array(*map(F.lit, grid)).cast("array<double>").alias("f"), F.col("p"))).alias("f", "p"))


def per_minute_median(df: DataFrame) -> DataFrame:
    minute = (F.floor((F.col("frame") - 1) / (60 * F.col("fps"))) + 1).cast("int")
    return df.groupBy("recording", "group", minute.alias("minute")).agg(F.median("step_um").alias("median_step"))


def settled_minutes(df: DataFrame) -> DataFrame:
    """Medians by minute of the settled frames alone, numbered anew, of the recordings of each group whose usual duration
    (median) is at least twice the settling time; ``df`` has post, reposition and settle_min."""
    clean = compacted(df)
    length = df.groupBy("recording", "group").agg(((F.count("*") - 1) / F.greatest(F.lit(1.0), F.max("fps")) / 60).alias("minutes"), F.max("settle_min").alias("settle_min"))
    usual = length.groupBy("group").agg(F.median("minutes").alias("minutes"), F.median("settle_min").alias("settle_min")).filter(F.col("minutes") >= 2 * F.col("settle_min")).select("group")
    enough = clean.groupBy("recording").agg(F.count("*").alias("n")).filter("n >= 2").select("recording")
    return per_minute_median(clean.join(usual, "group", "left_semi").join(enough, "recording", "left_semi"))


def group_timecourse(minutes: DataFrame) -> DataFrame:
    """For every minute up to the group's last: active recordings, mean and standard error of their medians."""
    last = minutes.groupBy("group").agg(F.max("minute").alias("last")).select("group", F.explode(F.sequence(F.lit(1), "last")).alias("minute"))
    got = minutes.groupBy("group", "minute").agg(F.count("median_step").alias("n_active"), F.avg("median_step").alias("mean_um"), (sample_std(F.col("median_step")) / F.sqrt(F.count("median_step").cast("double"))).alias("sem_um"))
    return last.join(got, ["group", "minute"], "left").select("group", "minute", F.coalesce("n_active", F.lit(0)).alias("n_active"), "mean_um", "sem_um")


def fixed_histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """Count of values in bins of a fixed width."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def angle_histogram(df: DataFrame, column: str, sectors: int = 12) -> DataFrame:
    """Probability of an angle in degrees in each sector; sectors without one are left out. A whole turn is added to every angle, not
    just to negative ones, so one that misses the edge of a sector by a rounding error is taken to be on it."""
    turned = (F.col(column) % 360.0 + 360.0) % 360.0
    sector = F.floor(turned / (360 / sectors)).cast("int") % sectors
    counted = df.filter(F.col(column).isNotNull()).groupBy(sector.alias("sector")).agg(F.count("*").alias("n"))
    return counted.select("sector", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("probability"))  # at most ``sectors`` rows
