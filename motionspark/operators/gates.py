"""Quality gates and tables of recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.functions.stats import sample_std
from motionspark.operators import series


@dataclass(frozen=True)
class QcConfig:
    """Limits of the gates; the defaults are those of calcium recordings."""

    max_nan: float = 0.05
    max_pegged: float = 0.20
    good_step_um: float = 0.30
    max_spikes: float = 0.01
    field_um: float = 266.0
    boundary_warning: float = 0.25
    boundary_exit: float = 0.40
    limit_x_um: float = 106.4
    limit_y_um: float = 106.4
    spike_um: float = 0.09
    spike_frames: int = 6
    settle_base_min: float = 10.0
    settle_least_min: float = 0.5
    settle_part: float = 0.2
    median_frames: int = 2001
    peg_run_frames: int = 10


def reasons(pairs: list[tuple[str, Column]], otherwise: str) -> Column:
    """The names whose condition holds, comma-joined; ``otherwise`` if none does."""
    held = F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), name) for name, c in pairs])
    return F.when(held == "", otherwise).otherwise(held)


def recording_metrics(frames: DataFrame, cfg: QcConfig) -> DataFrame:
    """One row a recording with what the gates need; frames have step_um, post and reposition. One aggregation over the
    frames, which windows by recording have dealt already, gives the metrics of the whole series and of its settled part."""
    marked = series.settled_columns(series.pegged(frames, cfg.limit_x_um, cfg.limit_y_um), cfg.spike_um, cfg.spike_frames)
    whole = marked.groupBy("recording", "group").agg(
        F.count("*").alias("n_frames"), F.max("fps").alias("fps"), series.nan_frac().alias("nan_frac"), F.avg(F.col("is_pegged").cast("double")).alias("pegged"), series.flatline().alias("flatline"),
        series.excursion_um().alias("excursion_um"), F.median("step_um").alias("median_step"), F.sum("step_um").alias("cum_path"), (F.count_if(~F.col("post")) + 1).alias("post_start_frame"), *series.settled_aggregates(cfg.median_frames),
    )
    return series.settled_metrics(whole)


def dual_qc(metrics: DataFrame, cfg: QcConfig, unstable: Column | None = None) -> DataFrame:
    """MOVEMENT_VALID, ROI_ELIGIBLE, their reasons, the health flags and MotionQuality."""
    unstable = F.lit(False) if unstable is None else F.coalesce(unstable, F.lit(False))
    frac = F.col("excursion_um") / cfg.field_um
    nan, ceiling, exited = F.col("nan_frac") >= cfg.max_nan, F.col("pegged") >= cfg.max_pegged, F.coalesce(frac > cfg.boundary_exit, F.lit(False))
    tracking = [("nan_frac_high", nan), ("tracking_ceiling", ceiling), ("unstable_tracking", unstable), ("flatline_suspicious", F.col("flatline"))]
    valid = ~(nan | ceiling | unstable | F.col("flatline"))
    health = F.when(unstable, "UNSTABLE_TRACKING").when(F.col("flatline"), "FLATLINE").when(nan, "NAN_EXCESS").when(ceiling, "TRACKING_CEILING").otherwise("OK")
    return metrics.withColumns({
        "excursion_frac": frac, "movement_valid": valid, "movement_reason": reasons(tracking, "TRACKING_OK"), "roi_eligible": valid & ~exited, "roi_reason": reasons([*tracking, ("boundary_exit", exited)], "ELIGIBLE"),
        "movement_health": health, "roi_health": F.when(valid & exited, "BOUNDARY_EXIT").otherwise(health),
        "motion_quality": F.when(F.col("med_step_ps") >= cfg.good_step_um, "HIGH_MOTION").when(F.col("spike_frac_ps") >= cfg.max_spikes, "SPIKY").otherwise("GOOD"),
    })


def movement_qc(metrics: DataFrame, cfg: QcConfig, longest: DataFrame, unstable: Column | None = None) -> DataFrame:
    """QC_PASS with its reason, QC_soft_still and HealthFlag; ``longest`` has the longest pegged run of each recording."""
    unstable = F.lit(False) if unstable is None else F.coalesce(unstable, F.lit(False))
    joined = metrics.join(longest.withColumnRenamed("longest", "max_pegged_run"), "recording", "left")
    peg, run, nan = F.col("pegged") >= cfg.max_pegged, F.coalesce("max_pegged_run", F.lit(0)) >= cfg.peg_run_frames, F.col("nan_frac") >= cfg.max_nan
    failed = [("pegged_frac", peg), ("ceiling_run", run), ("nan_frac", nan), ("flatline", F.col("flatline")), ("unstable_tracking", unstable)]
    return joined.withColumns({
        "qc_pass": ~(peg | run | nan | F.col("flatline") | unstable), "qc_reason": reasons(failed, "OK"),
        "qc_soft_still": F.coalesce((F.col("med_step_ps") < cfg.good_step_um) & (F.col("spike_frac_ps") < cfg.max_spikes), F.lit(False)),
        "health": F.when(unstable, "UNSTABLE_TRACKING").when(F.col("flatline"), "FLATLINE").when(nan, "NAN_EXCESS").when(run, "CEILING_RUN").when(peg, "PEGGED").otherwise("OK"),
    })


#: Columns of the tables of a recording and what they hold; all start with File and n_frames.
BASIC = {
    "MedianDisp_um": "median_step", "Pct95Disp_um": "p95_step", "CumPath_um": "cum_path", "NetDrift_um": "net_drift", "DriftRate_um_per_s": "drift_rate", "Pegged_frac": "pegged", "Flatline_flag": "flatline",
    "MedianDisp_postSettle_um": "med_step_ps", "Pct95Disp_postSettle_um": "p95_step_ps", "CumPath_postSettle_um": "cum_path_ps", "NetDrift_postSettle_um": "net_drift_ps", "DriftRate_postSettle_um_per_s": "drift_rate_ps",
    "Pegged_postSettle_frac": "pegged_ps", "Flatline_postSettle_flag": "flatline_ps", "fps_used": "fps", "px_um": "px_um", "max_shift_um": "max_shift_um", "settle_min": "settle_min",
}
QC = {
    "MedianDisp_preSettle_um": "med_step_pre", "SettleRatio_post_over_pre": "settle_ratio", "SPIKE": "spike_frac_ps", "JitterRatio_post_cumPath_over_netDrift": "jitter_ratio", "nan_frac": "nan_frac", "rescue_count": "rescue_count",
    "unstable_tracking": "unstable_tracking", "Excursion_max_um": "excursion_um", "Excursion_frac_FOV": "excursion_frac", "Boundary_warning": "boundary_warning", "Boundary_exit": "boundary_exit", "MOVEMENT_VALID": "movement_valid",
    "Movement_QC_reason": "movement_reason", "Movement_HealthFlag": "movement_health", "ROI_ELIGIBLE": "roi_eligible", "ROI_QC_reason": "roi_reason", "ROI_HealthFlag": "roi_health", "MotionQuality": "motion_quality",
}
ENRICHED = {
    "MeanStep_um": "mean_step", "SDStep_um": "sd_step", "P99Step_um": "p99_step", "MeanStep_postSettle_um": "mean_step_ps", "P99Step_postSettle_um": "p99_step_ps", "PctTime_step_le_0p10um": "below_010", "PctTime_step_le_0p20um": "below_020",
    "DriftAngle_deg": "drift_angle", "AutoSettle_min": "auto_settle_min", "Bursts_post_0p2um": "n_bursts_0", "Rate_post_0p2um_per_min": "burst_rate_0", "Bursts_post_0p5um": "n_bursts_1", "Rate_post_0p5um_per_min": "burst_rate_1",
    "Bursts_post_1p0um": "n_bursts_2", "Rate_post_1p0um_per_min": "burst_rate_2", "PSD_DominantFreq_Hz": "dom_f", "PSD_DominantPeriod_min": "dom_period_min", "PSD_DominantPower": "dom_p", "PSD_FracLow": "frac_low",
    "PSD_FracMid": "frac_mid", "PSD_FracHigh": "frac_high", "MedianStep_um": "median_step", "MedianStep_postSettle_um": "med_step_ps", "CumPath_um": "cum_path", "CumPath_postSettle_um": "cum_path_ps", "Pegged_frac": "pegged",
    "Pegged_postSettle_frac": "pegged_ps", "SPIKE": "spike_frac_ps", "JitterRatio_post_cumPath_over_netDrift": "jitter_ratio", "Excursion_max_um": "excursion_um", "Excursion_frac_FOV": "excursion_frac", "MOVEMENT_VALID": "movement_valid",
    "Movement_HealthFlag": "movement_health", "ROI_ELIGIBLE": "roi_eligible", "ROI_HealthFlag": "roi_health", "rescue_count": "rescue_count", "unstable_tracking": "unstable_tracking",
}
BURSTS = (0.2, 0.5, 1.0)
BANDS = {"low": (0.0, 0.02), "mid": (0.02, 0.1), "high": (0.1, 0.5)}


#: What the tables of the movement stage hold beside ``BASIC``.
MOVEMENT_QC = {
    "MedianDisp_preSettle_um": "med_step_pre", "SettleRatio_post_over_pre": "settle_ratio", "SPIKE": "spike_frac_ps", "JitterRatio_post_cumPath_over_netDrift": "jitter_ratio", "QC_PASS": "qc_pass", "TailLength_min": "tail_length_min",
    "AutoSettle_min": "auto_settle_min", "QC_PASS_tracking": "qc_pass", "QC_soft_still": "qc_soft_still", "QC_reason": "qc_reason", "HealthFlag": "health", "nan_frac": "nan_frac", "rescue_count": "rescue_count", "unstable_tracking": "unstable_tracking",
}
MOVEMENT_ENRICHED = {k: v for k, v in ENRICHED.items() if not k.startswith(("Excursion", "MOVEMENT", "Movement", "ROI"))} | {
    "DriftSpeed_um_s": "drift_rate", "QC_PASS": "qc_pass", "TailStart_min": "settle_min", "TailLength_min": "tail_length_min", "QC_PASS_tracking": "qc_pass", "QC_soft_still": "qc_soft_still", "HealthFlag": "health", "nan_frac": "nan_frac",
    "rescue_count": "rescue_count", "unstable_tracking": "unstable_tracking",
}


def movement_bands(fps: float) -> dict[str, tuple[float, float]]:
    """Low, middle and high frequencies of the movement stage, whose bounds come from the frame rate."""
    top = fps / 2
    low, mid = min(0.05, 0.2 * top), min(0.2, 0.8 * top)
    return {"low": (0.01, low), "mid": (low, mid), "high": (mid, top)}


def movement_record(frames: DataFrame, cfg: QcConfig, fps: float = 1.0, calm_win: int | None = None, calm_hold: int | None = None) -> DataFrame:
    """One row a recording with all that the tables of the movement stage hold. Nothing settles in that stage: the whole recording is its
    tail, so what is named after settling is of all frames, and the ratio over the time before is NULL. ``frames`` have step_um;
    those of ``calm_um`` and less for ``calm_hold`` frames (3 minutes) tell the minute from which a recording is still."""
    whole = frames.withColumns({"post": F.lit(True), "reposition": F.lit(False), "settle_min": F.lit(0.0)})
    longest = series.longest_run(series.pegged(whole, cfg.limit_x_um, cfg.limit_y_um), "is_pegged")
    judged = movement_qc(recording_metrics(whole, cfg), cfg, longest)
    tail = (F.col("n_frames") - 1) / F.greatest(F.lit(1.0), F.col("fps")) / 60
    win, hold = calm_win or round(60 * fps), calm_hold or round(180 * fps)
    return full_record(whole, judged, cfg, cfg.good_step_um, win, hold, series.spectra(whole, 128, 16), movement_bands(fps)).withColumn("tail_length_min", tail)


def movement_tables(record: DataFrame, spike_um_per_s: float = 0.5) -> dict[str, DataFrame]:
    """The basic, qc and enriched tables of the movement stage, from ``movement_record``."""
    named = lambda columns: [F.col(c).alias(spike_header(spike_um_per_s) if n == "SPIKE" else n) for n, c in columns.items()]
    first = [F.concat("recording", F.lit(".avi")).alias("File"), F.col("n_frames")]
    return {"basic": record.select(*first, *named(BASIC)), "qc": record.select(*first, *named(BASIC | MOVEMENT_QC)), "enriched": record.select(*first, *named(MOVEMENT_ENRICHED))}


def movement_summary(record: DataFrame) -> DataFrame:
    """Counts, pass rates and the spread of the main metrics over the recordings of each group of the movement stage."""
    n, passed = F.count("*"), F.count_if("qc_pass")
    return record.groupBy("group").agg(
        n.alias("n_files"), passed.alias("n_pass"), (passed / n).alias("pass_rate"), passed.alias("n_pass_tracking"), F.count_if("qc_soft_still").alias("n_soft_still"), F.avg("med_step_ps").alias("mean_MedianDisp_post_um"),
        sample_std(F.col("med_step_ps")).alias("sd_MedianDisp_post_um"), F.avg("settle_ratio").alias("mean_SettleRatio"), sample_std(F.col("settle_ratio")).alias("sd_SettleRatio"), F.avg("auto_settle_min").alias("mean_AutoSettle_min"),
        F.avg("tail_length_min").alias("mean_TailLength_min"),
    )


def full_record(
    frames: DataFrame, judged: DataFrame, cfg: QcConfig, calm_um: float = 0.30, calm_win: int = 61, calm_hold: int = 60, spectra: DataFrame | None = None, bands: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``judged`` with all that the tables hold; ``frames`` as for ``recording_metrics``, ``spectra`` as of ``series.spectra``. Everything is
    grouped by recording, so the parts meet without moving frames again."""
    spectra = series.spectra(frames) if spectra is None else spectra
    pre = frames.groupBy("recording").agg(F.median(F.when(~F.col("post"), F.col("step_um"))).alias("med_step_pre"), F.max("px_um").alias("px_um"), F.max("settle_min").alias("settle_min"))
    counts = series.bursts(series.compacted(frames), list(BURSTS))
    place = F.coalesce(*[F.when(F.col("threshold") == t, k) for k, t in enumerate(BURSTS)])
    bursts = counts.groupBy("recording").agg(*[F.max(F.when(place == k, F.col(c))).alias(f"{n}_{k}") for k in range(len(BURSTS)) for c, n in (("n_bursts", "n_bursts"), ("rate_per_min", "burst_rate"))])
    parts = [
        series.step_stats(frames).drop("median_step", "cum_path"), series.net_drift(frames, cfg.median_frames).drop("duration_s"), pre, series.settle_ratio(frames), series.auto_settle(frames, calm_um, calm_win, calm_hold), bursts,
        series.peak_and_bands(spectra, bands or BANDS), series.excursion(frames, cfg.field_um, cfg.boundary_warning, cfg.boundary_exit).select("recording", "boundary_warning", "boundary_exit"),
    ]
    got = judged.drop("settle_min", "px_um")
    for part in parts:
        got = got.join(part, "recording", "left")
    own = {c: F.lit(v) for c, v in (("rescue_count", 0), ("unstable_tracking", False), ("max_shift_um", max(cfg.limit_x_um, cfg.limit_y_um))) if c not in got.columns}
    return got.withColumns(own)


def spike_header(spike_um_per_s: float) -> str:
    """The name of the column of spikes, which holds their limit."""
    return f"SpikeFrac_postSettle_over_{spike_um_per_s:.3g}um_per_s".replace(".", "p")


def motion_tables(judged: DataFrame, spike_um_per_s: float = 3.0) -> dict[str, DataFrame]:
    """The basic, qc and enriched tables of judged recordings; with ``full_record`` every column is there, without it those
    that ``judged`` has no value for are left out."""
    has = set(judged.columns)
    named = lambda columns: [F.col(c).alias(spike_header(spike_um_per_s) if n == "SPIKE" else n) for n, c in columns.items() if c in has]
    first = [F.concat("recording", F.lit(".avi")).alias("File"), F.col("n_frames")]
    return {"basic": judged.select(*first, F.col("group").alias("Group"), *named(BASIC)), "qc": judged.select(*first, *named(BASIC | QC)), "enriched": judged.select(*first, *named(ENRICHED))}


def group_summary(judged: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """Counts, pass rates, boundary exits and the spread of the main metrics over the recordings of each group."""
    cfg = cfg or QcConfig()
    n, left = F.count("*"), F.coalesce(F.col("excursion_frac") > cfg.boundary_exit, F.lit(False))
    extra = [F.avg("rescue_count").alias("mean_rescue_count")] if "rescue_count" in judged.columns else []
    extra += [F.avg(F.col("unstable_tracking").cast("double")).alias("frac_unstable")] if "unstable_tracking" in judged.columns else []
    return judged.groupBy("group").agg(
        n.alias("n_files"), F.count_if("movement_valid").alias("n_movement_valid"), (F.count_if("movement_valid") / n).alias("movement_valid_rate"), F.count_if("roi_eligible").alias("n_roi_eligible"),
        (F.count_if("roi_eligible") / n).alias("roi_eligible_rate"), F.count_if(left).alias("n_boundary_exit"), F.avg("med_step_ps").alias("mean_median_step_ps"), sample_std(F.col("med_step_ps")).alias("sd_median_step_ps"),
        F.avg("excursion_frac").alias("mean_excursion_frac"), F.max("excursion_frac").alias("max_excursion_frac"), F.avg("pegged").alias("mean_pegged"), *extra,
    )


def roi_candidates(judged: DataFrame) -> DataFrame:
    """Hand-off rows for the search of regions."""
    return judged.select(
        F.col("group").alias("Group"), F.col("recording").alias("Stem"), F.concat("recording", F.lit(".avi")).alias("AVI"), F.col("movement_valid").alias("MOVEMENT_VALID"), F.col("movement_reason").alias("Movement_QC_reason"),
        F.col("roi_eligible").alias("ROI_ELIGIBLE"), F.col("roi_reason").alias("ROI_QC_reason"), F.col("excursion_frac").alias("Excursion_frac_FOV"), F.col("post_start_frame").alias("PostSettleStartFrame"), "n_frames",
        *[F.col(c).alias(n) for c, n in (("fps", "fps_used"), ("px_um", "px_um")) if c in judged.columns],
    )


def candidate_list(candidates: DataFrame, gate: str = "ROI_ELIGIBLE") -> DataFrame:
    """The names of the recordings that passed a gate, as the list file holds them."""
    return candidates.filter(gate).select("Stem")


def sort_by_status(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("ROI_ELIGIBLE"), F.desc("MOVEMENT_VALID"), "Stem")
