"""Result tables: what the analyses hand over, one function a table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionspark.functions import special
from motionspark.functions.stats import sample_std
from motionspark.operators import groups, series, traces
from motionspark.runtime import checkpointed, ship_package

# ---- inputs ------------------------------------------------------------------------------------------------------


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Movie frames stored as Parquet, with the columns of ``operators.movies``. Pixels keep the type that they are stored in, for frames are
    shuffled as they are; NumPy widens them where they are used."""
    return spark.read.parquet(path).select(F.col("recording").cast("string").alias("recording"), F.col("frame").cast("int").alias("frame"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """Regions stored as Parquet, whatever optional columns they have; ``fps`` and ``event_count`` are NULL where the file
    has none."""
    rois = spark.read.parquet(path)
    missing = {c: F.lit(None).cast(t) for c, t in (("fps", "double"), ("event_count", "int"), ("dff", "array<double>")) if c not in rois.columns}
    return rois.withColumns(missing).withColumns({"recording": F.col("recording").cast("string"), "roi_id": F.col("roi_id").cast("long")})


# ---- motion ------------------------------------------------------------------------------------------------------


def motion_summary(frames: DataFrame, win: int, settle_frames: int) -> DataFrame:
    """Median step and path of each recording, its median step after a fixed settling time, and its net drift; nothing is
    cleaned of repositions."""
    late = frames.groupBy("recording").agg(F.median(F.when(F.col("frame") > settle_frames, F.col("step_um"))).alias("median_step_late"))
    return series.step_stats(frames).join(series.net_drift(frames, win), "recording").join(late, "recording")


def select_pass(judged: DataFrame, gate: str = "movement_valid") -> DataFrame:
    """Rows of the recordings that passed a gate."""
    return judged.join(judged.filter(gate).select("recording").distinct(), "recording", "left_semi")


METRICS = ("net_drift", "drift_rate", "drift_angle", "median_step", "path", "jitter_ratio", "duration_s", "mean_speed")


def per_file_metrics(judged: DataFrame, drift: DataFrame) -> DataFrame:
    """The eight metrics of each recording that passed. Of each metric the first column that the tables have counts, values after
    settling first; a value that is missing in it stays missing, so kinds of values are never mixed. Where no recording of a
    group has a jitter ratio it is path over drift; where none has a duration (``duration_ps_s`` or ``duration_s`` of ``judged``)
    it is drift over drift rate. Mean speed is jitter ratio times drift rate."""
    both = select_pass(judged)
    both = both.join(drift.select("recording", *[c for c in ("net_drift", "drift_rate", "drift_angle") if c not in both.columns]), "recording", "left")
    first = lambda *names: next((F.col(c) for c in names if c in both.columns), F.lit(None)).cast("double")
    got = both.select(
        F.concat("recording", F.lit(".avi")).alias("File"), F.col("group").alias("Group"), first("net_drift_ps", "net_drift").alias("net_drift"), first("drift_rate_ps", "drift_rate").alias("drift_rate"), "drift_angle",
        first("med_step_ps", "median_step").alias("median_step"), first("cum_path_ps", "cum_path").alias("path"), first("jitter_ratio").alias("jitter_ratio"), first("duration_ps_s", "duration_s").alias("duration_s"),
    )
    none = lambda c: F.count(c).over(Window.partitionBy("Group")) == 0
    ratio, time = F.col("path") / F.greatest(F.col("net_drift"), F.lit(1e-12)), F.when(F.col("drift_rate") > 1e-12, F.col("net_drift") / F.col("drift_rate"))
    got = got.withColumns({"jitter_ratio": F.when(none("jitter_ratio"), ratio).otherwise(F.col("jitter_ratio")), "duration_s": F.when(none("duration_s"), time).otherwise(F.col("duration_s"))})
    return got.withColumn("mean_speed", F.col("jitter_ratio") * F.col("drift_rate"))


def windowed_metrics(frames: DataFrame, lo: float, hi: float, least: int = 10) -> DataFrame:
    """The same metrics, computed anew from the frames with ``lo`` <= time_min <= ``hi``; recordings with fewer than
    ``least`` such frames are left out. Drift is taken between medians of up to a minute at both ends."""
    inside = frames.filter(F.col("time_min").between(lo, hi)).withColumn("frame", F.row_number().over(series.in_series()))
    inside = series.step_size(inside)
    steps = inside.groupBy("recording").agg(F.count("*").alias("n"), F.median("step_um").alias("median_step"), F.coalesce(F.sum("step_um"), F.lit(0.0)).alias("path"), F.first("fps").alias("fps"))
    fps = F.greatest(F.lit(1.0), F.col("fps"))
    half = F.floor(60 * F.col("fps") / 2)
    ends = inside.withColumn("_n", F.count("*").over(Window.partitionBy("recording")))
    at = lambda c, end: F.median(F.when((F.col("frame") >= F.col("_n") - half) if end else (F.col("frame") <= 1 + half), F.col(c)))
    gap = ends.groupBy("recording").agg((at("dx_um", True) - at("dx_um", False)).alias("x"), (at("dy_um", True) - at("dy_um", False)).alias("y"))
    drift = F.hypot("x", "y")
    got = steps.filter(F.col("n") >= least).join(gap, "recording").withColumns({"net_drift": drift, "duration_s": (F.col("n") - 1) / fps, "drift_angle": F.degrees(F.atan2("y", "x"))})
    least_s = F.greatest(F.lit(1e-9), F.col("duration_s"))
    got = got.withColumns({"drift_rate": F.col("net_drift") / least_s, "jitter_ratio": F.col("path") / F.greatest(F.lit(1e-9), F.col("net_drift")), "mean_speed": F.col("path") / least_s})
    return got.select("recording", "n", *METRICS)


def union_groups(control: DataFrame, experimental: DataFrame, label: str = "label") -> DataFrame:
    return control.withColumn(label, F.lit("control")).unionByName(experimental.withColumn(label, F.lit("experimental")))


def sample_size_warnings(sizes: DataFrame, control: str = "a", experimental: str = "b", least: int = 10) -> DataFrame:
    """``sizes`` (counts of two groups) with ``warnings``, joined by semicolons."""
    a, b = F.col(control), F.col(experimental)
    warn = [
        ("CRITICAL: control", a < 3), ("CRITICAL: experimental", b < 3), ("CAUTION: control", (a >= 3) & (a < least)), ("CAUTION: experimental", (b >= 3) & (b < least)),
        ("IMBALANCE", (a > 0) & (b > 0) & (F.greatest(a, b) > 3 * F.least(a, b))),
    ]
    return sizes.withColumn("warnings", F.concat_ws(";", *[F.when(c, w) for w, c in warn]))


def duration_warnings(per_file: DataFrame, most_cv: float = 20, most_gap: float = 25) -> DataFrame:
    """Spread of the durations within each group and whether it, or the gap of the groups' means, is too large (percent)."""
    x = lambda g: F.when(F.col("Group") == g, F.col("duration_s"))
    cv = lambda g: F.stddev_samp(x(g)) / F.avg(x(g)) * 100
    got = per_file.agg(cv("control").alias("cv_control"), cv("experimental").alias("cv_experimental"), F.avg(x("control")).alias("mc"), F.avg(x("experimental")).alias("me"))
    gap = F.abs(F.col("mc") - F.col("me")) / ((F.col("mc") + F.col("me")) / 2) * 100
    flag = lambda c: F.coalesce(c, F.lit(False))
    return got.select("cv_control", "cv_experimental", flag(F.col("cv_control") > most_cv).alias("warn_control"), flag(F.col("cv_experimental") > most_cv).alias("warn_experimental"), flag(gap > most_gap).alias("mismatch"))


def effect_order(moments: DataFrame) -> DataFrame:
    """Metrics by the size of the difference of means, largest first; there are a few metrics."""
    m = moments.select("metric", (F.col("m2") - F.col("m1")).alias("diff"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("diff")), "metric")))


#: Parts of the names of metrics of which less is better.
LOWER_IS_BETTER = ("speed", "step", "jitter", "drift", "distance", "displacement")


def conclusions(compared: DataFrame) -> DataFrame:
    """Of each metric of ``compared`` (m1, m2, g and, if there, ci_low, ci_high and q): change in percent, direction, size
    of the effect, whether the interval leaves out zero and whether the corrected p is significant."""
    gap, size = F.col("m2") - F.col("m1"), F.abs("g")
    has = set(compared.columns)
    outside = (F.col("ci_low") > 0) | (F.col("ci_high") < 0) if {"ci_low", "ci_high"} <= has else F.lit(None).cast("boolean")
    significant = F.coalesce(F.col("q") < 0.05, F.lit(False)) if "q" in has else F.lit(None).cast("boolean")
    return compared.select(
        "metric", F.when(F.abs("m1") > 1e-12, 100 * gap / F.abs("m1")).alias("pct_change"), F.when(gap > 0, "increase").when(gap < 0, "decrease").otherwise("none").alias("direction"),
        F.when(size >= 0.8, "large").when(size >= 0.5, "medium").when(size >= 0.2, "small").otherwise("none").alias("effect_size"), (size >= 0.2).alias("notable"), outside.alias("ci_excludes_zero"), significant.alias("significant"),
    )


def conclusion_counts(concluded: DataFrame) -> DataFrame:
    """One row: significant metrics, effects by size, and the mean reduction of metrics of which less is better."""
    lower = reduce(lambda a, b: a | b, [F.lower("metric").contains(k) for k in LOWER_IS_BETTER])
    n = lambda k: F.count_if(F.col("effect_size") == k).alias(f"n_{k}")
    return concluded.agg(F.count_if("significant").alias("n_significant"), n("large"), n("medium"), n("small"), F.avg(F.when(lower & (F.col("pct_change") < 0), -F.col("pct_change"))).alias("mean_reduction"))


def compare_groups(long: DataFrame, first: str, second: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row a metric: both groups' description, differences, Welch's t, ranks, normality, effect, resampling and the
    corrected permutation p, with the labels and numbers of the run."""
    long = checkpointed(long)
    m, per = groups.moments(long, first, second), groups.sample_means(long)
    described, normality = groups.describe(long), checkpointed(groups.lilliefors(long))

    def side(name: str, k: int) -> DataFrame:
        return described.filter(F.col("condition") == name).select("metric", *[F.col(c).alias(f"{c}{k}") for c in ("median", "sd", "sem", "iqr")])

    def normal(name: str, k: int) -> DataFrame:
        return normality.filter(F.col("condition") == name).select("metric", (~F.col("rejected")).alias(f"normal{k}"))

    parts = [
        side(first, 1), side(second, 2), groups.welch_t(m), groups.mann_whitney(groups.rank_sums(long, first, second), groups.exact_if_small).select("metric", "u", F.col("p").alias("p_rank")), groups.hedges_g(m),
        groups.bootstrap_mean_diff(per, first, second, replicates, seed), groups.permutation_test(per, first, second, replicates, seed),
    ]
    got = reduce(lambda a, b: a.join(b, "metric"), parts, m)
    got = reduce(lambda a, b: a.join(b, "metric", "left"), [normal(first, 1), normal(second, 2)], got)
    got = got.withColumns({"mean_diff": F.col("m2") - F.col("m1"), "median_diff": F.col("median2") - F.col("median1"), "label1": F.lit(first), "label2": F.lit(second), "replicates": F.lit(replicates), "seed": F.lit(seed)})
    return groups.fdr_bh(got, "p_permutation")


def timecourse_overlay(minutes: DataFrame) -> DataFrame:
    """Mean and band of one standard error of each group and minute."""
    t = series.group_timecourse(minutes)
    return t.withColumns({"low": F.col("mean_um") - F.col("sem_um"), "high": F.col("mean_um") + F.col("sem_um")})


# ---- regions and samples -----------------------------------------------------------------------------------------

LEVELS = {1: "strict", 2: "medium", 3: "relaxed", 4: "pnr_only", 5: "mean_fallback", 6: "std_fallback"}


def level_name(level: Column) -> Column:
    """The name of a level of detection."""
    return F.coalesce(*[F.when(level == k, n) for k, n in LEVELS.items()], F.lit("unknown"))


def roi_metrics(measured: DataFrame, stats: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """One row a region: its place, quality, events, statistics of its trace and, where known, its shape and level."""
    keys = ["recording", "roi_id"]
    own = [c for c in ("center_x", "center_y", "snr", "event_count", "event_rate", "event_amplitude", "level") if c in measured.columns]
    got = measured.select(*keys, *own).join(stats, keys)
    got = got.join(shapes, keys, "left") if shapes is not None else got
    return got.withColumn("level", level_name(F.col("level"))) if "level" in own else got


def pipeline_summary(measured: DataFrame, synchrony: DataFrame | None = None, best: int = 6, recordings: DataFrame | None = None) -> DataFrame:
    """One row a recording: number of regions, mean quality, event rate and amplitude, synchrony, and the mean quality of
    its ``best`` regions. With ``recordings`` all of these have a row: one without regions has means of 0 and no synchrony."""
    place = F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("snr"), "roi_id"))
    mean = lambda c: F.avg(c) if c in measured.columns else F.lit(None).cast("double")
    got = measured.withColumn("_k", place).groupBy("recording").agg(
        F.count("*").alias("n_rois"), F.avg("snr").alias("mean_snr"), mean("event_rate").alias("mean_event_rate"), mean("event_amplitude").alias("mean_event_amplitude"), F.avg(F.when(F.col("_k") <= best, F.col("snr"))).alias(f"top{best}_snr")
    )
    got = got.join(synchrony.select("recording", "synchrony"), "recording", "left") if synchrony is not None else got
    if recordings is None:
        return got
    zero = [F.coalesce(c, F.lit(0)).alias(c) if c in ("n_rois", "mean_snr", "mean_event_rate", "mean_event_amplitude") else F.when(F.col("n_rois") > 0, F.col(c)).alias(c) for c in got.columns if c != "recording"]
    return recordings.join(got, "recording", "left").select(*recordings.columns, *zero)


def condition_summary(summary: DataFrame) -> DataFrame:
    """``summary`` (one row a recording, with its condition) by condition."""
    return summary.groupBy("condition").agg(
        F.count("*").alias("n_files"), F.sum("n_rois").alias("total_rois"), F.avg("n_rois").alias("mean_rois"), sample_std(F.col("n_rois")).alias("sd_rois"), F.avg("mean_snr").alias("mean_snr"), F.avg("mean_event_rate").alias("mean_event_rate")
    )


def level_counts(rois: DataFrame) -> DataFrame:
    """Regions of each recording by the level that found them."""
    return rois.groupBy("recording").agg(*[F.count_distinct(F.when(F.col("level") == k, F.col("roi_id"))).alias(f"n_{n}") for k, n in LEVELS.items()])


def sample_metrics(recordings: DataFrame, rois: DataFrame, stored: DataFrame | None = None, column: str = "dff_raw", most: float = 5.0, least: float = -2.0) -> DataFrame:
    """One row a recording (recording, condition): number of regions, extremes of dF/F, synchrony before and after regression, severity, whether the
    signal was regressed, mean quality and event rate, and ``artifact``. ``stored`` has the metrics that newer files carry (recording and
    any of synchrony_before, synchrony_after, max_dff, min_dff, neuropil_severity, global_regression_applied, artifact_flag): of such a
    recording what is not stored stays unknown. Of others the metrics are computed from the traces ``column``. A recording without regions has no
    metrics and severity NONE."""
    number = rois.groupBy("recording").agg(F.count("*").alias("n_rois"), *[(F.avg(c) if c in rois.columns else F.lit(None).cast("double")).alias(f"mean_{c}") for c in ("snr", "event_rate")])
    extremes = rois.groupBy("recording").agg(F.max(F.array_max(column)).alias("c_max"), F.min(F.array_min(column)).alias("c_min"))
    got = recordings.join(number, "recording", "left").join(extremes, "recording", "left").join(traces.synchrony(rois, column).select("recording", F.col("synchrony").alias("c_synchrony")), "recording", "left")
    kinds = {"synchrony_before": "double", "synchrony_after": "double", "max_dff": "double", "min_dff": "double", "neuropil_severity": "string", "global_regression_applied": "boolean", "artifact_flag": "boolean"}
    if stored is None:
        got = got.withColumns({"known": F.lit(None).cast("boolean")} | {f"s_{c}": F.lit(None).cast(k) for c, k in kinds.items()})
    else:
        got = got.join(stored.select("recording", F.lit(True).alias("known"), *[field(stored, c, k).alias(f"s_{c}") for c, k in kinds.items()]), "recording", "left")
    some, known = F.coalesce("n_rois", F.lit(0)) > 0, F.coalesce("known", F.lit(False))
    pick = lambda c, computed: F.when(some, F.when(known, F.col(f"s_{c}")).otherwise(computed))
    flag = lambda c: some & known & F.coalesce(f"s_{c}", F.lit(False))
    severity = F.when(~some, "NONE").when(known, F.coalesce("s_neuropil_severity", F.lit("UNKNOWN"))).otherwise(F.coalesce(traces.neuropil_severity(F.col("c_synchrony")), F.lit("LOW")))
    got = got.select(
        "recording", "condition", F.coalesce("n_rois", F.lit(0)).alias("n_rois"), pick("max_dff", F.col("c_max")).alias("max_dff"), pick("min_dff", F.col("c_min")).alias("min_dff"), pick("synchrony_before", F.col("c_synchrony")).alias("synchrony"),
        pick("synchrony_after", F.lit(None).cast("double")).alias("synchrony_after"), severity.alias("neuropil_severity"), flag("global_regression_applied").alias("regression_applied"), "mean_snr", "mean_event_rate",
        F.when(~some, "unknown").when(known, "v4.5").otherwise("v4.4").alias("pipeline_version"), flag("artifact_flag").alias("flagged"),
    )
    return got.withColumn("artifact", F.col("flagged") | F.coalesce(F.col("max_dff") > most, F.lit(False)) | F.coalesce(F.col("min_dff") < least, F.lit(False))).drop("flagged")


def wide_means(means: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a sample: the number of its values and its mean of each metric."""
    n = means.groupBy("condition", "sample").agg(F.max("n").alias("n"))
    return n.join(means.groupBy("condition", "sample").pivot("metric", metrics).agg(F.first("mean")), ["condition", "sample"])


#: Reasons for which refinement removes regions, as refined files count them, and the columns of the sample table.
REMOVED = {
    "extreme_snr": "removed_snr", "edge_contact": "removed_edge", "shape": "removed_shape", "negative_transients": "removed_negative", "step_artifacts": "removed_step", "kinetics": "removed_kinetics", "plateau": "removed_plateau",
    "correlation": "removed_correlated", "spatial": "removed_spatial", "inactive": "removed_inactive", "baseline_drift": "removed_baseline",
}
#: What files without ``removal_counts`` have beside their number of regions.
LEGACY = {"shape": "removed_shape", "correlation": "removed_correlated", "spatial": "removed_spatial", "inactive": "removed_inactive"}


def field(df: DataFrame, path: str, kind: str) -> Column:
    """The nested field ``path`` of ``df`` as ``kind``; NULL where the schema lacks it or a part of the way to it."""
    schema = df.schema
    for name in path.split("."):
        if name not in getattr(schema, "names", ()):
            return F.lit(None).cast(kind)
        schema = schema[name].dataType
    return F.col(path).cast(kind)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Refined samples stored as Parquet by any version: files with and without the nested counts are read together."""
    return spark.read.option("mergeSchema", True).parquet(path)


def sample_table(refined: DataFrame) -> DataFrame:
    """One row a sample from refined samples (condition, sample, snr, event_rate and, if there, event_amplitude, baseline_flag,
    synchrony, motion_quality and refinement with n_original, n_removed and removal_counts): numbers of regions, what was
    removed and why, means over regions, synchrony and class of motion. A count that is missing is 0, files without
    ``removal_counts`` have the four that they wrote, and a sample that was not refined lost nothing."""
    get = lambda path, kind="long": field(refined, path, kind)
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.coalesce(F.size(get("snr", "array<double>")), F.lit(0)).cast("long")
    n = F.greatest(n, F.lit(0))
    refined_at_all = F.col("refinement").isNotNull() if "refinement" in refined.columns else F.lit(False)
    counted = "refinement" in refined.columns and "removal_counts" in refined.schema["refinement"].dataType.names
    counts = F.col("refinement.removal_counts").isNotNull() if counted else F.lit(False)
    removed = {column: zero(F.when(counts, get(f"refinement.removal_counts.{reason}")).otherwise(get(f"refinement.{LEGACY[reason]}") if reason in LEGACY else F.lit(None).cast("long"))) for reason, column in REMOVED.items()}
    original = F.when(refined_at_all, zero(get("refinement.n_original"))).otherwise(n)
    share = lambda c: F.when(F.col("n_original") > 0, 100.0 * c / F.col("n_original")).otherwise(0.0)
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c))
    flags = F.size(F.filter(get("baseline_flag", "array<boolean>"), lambda v: v))
    got = refined.select(
        "condition", "sample", original.alias("n_original"), n.alias("n_refined"), F.when(refined_at_all, zero(get("refinement.n_removed"))).otherwise(0).cast("long").alias("n_removed"), *[c.alias(k) for k, c in removed.items()],
        mean(get("snr", "array<double>")).alias("mean_snr"), mean(get("event_rate", "array<double>")).alias("mean_event_rate"), mean(get("event_amplitude", "array<double>")).alias("mean_event_amplitude"),
        F.when(n > 0, get("synchrony", "double")).alias("synchrony"), F.coalesce(get("motion_quality", "string"), F.lit("unknown")).alias("motion_quality"),
        F.when(n > 0, 100.0 * F.greatest(F.coalesce(flags, F.lit(0)), F.lit(0)) / n).otherwise(0.0).alias("pct_baseline_flagged"),
    )
    return got.withColumns({"pct_removed": share(F.col("n_removed")), "pct_correlated_removed": F.least(F.lit(100.0), share(F.col("removed_correlated")))})


def group_summary(samples: DataFrame, refined: DataFrame) -> DataFrame:
    """One row a condition: numbers of samples and regions, what was removed, mean and spread of quality and event rate over all
    regions, and mean synchrony. ``samples`` is the sample table of ``refined``."""
    per = samples.groupBy("condition").agg(
        F.count("*").alias("n_samples"), F.sum("n_refined").alias("total_rois"), F.avg("n_refined").alias("mean_rois_per_sample"), sample_std(F.col("n_refined")).alias("sd_rois_per_sample"), F.avg("pct_removed").alias("mean_pct_removed"),
        F.avg("synchrony").alias("mean_synchrony"), F.avg("pct_correlated_removed").alias("mean_pct_correlated_removed"),
    )
    each = refined.select("condition", F.explode(F.arrays_zip(F.col("snr").alias("snr"), F.col("event_rate").alias("rate"))).alias("x"))
    both = [f(F.col(f"x.{c}")).alias(f"{k}_{n}") for c, n in (("snr", "snr"), ("rate", "event_rate")) for k, f in (("mean", F.avg), ("sd", sample_std))]
    return per.join(each.groupBy("condition").agg(*both), "condition", "left")


def metric_long(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row a sample and metric, without missing values."""
    return wide.unpivot(keys, metrics, "metric", "value").filter("value is not null")


def compare_conditions(long: DataFrame, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """One row a metric: both conditions' description, Mann-Whitney with corrected p and stars, Cliff's delta, Cohen's d, and
    flags for effects that size and corrected p do not agree on."""
    counted = groups.counted_values(long)
    m, u = groups.moments(counted, first, second, counted=True), checkpointed(groups.rank_sums(counted, first, second, counted=True))
    described = checkpointed(groups.describe(counted, counted=True))
    side = lambda name, k: described.filter(F.col("condition") == name).select("metric", *[F.col(c).alias(f"{c}{k}") for c in ("median", "sd", "iqr")])
    tests = groups.mann_whitney(u).select("metric", "u", "z", "p")
    parts = [side(first, 1), side(second, 2), tests, groups.cliffs_delta(u), groups.cohens_d(m)]
    got = groups.bonferroni(reduce(lambda a, b: a.join(b, "metric"), parts, m), alpha=alpha)
    significant = F.col("p") < F.col("alpha_bonferroni")
    return got.withColumns({"significant": significant, "significant_but_negligible": significant & (F.col("effect") == "negligible"), "large_but_not_significant": ~significant & (F.col("effect") == "large")})


#: Classes of motion that samples can carry.
MOTION_CLASSES = ("good", "acceptable", "high_motion", "excessive_motion")


def recording_quality_counts(judged: DataFrame, names: tuple[str, ...] = ("GOOD", "HIGH_MOTION", "SPIKY")) -> DataFrame:
    """Recordings of each group by the motion quality that the gates gave them."""
    return judged.groupBy("group").agg(*[F.count_if(F.col("motion_quality") == q).alias(q.lower()) for q in names])


def motion_quality_counts(samples: DataFrame, high: float = 0.5) -> DataFrame:
    """Samples of each condition by the class of their motion, and those whose synchrony is above ``high``."""
    return samples.groupBy("condition").agg(
        F.count("*").alias("n_samples"), *[F.count_if(F.col("motion_quality") == q).alias(f"n_{q}") for q in MOTION_CLASSES], F.count_if(F.col("synchrony") > high).alias("n_high_synchrony")
    )


#: Rows of a group up to which the p of its rank correlation comes from all orders.
EXACT_ROWS = 9


def spearman(pairs: DataFrame, by: str, x: str, y: str, least: int = 4) -> DataFrame:
    """Rank correlation of two columns within each value of ``by`` that has ``least`` rows (NULL if one column is the same in all), and its two-sided p:
    from all orders of the ranks up to ``EXACT_ROWS`` rows, by Student's t beyond."""
    ship_package(pairs.sparkSession)
    known = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranked(df: DataFrame, c: str) -> DataFrame:
        counts = df.groupBy(by, c).agg(F.count("*").alias("_n"))
        upto = groups.running_counts(counts, [by], c, ["_n"])
        return df.join(upto.select(by, c, (F.col("_n_upto") - (F.col("_n") - 1) / 2.0).alias(f"_r_{c}")), [by, c])

    both = ranked(ranked(known.select(by, x, y), x), y)
    both = checkpointed(both.select(by, F.col(f"_r_{x}").alias("_x"), F.col(f"_r_{y}").alias("_y")))
    found = both.groupBy(by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("rho")).filter(F.col("n") >= least)
    few = both.join(found.filter(F.col("n") <= EXACT_ROWS).select(by), by, "left_semi").groupBy(by).agg(F.collect_list(F.struct("_x", "_y")).alias("_ranks"))

    @F.pandas_udf("double")
    def p_of(rho: pd.Series, n: pd.Series, ranks: pd.Series) -> pd.Series:
        rows = zip(rho, n, ranks, strict=True)
        far = lambda r, k: special.t_two_sided(r * np.sqrt((k - 2) / max(1e-300, 1 - r * r)), k - 2)
        return pd.Series([np.nan if pd.isna(r) else far(r, k) if v is None else special.spearman_exact([i["_x"] for i in v], [i["_y"] for i in v]) for r, k, v in rows], dtype="float64")

    return found.join(few, by, "left").withColumn("p", F.nanvl(p_of("rho", "n", "_ranks"), F.lit(None).cast("double"))).drop("_ranks")


def removal_breakdown(counts: DataFrame, categories: list[str]) -> DataFrame:
    """Mean number of removed regions of each condition and category, those that occur; most first."""
    long = counts.unpivot(["condition"], categories, "category", "n")
    return long.groupBy("condition", "category").agg(F.avg("n").alias("mean_removed")).filter("mean_removed > 0").orderBy(F.desc("mean_removed"), "condition", "category")


def cv(means: DataFrame) -> DataFrame:
    """Spread of the samples' means in percent of their mean."""
    return means.groupBy("metric", "condition").agg((100 * F.stddev_samp("mean") / F.avg("mean")).alias("cv"))
