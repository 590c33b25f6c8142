"""Quality classes of samples, and the removal of doubtful regions by ten criteria."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionspark.functions import kernels
from motionspark.operators import rounds
from motionspark.operators import traces as tr
from motionspark.runtime import checkpointed, ship_package

STATUSES = ("NO_ROIS", "ARTIFACT", "TOO_FEW_ROIS", "SEVERE_NEUROPIL", "HIGH_NEUROPIL", "MILD_NEUROPIL", "OK")


def sample_status(samples: DataFrame, few: int = 5) -> DataFrame:
    """Status, eligibility, reason and whether regression is needed; the first condition that holds names the status."""
    n, s = F.col("n_rois"), F.col("synchrony")
    status = (
        F.when(n == 0, "NO_ROIS").when(F.col("artifact"), "ARTIFACT").when(n < few, "TOO_FEW_ROIS").when(s > 0.5, "SEVERE_NEUROPIL").when(s > 0.3, "HIGH_NEUROPIL").when(s > 0.15, "MILD_NEUROPIL").otherwise("OK")
    )
    got = samples.withColumn("status", status)
    label = {"SEVERE_NEUROPIL": "Severe", "HIGH_NEUROPIL": "High", "MILD_NEUROPIL": "Mild"}
    extremes = F.format_string("Extreme dF/F (max=%.1f, min=%.1f)", "max_dff", "min_dff") if {"max_dff", "min_dff"} <= set(samples.columns) else F.lit("Extreme dF/F")
    reason = F.when(F.col("status") == "NO_ROIS", "No ROIs detected").when(F.col("status") == "ARTIFACT", extremes)
    reason = reason.when(F.col("status") == "TOO_FEW_ROIS", F.format_string(f"Only %d ROIs (need >= {few})", n.cast("int")))
    for k, name in label.items():
        reason = reason.when(F.col("status") == k, F.format_string(f"{name} neuropil (synchrony=%.3f)", s))
    return got.withColumns({"eligible": F.col("status").isin("OK", "MILD_NEUROPIL", "HIGH_NEUROPIL"), "reason": reason.otherwise("Clean signal"), "needs_regression": F.col("status").endswith("_NEUROPIL")})


def quality_summary(judged: DataFrame) -> DataFrame:
    """Samples of each condition by status, shares in percent, and means over the eligible ones."""
    ok, n = F.col("eligible"), F.count("*")
    share = lambda c: 100 * F.count_if(c) / n
    mean = lambda c: F.avg(F.when(ok, F.col(c) if c in judged.columns else F.lit(None).cast("double"))).alias(c if c.startswith("mean") else f"mean_{c.removeprefix('n_')}")
    return judged.groupBy("condition").agg(
        n.alias("total_samples"), F.count_if(ok).alias("eligible_samples"), share(ok).alias("pct_eligible"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES],
        share(F.col("status") == "ARTIFACT").alias("pct_artifact"), share(F.col("status") == "OK").alias("pct_clean"), mean("synchrony"), mean("mean_snr"), mean("n_rois"),
    )


def corr_histogram(rois: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts of r of all pairs of a recording in equal bins over [-1, 1]. Pairs are counted in the blocks that make them;
    a pair without spread has no r and no bin."""
    ship_package(rois.sparkSession)

    def counts(pdf: pd.DataFrame) -> pd.DataFrame:
        r = tr.correlations(pdf)[2]
        at = np.clip(np.floor((r[np.isfinite(r)] + 1) / 2 * bins).astype(int), 0, bins - 1)
        n = np.bincount(at, minlength=bins)
        return pd.DataFrame({"recording": pdf["recording"].iloc[0], "bin": np.arange(1, bins + 1), "n": n})[n > 0]

    got = tr.blocks(rois, column, []).groupBy("recording", "lo", "hi").applyInPandas(counts, "recording string, bin int, n long")
    return got.groupBy("recording", "bin").agg(F.sum("n").alias("n"))


def trace_measures(x: np.ndarray, smooth: np.ndarray, fps: float, jump: float) -> tuple:
    """What the criteria on one trace need; peaks and ends are looked at once."""
    ratio, tau = kernels.kinetics_values(smooth, fps)
    drift, raised = kernels.drift_values(x, fps)
    return kernels.high_share(x), kernels.negative_z(x), kernels.bad_steps(x, fps, jump), kernels.kinetics_category(ratio, tau), ratio, tau, kernels.longest_plateau(x), drift, raised, kernels.off_start(drift, raised)


def trace_criteria(rois: DataFrame, dff: str = "dff", smooth: str = "dff_smooth", max_snr: float = 150, max_plateau_s: float = 20, jump: float = 0.5) -> DataFrame:
    """``c_snr``, ``c_negative``, ``c_step``, ``c_kinetics``, ``c_plateau`` and ``c_drift``: the category of each criterion
    that a region fails, else NULL; and ``why_...``, the reason in words."""
    ship_package(rois.sparkSession)

    @F.pandas_udf("high double, neg double, steps int, kin string, ratio double, tau double, plateau int, drift double, raised double, drifted boolean")
    def measure(x: pd.Series, y: pd.Series, fps: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, r in zip(x, y, fps, strict=True):
            rows.append(trace_measures(np.asarray(a, float), np.asarray(b, float), r, jump))
        return pd.DataFrame(rows, columns=["high", "neg", "steps", "kin", "ratio", "tau", "plateau", "drift", "raised", "drifted"])

    m = rois.withColumn("_m", measure(dff, smooth, "fps"))
    x = lambda c: F.col(f"_m.{c}")
    failed = {
        "snr": F.when((F.col("snr") > max_snr) | (x("high") > 0.30), "extreme_snr"), "negative": F.when(x("neg") < -3, "kinetics_negative"), "step": F.when(x("steps") >= 2, "kinetics_step"), "kinetics": x("kin"),
        "plateau": F.when(x("plateau") > F.round(max_plateau_s * F.col("fps")), "kinetics_plateau"), "drift": F.when(x("drifted"), "baseline_drift"),
    }
    why = {
        "snr": F.when(F.col("snr") > max_snr, F.format_string(f"SNR too high (%.1f > {max_snr:.1f})", F.col("snr").cast("double"))).otherwise(F.format_string("Sustained high signal (%.0f%% > 8x noise)", 100 * x("high"))),
        "negative": F.format_string("Negative transient (z=%.1f < -3.0)", x("neg")), "step": F.format_string("Step artifacts (%d jumps stay elevated)", x("steps")),
        "kinetics": F.when(x("kin") == "kinetics_ratio", F.format_string("Abnormal kinetics (rise/decay=%.2f)", x("ratio"))).when(x("tau") < 1, F.format_string("Decay too fast (tau=%.3fs)", x("tau"))).otherwise(F.format_string("Decay too slow (tau=%.1fs)", x("tau"))),
        "plateau": F.format_string(f"Sustained plateau (%.1fs > {max_plateau_s:.1f}s)", x("plateau") / F.col("fps")), "drift": F.format_string("Baseline drift (%.2f dF/F, %.0f%% elevated)", x("drift"), 100 * x("raised")),
    }
    return m.withColumns({f"c_{k}": c for k, c in failed.items()} | {f"why_{k}": F.when(failed[k].isNotNull(), w) for k, w in why.items()}).drop("_m")


def greedy_prune(rois: DataFrame, pairs: DataFrame, value: str | None = None) -> DataFrame:
    """recording, roi_id, loses_to and the pair's ``value``. ``pairs`` are the recording's conflicting pairs (roi_i < roi_j); they are
    settled in the order of a walk along them, by rounds (``rounds.weaker_goes``)."""
    known = rois.select("recording", "roi_id", "snr")
    i, j = known.withColumnsRenamed({"roi_id": "i", "snr": "snr_i"}), known.withColumnsRenamed({"roi_id": "j", "snr": "snr_j"})
    both = pairs.select("recording", F.col("roi_i").alias("i"), F.col("roi_j").alias("j"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
    both = checkpointed(both.join(i, ["recording", "i"]).join(j, ["recording", "j"]))
    gone = rounds.weaker_goes(both).select("recording", F.col("node").alias("roi_id"), F.col("by").alias("loses_to"), F.least("node", "by").alias("i"), F.greatest("node", "by").alias("j"))
    return gone.join(both.select("recording", "i", "j", "value"), ["recording", "i", "j"]).select("recording", F.col("roi_id").cast("long").alias("roi_id"), F.col("loses_to").cast("long").alias("loses_to"), "value")


def prune_correlated(rois: DataFrame, column: str = "dff", most: float = 0.7) -> DataFrame:
    return greedy_prune(rois, tr.pairwise_corr(rois, column, most).filter(F.abs("r") > most), "r")


def close_pairs(rois: DataFrame, least: float = 5.0) -> DataFrame:
    """Pairs of a recording whose centres are nearer than ``least``: regions meet in grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / least)
    home = rois.select("recording", F.col("roi_id").alias("roi_i"), F.col("center_x").alias("xi"), F.col("center_y").alias("yi"), cell("center_x").alias("cx"), cell("center_y").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = rois.withColumn("_o", around).select("recording", F.col("roi_id").alias("roi_j"), F.col("center_x").alias("xj"), F.col("center_y").alias("yj"), (cell("center_x") + F.col("_o.a")).alias("cx"), (cell("center_y") + F.col("_o.b")).alias("cy"))
    joined = home.join(near, ["recording", "cx", "cy"]).filter("roi_i < roi_j")
    gap = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    return joined.filter(gap < least).select("recording", "roi_i", "roi_j", gap.alias("distance"))


#: Criteria that look at one region, in the order in which they are applied.
ORDER = ("snr", "edge", "shape", "negative", "step", "kinetics", "plateau")


def refine(rois: DataFrame, dff: str = "dff", most_corr: float = 0.7, least_px: float = 5.0, min_events: int = 1) -> DataFrame:
    """``category`` and ``reason`` of each region, NULL if it is kept: the first failed criterion names it, and only
    regions that all criteria before kept take part in the next one. ``rois`` has a column ``c_<criterion>`` for each
    criterion of ``ORDER`` that is to count (edges and shapes come from the regions' pixels), and may have ``why_...``
    beside it. The measured regions are written once; the pairwise criteria read them back."""
    seen = [c for c in ORDER if f"c_{c}" in rois.columns]
    why = lambda c: F.when(F.col(f"c_{c}").isNotNull(), F.col(f"why_{c}") if f"why_{c}" in rois.columns else F.col(f"c_{c}"))
    state = rois.withColumns({"category": F.coalesce(*[F.col(f"c_{c}") for c in seen], F.lit(None).cast("string")), "reason": F.coalesce(*[why(c) for c in seen], F.lit(None).cast("string"))})
    state = checkpointed(state)

    def without(state, gone, name, text):
        gone = gone.select("recording", "roi_id", F.lit(name).alias("_c"), F.format_string(text, "loses_to", "value").alias("_w"))
        joined = state.join(gone, ["recording", "roi_id"], "left")
        return joined.withColumns({"category": F.coalesce("category", "_c"), "reason": F.coalesce("reason", "_w")}).drop("_c", "_w")

    state = without(state, prune_correlated(state.filter("category is null"), dff, most_corr), "correlation", "Correlated with ROI %d (r=%.2f)")
    if "center_x" in rois.columns:
        state = checkpointed(state)
        alive = state.filter("category is null")
        state = without(state, greedy_prune(alive, close_pairs(alive, least_px), "distance"), "spatial", "Too close to ROI %d (%.1f px)")
    inactive = F.col("event_count") < min_events
    last = F.when(inactive, "inactive").otherwise(F.col("c_drift"))
    text = F.when(inactive, F.format_string(f"No events (%d < {min_events})", F.col("event_count").cast("int"))).otherwise(why("drift"))
    return state.withColumns({"category": F.coalesce("category", last), "reason": F.coalesce("reason", text)})


#: The counts of a summary and the categories that each of them takes in.
COUNTS = {
    "snr": ("extreme_snr",), "edge": ("edge_contact",), "shape": ("shape_compactness", "shape_extent", "shape_aspect", "shape_solidity", "shape_eccentricity"), "negative": ("kinetics_negative",), "step": ("kinetics_step",),
    "kinetics": ("kinetics_ratio", "kinetics_decay"), "plateau": ("kinetics_plateau",), "corr": ("correlation",), "spatial": ("spatial",), "inactive": ("inactive",), "baseline": ("baseline_drift",),
}
MERGED = {"extreme_snr": ("snr",), "edge_contact": ("edge",), "shape": ("shape",), "kinetics": ("negative", "step", "kinetics", "plateau"), "correlation": ("corr",), "spatial": ("spatial",), "inactive": ("inactive",), "baseline": ("baseline",)}


def counted(names) -> Column:
    return F.count_if(F.col("category").isin([c for k in names for c in COUNTS[k]]))


def removal_counts(refined: DataFrame) -> DataFrame:
    """Removed regions of each recording by the eleven criteria."""
    return refined.groupBy("recording").agg(*[counted([k]).alias(k) for k in COUNTS])


def category_counts(refined: DataFrame) -> DataFrame:
    """Removed regions of each recording by merged categories, those of all kinetics together."""
    return refined.groupBy("recording").agg(*[counted(names).alias(k) for k, names in MERGED.items()])


def rejection_examples(refined: DataFrame, n: int = 2, categories: int = 6) -> DataFrame:
    """The first ``n`` regions of each recording's first ``categories`` categories in alphabetical order."""
    place = F.row_number().over(Window.partitionBy("recording", "category").orderBy("roi_id"))
    rank = F.dense_rank().over(Window.partitionBy("recording").orderBy("category"))
    gone = refined.filter("category is not null").withColumn("_p", place).filter(F.col("_p") <= n)
    return gone.withColumn("_r", rank).filter(F.col("_r") <= categories).select("recording", "category", "roi_id", "reason")


def refinement_log(refined: DataFrame) -> DataFrame:
    return refined.select(
        "recording", F.col("roi_id").alias("ROI_Original"), F.col("category").isNull().alias("Kept"), F.coalesce("category", F.lit("")).alias("Category"), F.coalesce("reason", F.lit("")).alias("Removal_Reason"), F.col("snr").alias("SNR")
    )


def refined_rois(refined: DataFrame) -> DataFrame:
    """Kept regions, numbered anew from 1."""
    place = F.row_number().over(Window.partitionBy("recording").orderBy("roi_original"))
    return refined.filter("category is null").withColumnRenamed("roi_id", "roi_original").withColumn("roi_id", place)


def refined_synchrony(refined: DataFrame, dff: str = "dff") -> DataFrame:
    """recording and synchrony_score, computed anew from the kept regions; NULL with fewer than two."""
    return tr.synchrony(refined.filter("category is null"), dff).withColumnRenamed("synchrony", "synchrony_score")


def refinement_summary(refined: DataFrame, dff: str = "dff") -> DataFrame:
    """One row a recording: regions before and after, removals by criterion, and means over what is kept."""
    kept: Column = F.col("category").isNull()
    n = F.count("*")
    quality = F.coalesce(F.first("motion_quality", ignorenulls=True), F.lit("unknown")) if "motion_quality" in refined.columns else F.lit("unknown")
    got = refined.groupBy(F.col("recording").alias("filename"), "condition").agg(
        quality.alias("motion_quality"), n.alias("n_original"), F.count_if(kept).alias("n_refined"), F.count_if(~kept).alias("n_removed"), (100 * F.count_if(~kept) / n).alias("pct_removed"),
        *[counted([k]).alias(f"removed_{k}") for k in COUNTS], F.avg(F.when(kept, F.col("snr"))).alias("mean_snr"), F.avg(F.when(kept, F.col("event_rate"))).alias("mean_event_rate"),
    )
    return got.join(refined_synchrony(refined, dff).withColumnRenamed("recording", "filename"), "filename", "left")


def refinement_by_condition(summary: DataFrame) -> DataFrame:
    """Totals, means and spreads over the recordings of each condition."""
    both = lambda c: (F.avg(c).alias(f"mean_{c.removeprefix('mean_')}"), F.coalesce(F.stddev_samp(c), F.when(F.count(c) == 1, 0.0)).alias(f"std_{c.removeprefix('mean_')}"))
    total = lambda *names: sum((F.sum(f"removed_{k}") for k in names[1:]), F.sum(f"removed_{names[0]}"))
    return summary.groupBy("condition").agg(
        F.count("*").alias("n_files"), F.sum("n_original").alias("total_rois_original"), F.sum("n_refined").alias("total_rois_refined"), F.avg("n_refined").alias("mean_rois_per_file"),
        F.coalesce(F.stddev_samp("n_refined"), F.lit(0.0)).alias("std_rois_per_file"), F.avg("pct_removed").alias("mean_pct_removed"), total("edge").alias("total_edge_removed"), total("shape").alias("total_shape_removed"),
        total("kinetics", "negative", "step", "plateau").alias("total_kinetics_removed"), *both("mean_snr"), *both("mean_event_rate"), F.avg("synchrony_score").alias("mean_synchrony"),
    )
