"""Fluorescence traces: baseline, smoothing, signal quality, events, correlation and regression.

``traces`` has recording, roi_id, fps and array columns of frames; one row holds a whole trace, so no trace is ever split
between tasks and no window over frames is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.functions import kernels
from motionspark.functions.stats import hazen
from motionspark.runtime import ship_package

#: Traces of a recording that are correlated with each other at once.
BLOCK = 512


def mapped(kernel, schema: str, *fixed):
    """``kernel(trace..., fps)`` as a function of columns."""

    @F.pandas_udf(schema)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([kernel(*[np.asarray(v, float) if np.ndim(v) else float(v) for v in row], *fixed) for row in zip(*columns, strict=True)], dtype="object" if schema.startswith(("array", "string", "boolean", "int")) else "float64")

    return run


def dff(traces: DataFrame, coef: float = 0.7, seconds: float = 30) -> DataFrame:
    """``dff_raw`` from f and fneu."""
    ship_package(traces.sparkSession)
    return traces.withColumn("dff_raw", mapped(kernels.dff, "array<double>", coef, seconds)("f", "fneu", "fps"))


def savgol(traces: DataFrame, column: str, out: str = "dff_smooth") -> DataFrame:
    ship_package(traces.sparkSession)
    return traces.withColumn(out, mapped(kernels.savgol, "array<double>")(column, "fps"))


def snr(traces: DataFrame, column: str) -> DataFrame:
    ship_package(traces.sparkSession)
    return traces.withColumn("snr", mapped(kernels.snr, "double")(column, "fps"))


def detect_events(traces: DataFrame, column: str, prominence: float = 0.03, rise: float = 0.01) -> DataFrame:
    """``event_count``, ``event_rate`` (a second) and ``event_amplitude`` (mean height, 0 without events)."""
    ship_package(traces.sparkSession)

    @F.pandas_udf("event_count int, event_rate double, event_amplitude double")
    def run(x: pd.Series, fps: pd.Series) -> pd.DataFrame:
        rows = []
        for v, r in zip(x, fps, strict=True):
            at, heights = kernels.detect_events(np.asarray(v, float), float(r), prominence=prominence, rise=rise)
            up = heights[heights > 0]
            rows.append((len(at), len(at) / (len(v) / r), float(up.mean()) if len(up) else 0.0))
        return pd.DataFrame(rows, columns=["event_count", "event_rate", "event_amplitude"])

    return traces.withColumn("_e", run(column, "fps")).select("*", "_e.*").drop("_e")


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def sd_of(x: Column) -> Column:
    m = mean_of(x)
    return F.when(F.size(x) > 1, F.sqrt(F.aggregate(F.zip_with(x, F.array_repeat(m, F.size(x)), lambda v, k: (v - k) * (v - k)), F.lit(0.0), lambda a, v: a + v) / (F.size(x) - 1))).otherwise(0.0)


def trace_stats(traces: DataFrame, column: str) -> DataFrame:
    """Mean, max, sd and percentiles of each trace."""
    x, ordered = F.col(column), F.array_sort(column)
    return traces.select("recording", "roi_id", mean_of(x).alias("mean"), F.array_max(x).alias("max"), sd_of(x).alias("sd"), *[hazen(ordered, p).alias(f"p{p}") for p in (25, 50, 75, 90, 95)])


def artifact_flag(traces: DataFrame, column: str, high: float = 5, low: float = -2) -> DataFrame:
    """Greatest and least value of a recording and whether they are out of bounds, with the reason."""
    got = traces.groupBy("recording").agg(F.max(F.array_max(column)).alias("max_dff"), F.min(F.array_min(column)).alias("min_dff"))
    over, under = F.col("max_dff") > high, F.col("min_dff") < low
    reason = F.concat_ws("; ", F.when(over, F.format_string("max %.2f", "max_dff")), F.when(under, F.format_string("min %.2f", "min_dff")))
    return got.withColumns({"artifact": over | under, "reason": reason})


def neuropil_severity(synchrony: Column) -> Column:
    return F.when(synchrony > 0.5, "SEVERE").when(synchrony > 0.3, "HIGH").when(synchrony > 0.15, "MILD").when(synchrony.isNotNull(), "LOW")


def blocks(traces: DataFrame, column: str, extra: list[str]) -> DataFrame:
    """Each trace in every pair of blocks of its recording that has its own; one block for up to ``BLOCK`` traces."""
    n = traces.groupBy("recording").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("_b"))
    dealt = traces.select("recording", "roi_id", F.col(column).alias("x"), *extra).join(n, "recording").withColumn("own", F.pmod(F.xxhash64("roi_id"), F.col("_b")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return dealt.select("recording", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "roi_id", "x", *extra)


def correlations(pdf: pd.DataFrame):
    """roi_i, roi_j, r of the pairs that a block pair stands for."""
    x = np.array(pdf["x"].tolist(), float)
    x = x - x.mean(1, keepdims=True)
    size = np.sqrt((x * x).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        z = x / size[:, None]
    left, right = (np.nonzero(pdf["own"].to_numpy() == pdf[k].iloc[0])[0] for k in ("lo", "hi"))
    same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
    r = z[left] @ z[right].T
    i, j = np.nonzero(np.triu(np.ones(r.shape, bool), 1) if same else np.ones(r.shape, bool))
    ids = pdf["roi_id"].to_numpy()
    a, b = ids[left[i]], ids[right[j]]
    return np.minimum(a, b), np.maximum(a, b), r[i, j]


def pairwise_corr(traces: DataFrame, column: str, at_least: float = 0.0) -> DataFrame:
    """recording, roi_i < roi_j and Pearson's r of the pairs with |r| >= ``at_least``."""
    ship_package(traces.sparkSession)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, r = correlations(pdf)
        keep = np.abs(r) >= at_least
        return pd.DataFrame({"recording": pdf["recording"].iloc[0], "roi_i": a[keep], "roi_j": b[keep], "r": r[keep]})

    return blocks(traces, column, []).groupBy("recording", "lo", "hi").applyInPandas(pairs, "recording string, roi_i long, roi_j long, r double")


def synchrony(traces: DataFrame, column: str) -> DataFrame:
    """Mean |r| over the pairs of a recording, NULL with fewer than two traces. Blocks give sums, not pairs."""
    ship_package(traces.sparkSession)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.abs(correlations(pdf)[2])
        r = r[np.isfinite(r)]
        return pd.DataFrame({"recording": [pdf["recording"].iloc[0]], "s": [float(r.sum())], "n": [len(r)]})

    got = blocks(traces, column, []).groupBy("recording", "lo", "hi").applyInPandas(sums, "recording string, s double, n long")
    return got.groupBy("recording").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("synchrony"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of two arrays."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n, sx, sy = F.size(x), total(x), total(y)
    sxy, sxx, syy = (total(F.zip_with(a, b, lambda u, v: u * v)) for a, b in ((x, y), (x, x), (y, y)))
    return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(F.lit(0.0), (n * sxx - sx * sx) * (n * syy - sy * sy))))


def mean_trace(traces: DataFrame, column: str) -> DataFrame:
    """The mean of a recording's traces, frame by frame. The sums are taken before the shuffle."""
    points = traces.select("recording", F.posexplode(column).alias("k", "v")).groupBy("recording", "k").agg(F.avg("v").alias("v"))
    return points.groupBy("recording").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("mean_trace"))


def corr_with_mean(traces: DataFrame, column: str) -> DataFrame:
    """r of each trace with its recording's mean trace."""
    both = traces.join(mean_trace(traces, column), "recording")
    return both.select("recording", "roi_id", correlation(F.col(column), F.col("mean_trace")).alias("r_mean"))


def regress_out(traces: DataFrame, column: str, signal: str, method: str = "linear", out: str = "dff") -> DataFrame:
    """The residual of each trace after a fit of the signal with intercept, least squares or robust."""
    if method == "robust":
        ship_package(traces.sparkSession)

        def residual(y, g, fps):
            a, b = kernels.robust_fit(y, g)
            return y - a - b * g

        return traces.withColumn(out, mapped(residual, "array<double>")(column, signal, "fps"))
    x, y = F.col(signal), F.col(column)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size(x)
    sx, sy, sxy, sxx = total(x), total(y), total(F.zip_with(x, y, lambda u, v: u * v)), total(F.transform(x, lambda u: u * u))
    fitted = traces.withColumn("_b", F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))).withColumn("_a", (sy - F.col("_b") * sx) / n)
    return fitted.withColumn(out, F.zip_with(y, x, lambda v, u: v - F.col("_a") - F.col("_b") * u)).drop("_a", "_b")


def keep_rois(traces: DataFrame, min_snr: float) -> DataFrame:
    """``keep``: signal quality at the cut, which is lowered for weak recordings; just below it two events are enough."""
    medians = traces.groupBy("recording").agg(F.median("snr").alias("_m"))
    both = traces.join(medians, "recording")
    cut = F.when((F.col("_m") < min_snr) & (F.col("_m") > 0.5 * min_snr), F.greatest(F.lit(0.7 * min_snr), 0.8 * F.col("_m"))).otherwise(F.lit(float(min_snr)))
    good = (F.col("snr") >= cut) | ((F.col("snr") >= 0.8 * cut) & (F.col("event_count") >= 2))
    return both.withColumn("keep", good).drop("_m")


def zscore(traces: DataFrame, column: str) -> DataFrame:
    m, s = mean_of(F.col(column)), sd_of(F.col(column))
    got = traces.withColumns({"_m": m, "_s": F.when(s > 0, s).otherwise(1.0)})
    return got.withColumn("z", F.transform(column, lambda v: (v - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def segments(traces: DataFrame, column: str, seconds: float = 30) -> DataFrame:
    """Pieces of a fixed time, with the trace's 0.5 and 99.5 percentiles as limits."""
    ordered, x = F.array_sort(column), F.col(column)
    size = F.greatest(F.lit(1), F.round(F.lit(float(seconds)) * F.col("fps")).cast("int"))
    wide = traces.select("recording", "roi_id", x.alias("x"), size.alias("size"), hazen(ordered, 0.5).alias("low"), hazen(ordered, 99.5).alias("high"))
    many = wide.withColumn("segment", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / F.col("size")).cast("int"))))
    return many.select("recording", "roi_id", "segment", F.slice("x", F.col("segment") * F.col("size") + 1, F.col("size")).alias("values"), "low", "high")
