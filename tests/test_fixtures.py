"""Small series with known answers, and properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionspark.functions import images, kernels, special
from motionspark.functions.stats import hazen, sample_std, share
from motionspark.operators import groups, movies, refine, series, traces


def series_of(spark, dx, dy=None, fps=1.0, px_um=0.26):
    dy = [0.0] * len(dx) if dy is None else dy
    rows = [("R", "control", k + 1, None if a is None else float(a), None if b is None else float(b), fps, px_um) for k, (a, b) in enumerate(zip(dx, dy, strict=True))]
    return spark.createDataFrame(rows, "recording string, group string, frame int, dx_um double, dy_um double, fps double, px_um double")


def test_hazen(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [7.0], [])], "a array<double>, b array<double>, c array<double>")
    got = row.select(*[hazen(F.col(c), p) for c, p in (("a", 25), ("a", 75), ("a", 95), ("b", 95), ("c", 50))]).first()
    assert list(got) == [1.5, 3.5, 4.0, 7.0, None]


def test_steps_and_shares(spark):
    got = [r["step_um"] for r in series.step_size(series_of(spark, [0.0, 1.0, None, 3.0, 4.0])).orderBy("frame").collect()]
    assert got == [0.0, 1.0, None, None, 1.0]
    s = spark.createDataFrame([(0.05,), (None,)], "s double")
    assert s.agg(share(F.col("s") <= 0.10)).first()[0] == 0.5
    assert s.agg(sample_std(F.col("s"))).first()[0] == 0.0


def test_flatline_with_a_gap(spark):
    assert series_of(spark, [1.0, 1.0, 1.0]).groupBy("recording").agg(series.flatline().alias("f")).first()["f"]
    assert not series_of(spark, [1.0, None, 1.0]).groupBy("recording").agg(series.flatline().alias("f")).first()["f"]


def test_runs_touch_both_ends(spark):
    df = series_of(spark, [1.0, 1, 0, 1, 0, 0, 1, 1, 1]).withColumn("flag", F.col("dx_um") > 0)
    assert sorted((r["start"], r["end"]) for r in series.runs(df, "flag").collect()) == [(1, 2), (4, 4), (7, 9)]
    assert series.longest_run(df, "flag").first()["longest"] == 3
    mask = [r["above"] for r in series.above_mask(df, "dx_um", 0.5, 2).orderBy("frame").collect()]
    assert mask == [True, True, False, False, False, False, True, True, True]


def test_even_and_padded_windows():
    assert kernels.moving(np.arange(1.0, 7), 4, "mean").tolist() == [1.5, 2, 2.5, 3.5, 4.5, 5]
    assert kernels.median3(np.array([5.0, 6, 7])).tolist() == [5, 6, 6]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "metric string, p double")
    got = {r["metric"]: r["q"] for r in groups.fdr_bh(df).collect()}
    assert got["a"] == pytest.approx(0.04) and got["b"] == pytest.approx(0.0533333, abs=1e-6) and got["c"] == pytest.approx(0.0533333, abs=1e-6) and got["d"] is None


def long_of(spark, x, y):
    rows = [("m", "x", k, float(v)) for k, v in enumerate(x)] + [("m", "y", 100 + k, float(v)) for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "metric string, condition string, sample long, value double")


def test_delta_with_ties(spark):
    long = long_of(spark, [1, 2, 2], [2, 3])
    assert groups.cliffs_delta(groups.rank_sums(long, "x", "y")).first()["delta"] == pytest.approx(-4 / 6)
    assert groups.cliffs_delta(groups.rank_sums(long, "y", "x")).first()["delta"] == pytest.approx(4 / 6)
    assert kernels and groups.delta_of(np.array([1, 2, 2]), np.array([2, 3])) == pytest.approx(-4 / 6)


def test_exact_rank_test(spark):
    long = long_of(spark, [1, 2, 3], [4, 5, 6])
    got = groups.mann_whitney(groups.rank_sums(long, "x", "y")).first()
    assert got["u"] == 0 and got["p"] == pytest.approx(0.1)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.normal_cdf(1.959963984540054) == pytest.approx(0.975)


def test_percentiles_from_counts(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 40, 500) / 7
    long = long_of(spark, x, [1.0])
    got = {r["condition"]: r for r in groups.percentiles(long, ["condition"], {"a": 10, "b": 50, "c": 97.5}).collect()}
    assert [got["x"][k] for k in "abc"] == pytest.approx([kernels.hazen(x, p) for p in (10, 50, 97.5)])
    assert got["y"]["a"] == 1.0


def test_equal_samples_have_no_icc(spark):
    rows = [("m", "x", s, v) for s in (1, 2) for v in (1.0, 2.0, 3.0)]
    got = groups.icc(spark.createDataFrame(rows, "metric string, condition string, sample long, value double")).first()
    assert got["icc"] == 0 and got["design_effect"] == 1


def test_resampling(spark):
    rng = np.random.default_rng(1)
    long = long_of(spark, rng.normal(0, 1, 40), rng.normal(1, 1, 40))
    means = groups.sample_means(long)
    diff = [r["m2"] - r["m1"] for r in groups.moments(long, "x", "y").collect()][0]
    ci = groups.bootstrap_mean_diff(means, "x", "y", 400).first()
    assert ci["ci_low"] < diff < ci["ci_high"]
    assert 0 < groups.permutation_test(means, "x", "y", 400).first()["p_permutation"] < 0.05
    again = groups.bootstrap_mean_diff(means.repartition(7), "x", "y", 400).first()
    assert (again["ci_low"], again["ci_high"]) == (ci["ci_low"], ci["ci_high"])
    nested = groups.hierarchical_bootstrap(long, "x", "y", 200).first()
    assert nested["ci_low"] < diff < nested["ci_high"]


def test_sine_has_its_frequency(spark):
    t = np.arange(600)
    df = series_of(spark, list(np.sin(2 * np.pi * 0.1 * t))).withColumn("step_um", F.col("dx_um"))
    got = series.dominant_peak(series.psd(df, 128, 16)).first()
    assert abs(got["dom_f"] - 0.1) <= 1 / 256 and got["dom_period_min"] == pytest.approx(1 / got["dom_f"] / 60)
    f, p = series.welch(np.sin(2 * np.pi * 0.1 * t), 1.0, 128, 16)
    assert np.sum(p) * (f[1] - f[0]) == pytest.approx(0.5, rel=0.05)


def test_spike_runs_join_after_compaction(spark):
    df = series_of(spark, [0.0] * 12).withColumns({"step_um": F.when(F.col("frame").isin(5, 6, 9, 10), 1.0).otherwise(0.0), "post": F.col("frame") > 2, "reposition": F.col("frame").isin(7, 8)})
    assert series.frac_above(series.compacted(df), "step_um", 0.5, 4).first()["frac_above"] == pytest.approx(4 / 8)


def test_repositions(spark):
    x = [0.0] * 20 + [3.0 * k for k in range(1, 5)] + [12.0] * 20
    got = series.reposition_mask(series.step_size(series_of(spark, x)), around_s=15, more_than=10).orderBy("frame").collect()
    assert [r["frame"] for r in got if r["reposition"]] == [20 + k for k in range(0, 6)]


def test_shifted_image(spark):
    rng = np.random.default_rng(2)
    image = images.smooth(rng.normal(size=(32, 32)), 1.5)
    x, y = images.shift_between(np.roll(image, (-2, 3), (0, 1)), image, 8, 10)
    assert (x, y) == pytest.approx((3, -2), abs=0.1)
    disk = np.zeros((20, 20))
    disk[8:12, 8:12] = 10
    assert np.allclose(images.translate(disk, 3, -2)[6:10, 11:15], 10)
    movie = spark.createDataFrame([("R", 1, 32, 32, np.roll(image, (1, -2), (0, 1)).ravel().tolist())], "recording string, frame int, height int, width int, pixels array<double>")
    base = spark.createDataFrame([("R", image.ravel().tolist())], "recording string, template array<double>")
    got = movies.estimate_shifts(movie, base, 8, 15).first()
    assert (got["dx_px"], got["dy_px"]) == pytest.approx((-2, -1), abs=0.1) and not got["unstable_tracking"]


def test_planted_cells(spark):
    rng = np.random.default_rng(3)
    n, size = 200, 48
    movie = rng.normal(100, 1, (n, size, size))
    centres = [(12, 12), (30, 20), (20, 36)]
    yy, xx = np.mgrid[:size, :size]
    for k, (a, b) in enumerate(centres):
        flash = np.zeros(n)
        for s in rng.integers(0, n - 12, 6):
            flash[s : s + 12] += 20 * np.exp(-np.arange(12) / 4)
        movie[:, np.hypot(yy - a, xx - b) <= 3] += flash[:, None]
    rows = [("R", k + 1, size, size, f.ravel().tolist()) for k, f in enumerate(movie)]
    df = spark.createDataFrame(rows, "recording string, frame int, height int, width int, pixels array<double>")
    maps = movies.pixel_mean_std(df).join(movies.cn_pnr_maps(df), ["recording", "y", "x"]).withColumn("in_mask", F.lit(True))
    levels = movies.threshold_levels(movies.map_stats(maps), 0.25, 2.5)
    found = movies.find_regions(maps, levels).collect()
    regions = {}
    for r in found:
        regions.setdefault(r["roi_id"], []).append((r["y"], r["x"]))
    mids = [np.mean(p, 0) for p in regions.values()]
    assert all(min(np.hypot(*(m - c)) for m in mids) <= 1 for c in map(np.array, centres))
    seeds = movies.find_regions(maps, levels, grow=False).collect()
    assert all(min(math.hypot(s["y"] - a, s["x"] - b) for s in seeds) <= 1.5 for a, b in centres)


def test_shapes():
    yy, xx = np.mgrid[:21, :21]
    y, x = np.nonzero(np.hypot(yy - 10, xx - 10) <= 6)
    got = images.shape(y, x)
    assert got["area"] == len(y) and got["eccentricity"] < 0.1 and got["solidity"] > 0.85 and 0.8 < got["compactness"] < 1.2
    line = images.shape(np.zeros(10, int), np.arange(10))
    assert line["eccentricity"] > 0.99 and line["extent"] == 1
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert images.fill_holes(ring).sum() == 25 and images.components(np.eye(4, dtype=bool)).max() == images.components(np.eye(4, dtype=bool))[0, 0]
    assert 0.2 < images.otsu(np.array([0.1] * 50 + [0.9] * 50)) < 0.9


def test_events():
    x = np.zeros(900)
    for s in (100, 300, 500):
        x[s : s + 60] += np.concatenate([np.linspace(0, 1, 4), np.exp(-np.arange(56) / 12)])
    x[650:860] += np.linspace(0, 0.5, 210) * 0.01
    at, heights = kernels.detect_events(x, 30.0)
    assert len(at) == 3 and (heights > 0.8).all()


def test_find_peaks():
    x = np.array([5.0, 0, 1, 3, 3, 1, 0, 2, 0, 9])
    assert kernels.find_peaks(x).tolist() == [3, 7]
    assert kernels.find_peaks(x, prominence=2.5).tolist() == [3] and kernels.find_peaks(x, distance=5).tolist() == [3]


def test_savgol_keeps_cubics():
    t = np.linspace(-1, 1, 40)
    assert np.allclose(kernels.savgol(t**3 - t + 2, 50.0), t**3 - t + 2)


def test_pchip():
    x, y = np.array([0.0, 1, 2, 4]), np.array([0.0, 1, 1, 5])
    at = np.linspace(0, 4, 81)
    got = kernels.pchip(x, y, at)
    assert np.allclose(kernels.pchip(x, y, x), y) and (np.diff(got) >= -1e-12).all()


def test_robust_fit_ignores_outliers():
    rng = np.random.default_rng(4)
    g = rng.normal(size=200)
    y = 2 + 3 * g + 0.01 * rng.normal(size=200)
    y[:20] += 50
    assert kernels.robust_fit(y, g) == pytest.approx((2, 3), abs=0.02)


def test_greedy_pruning(spark):
    assert kernels.greedy([("A", "B"), ("B", "C")], {"A": 3, "B": 5, "C": 4}) == {"A": "B", "C": "B"}
    # after losing to B, A still removes the weaker C
    assert kernels.greedy([("A", "B"), ("A", "C")], {"A": 3, "B": 5, "C": 1}) == {"A": "B", "C": "A"}
    rows = [("R", k, 0.0 + 2 * k, 0.0, s) for k, s in ((1, 3.0), (2, 5.0), (3, 4.0))] + [("R", 9, 50.0, 50.0, 1.0)]
    rois = spark.createDataFrame(rows, "recording string, roi_id long, center_x double, center_y double, snr double")
    gone = refine.greedy_prune(rois, refine.close_pairs(rois, 3.0)).collect()
    assert {(r["roi_id"], r["loses_to"]) for r in gone} == {(1, 2), (3, 2)}


def test_first_criterion_names_the_region(spark):
    rows = [("R", 1, [0.0, 1.0, 0.0, 2.0] * 5, 9.0, 3, "extreme_snr", "kinetics_step"), ("R", 2, [0.0, 1.0, 0.0, 2.0] * 5, 5.0, 3, None, None), ("R", 3, [1.0, 0.0, 3.0, 0.0] * 5, 4.0, 0, None, None)]
    rois = spark.createDataFrame(rows, "recording string, roi_id long, dff array<double>, snr double, event_count int, c_snr string, c_step string").withColumn("c_drift", F.lit(None).cast("string"))
    got = {r["roi_id"]: r["category"] for r in refine.refine(rois, most_corr=0.99).collect()}
    assert got == {1: "extreme_snr", 2: None, 3: "inactive"}


def test_blocks_give_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("R", k, rng.normal(size=20).tolist(), 1.0) for k in range(30)]
    df = spark.createDataFrame(rows, "recording string, roi_id long, x array<double>, fps double")
    whole = {(r["roi_i"], r["roi_j"]): r["r"] for r in traces.pairwise_corr(df, "x").collect()}
    monkeypatch.setattr(traces, "BLOCK", 7)
    parts = {(r["roi_i"], r["roi_j"]): r["r"] for r in traces.pairwise_corr(df, "x").collect()}
    assert len(whole) == 435 and set(parts) == set(whole) and all(parts[k] == pytest.approx(whole[k]) for k in whole)
    want = np.abs(np.corrcoef([r[2] for r in rows])[np.triu_indices(30, 1)]).mean()
    assert traces.synchrony(df, "x").first()["synchrony"] == pytest.approx(want)


def test_zero_roi_diagnostics_only_without_regions(spark):
    from motionspark.jobs import movie_queries as mv

    sf = "/root/testdata/sf0.001"
    names = lambda df: {r["recording"] for r in df.select("recording").distinct().collect()}
    found = mv.im31(spark, sf)
    bands, limits = mv.whole_chain(spark, sf)
    got, regions = names(found), names(movies.find_regions(bands, limits, 1.0, 5, 20, blur=None))
    assert got == names(mv.maps(spark, sf)) - regions and got and regions
    one = {r["metric"]: r["value"] for r in found.filter(F.col("recording") == min(got)).collect()}
    stats = movies.map_stats(bands, 0.0, 1.5).filter(F.col("recording") == min(got)).first()
    seeds = movies.find_regions(bands, limits, 1.0, 5, 20, grow=False, blur=None).filter(F.col("recording") == min(got)).count()
    assert one == {
        "n_rois": "0", "cn_median": f"{stats['cn_median']:.4f}", "cn_range": f"{stats['cn_range']:.4f}", "cn_max": f"{stats['cn_max']:.4f}", "pnr_median": f"{stats['pnr_median']:.2f}", "pnr_max": f"{stats['pnr_max']:.2f}", "min_pnr_thresh": "1.5",
        "min_corr_thresh": "0.00", "min_area": "5", "max_area": "20", "n_seeds": str(seeds), "data_quality": stats["data_quality"], "gSig": "1",
    }


def test_many_recordings_share_a_call(spark):
    """Recordings cut by Arrow batches stay whole, and none costs a call of its own."""
    n = [1, 7, 40, 40, 3, 120, 40, 2]
    rows = [(f"r{k}", i + 1, float((i * 7 + k) % 11) if (i + k) % 5 else None, 1.0) for k, m in enumerate(n) for i in range(m)]
    df = spark.createDataFrame(rows, "recording string, frame int, step_um double, fps double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    try:
        for size in (16, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            calls = series.whole_series(df.coalesce(1), lambda p: pd.DataFrame({"n": [len(p)], "series": [p["recording"].nunique()]}), "n int, series int").collect()
            assert sum(r["n"] for r in calls) == sum(n) and sum(r["series"] for r in calls) == len(n)
            got[size] = sorted(map(tuple, series.psd(df, 32, 8).collect())), sorted(map(tuple, series.rolling_median(df, ["step_um"], 5).select("recording", "frame", "step_um_s").collect())), sorted(map(tuple, series.auto_settle(df, 6.0, 5, 3).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got[16] == got[10_000] and len(calls) <= 8
    x = pd.Series([r[2] for r in rows if r[0] == "r5"], dtype=float)
    assert [r[2] for r in got[16][1] if r[0] == "r5"] == x.rolling(5, center=True, min_periods=1).median().tolist()
    assert np.allclose([r[3] for r in got[16][0] if r[0] == "r5"], series.welch(x.to_numpy(), 1.0, 32, 8)[1])


def test_peak_and_bands_are_those_of_the_lines(spark):
    df = spark.createDataFrame([(f"r{k}", i + 1, float((i * i + k) % 13), 1.0) for k in range(3) for i in range(64)], "recording string, frame int, step_um double, fps double")
    bands = {"low": (0.0, 0.1), "high": (0.1, 0.5)}
    lines = series.spectra(df, 32, 8)
    both = series.dominant_peak(series.psd(df, 32, 8)).join(series.band_power(series.psd(df, 32, 8), bands), "recording").orderBy("recording").collect()
    for a, b in zip(both, series.peak_and_bands(lines, bands).orderBy("recording").collect(), strict=True):
        assert a["recording"] == b["recording"] and all(abs(a[c] - b[c]) < 1e-9 for c in ("dom_f", "dom_p", "dom_period_min", "frac_low", "frac_high"))
