"""Results that follow from the definitions by hand: gates, tests, resampling, refinement, maps and plans."""

import math
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.functions import images, kernels, special
from motionspark.operators import files, gates, groups, movies, refine, series, tables, traces


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_stars_come_from_p_itself(spark):
    """All eleven listed tests count in the correction, the one without p too."""
    p = rows(spark, [(f"m{k}", v) for k, v in enumerate([0.004, 0.0001, 0.02, 0.0049, None, 0.9, 0.5, 0.5, 0.5, 0.5, 0.5])], "metric string, p double")
    got = {r["metric"]: r for r in groups.bonferroni(p).collect()}
    assert [got[f"m{k}"]["stars"] for k in range(5)] == ["**", "***", "n.s.", "n.s.", "n.s."]
    assert got["m0"]["p_bonferroni"] == pytest.approx(0.044) and got["m0"]["alpha_bonferroni"] == pytest.approx(0.05 / 11) and got["m4"]["p_bonferroni"] is None


def test_power_has_two_tails_and_none_without_effect(spark):
    m = rows(spark, [("a", 10, 1.0, 4.0, 10, 0.0, 4.0), ("b", 10, 1.0, 4.0, 10, 1.0, 4.0)], "metric string, n1 long, m1 double, v1 double, n2 long, m2 double, v2 double")
    got = {r["metric"]: r["power"] for r in groups.power_estimate(m).collect()}
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    shift = 0.5 * math.sqrt(5)
    assert got["a"] == pytest.approx(1 - cdf(1.96 - shift) + cdf(-1.96 - shift)) and got["b"] is None


def test_motion_quality_looks_at_the_range(spark):
    shifts = [("A", 30.0, 0.0), ("A", 31.0, 0.0), ("B", -30.0, 0.0), ("B", 31.0, 0.0), ("C", 51.0, 0.0)]
    got = {r["recording"]: r["motion_quality"] for r in movies.motion_quality(rows(spark, shifts, "recording string, dx_px double, dy_px double")).collect()}
    assert got == {"A": "good", "B": "high_motion", "C": "excessive_motion"}


def test_sample_status(spark):
    s = rows(spark, [("a", 0, False, None, 1.0, 0.0), ("b", 9, True, 0.1, 55.5, -3.0), ("c", 3, False, 0.1, 1.0, 0.0), ("d", 9, False, 0.6, 1.0, 0.0), ("e", 9, False, 0.4, 1.0, 0.0), ("f", 9, False, 0.2, 1.0, 0.0), ("g", 9, False, None, 1.0, 0.0)], "recording string, n_rois int, artifact boolean, synchrony double, max_dff double, min_dff double")
    got = {r["recording"]: (r["status"], r["eligible"], r["needs_regression"], r["reason"]) for r in refine.sample_status(s).collect()}
    assert got == {
        "a": ("NO_ROIS", False, False, "No ROIs detected"), "b": ("ARTIFACT", False, False, "Extreme dF/F (max=55.5, min=-3.0)"), "c": ("TOO_FEW_ROIS", False, False, "Only 3 ROIs (need >= 5)"),
        "d": ("SEVERE_NEUROPIL", False, True, "Severe neuropil (synchrony=0.600)"), "e": ("HIGH_NEUROPIL", True, True, "High neuropil (synchrony=0.400)"), "f": ("MILD_NEUROPIL", True, True, "Mild neuropil (synchrony=0.200)"), "g": ("OK", True, False, "Clean signal"),
    }


def test_one_outlier_does_not_fill_a_slice(spark):
    counted = rows(spark, [("m", float(k), 1) for k in range(1000)] + [("m", 1e12, 1)], "metric string, value double, n long")
    got = groups.running_counts(counted, ["metric"], "value", ["n"])
    assert {r["value"]: r["n_upto"] for r in got.collect()} == {**{float(k): k + 1 for k in range(1000)}, 1e12: 1001}
    bounds = counted.groupBy("metric").agg(F.percentile_approx("value", [k / groups.SLICES for k in range(1, groups.SLICES)], 1000).alias("b")).first()["b"]
    sizes = np.bincount([sum(b < k for b in bounds) for k in range(1000)])
    assert sizes.max() < 3 * 1000 / groups.SLICES


def long_of(spark, x, y):
    values = [("m", "x", k, float(v)) for k, v in enumerate(x)] + [("m", "y", 10_000 + k, float(v)) for k, v in enumerate(y)]
    return rows(spark, values, "metric string, condition string, sample long, value double")


@pytest.mark.parametrize("slice_values", [1000, 7])
def test_resampling_has_the_right_distribution(spark, monkeypatch, slice_values):
    monkeypatch.setattr(groups, "SLICE_VALUES", slice_values)
    monkeypatch.setattr(groups, "CHUNK", 150)
    rng = np.random.default_rng(0)
    x, y = np.round(rng.normal(0, 1, 50), 1), np.round(rng.normal(0.5, 1, 40), 1)
    means = groups.sample_means(long_of(spark, x, y))
    sums = groups.replicate_sums(means, "x", "y", 2000, 1).toPandas()
    per = sums.groupby("replicate")[["w1", "w2", "s1", "s2"]].sum()
    assert len(per) == 2000 and (per["w1"] == 50).all() and (per["w2"] == 40).all()
    diff = per["s2"] / per["w2"] - per["s1"] / per["w1"]
    want = [rng.choice(y, 40).mean() - rng.choice(x, 50).mean() for _ in range(4000)]
    assert diff.mean() == pytest.approx(np.mean(want), abs=0.02) and diff.std() == pytest.approx(np.std(want), rel=0.08)
    dealt = groups.replicate_sums(means, "x", "y", 600, 2, shuffle_labels=True).toPandas().groupby("replicate")[["w1", "w2", "s1", "s2"]].sum()
    assert (dealt["w1"] == 50).all() and np.allclose(dealt["s1"] + dealt["s2"], x.sum() + y.sum())
    both = np.concatenate([x, y])
    want = [(lambda b: b[50:].mean() - b[:50].mean())(rng.permutation(both)) for _ in range(3000)]
    assert (dealt["s2"] / 40 - dealt["s1"] / 50).std() == pytest.approx(np.std(want), rel=0.12)
    ci = groups.bootstrap_effect(means, "x", "y", 1500).first()
    want = np.percentile([groups.delta_of(rng.choice(x, 50), rng.choice(y, 40)) for _ in range(1500)], [2.5, 97.5])
    assert (ci["effect_low"], ci["effect_high"]) == pytest.approx(tuple(want), abs=0.05)


def nested_means(rng, samples, replicates):
    """Means of redrawn samples, each with values drawn anew every time that it comes."""
    k, out = len(samples), np.empty(replicates)
    for i in range(replicates):
        out[i] = np.concatenate([samples[j][rng.integers(0, len(samples[j]), len(samples[j]))] for j in rng.integers(0, k, k)]).mean()
    return out


@pytest.mark.parametrize("sizes", [(5,) * 20, (1, 2, 3, 4, 5) * 3, (40, 3, 12, 8)])
def test_hierarchical_bootstrap_against_numpy(spark, monkeypatch, sizes):
    """Intervals as wide as those of a double loop, within 3 percent; values by slices and blocks of a few."""
    monkeypatch.setattr(groups, "SLICE_VALUES", 3)
    monkeypatch.setattr(groups, "BLOCK_SLICES", 2)
    rng = np.random.default_rng(8)
    data = {c: [np.round(rng.normal(rng.normal(m, 0.3), 1, n), 2) for n in sizes] for c, m in (("x", 0), ("y", 1))}
    values = [("m", c, f"{c}{s}", float(v)) for c, samples in data.items() for s, x in enumerate(samples) for v in x]
    got = groups.hierarchical_bootstrap(rows(spark, values, "metric string, condition string, sample string, value double"), "x", "y", 20_000).first()
    x, y = (nested_means(rng, data[c], 20_000) for c in "xy")
    for low, high, want in (("low1", "high1", x), ("low2", "high2", y), ("ci_low", "ci_high", y - x)):
        a, b = np.percentile(want, [2.5, 97.5])
        assert got[high] - got[low] == pytest.approx(b - a, rel=0.03) and (got[high] + got[low]) / 2 == pytest.approx((a + b) / 2, abs=0.03 * (b - a))


@pytest.mark.parametrize("most", [10_000, 12])
def test_hierarchical_bootstrap_of_small_samples_takes_no_slices(spark, monkeypatch, most):
    """Samples of up to ``SAMPLE_VALUES`` values leave one sum a replicate and block; only larger ones are drawn by slices."""
    monkeypatch.setattr(groups, "SAMPLE_VALUES", most)
    sliced, whole = [], groups.replicate_sums

    def seen(values, *args, **more):
        sliced.append({r[0] for r in values.groupBy("metric").count().filter("count > 0").select("count").collect()})
        return whole(values, *args, **more)

    monkeypatch.setattr(groups, "replicate_sums", seen)
    rng = np.random.default_rng(3)
    data = {c: [np.round(rng.normal(rng.normal(m, 0.5), 1, n), 1) for n in (4, 30, 9, 20, 5, 7)] for c, m in (("x", 0), ("y", 1))}
    values = [("m", c, f"{c}{s}", float(v)) for c, samples in data.items() for s, x in enumerate(samples) for v in x]
    got = groups.hierarchical_bootstrap(rows(spark, values, "metric string, condition string, sample string, value double"), "x", "y", 4000).first()
    assert sliced == ([] if most == 10_000 else [{30, 20}])
    x, y = (nested_means(rng, data[c], 20_000) for c in "xy")
    for low, high, want in (("low1", "high1", x), ("low2", "high2", y), ("ci_low", "ci_high", y - x)):
        a, b = np.percentile(want, [2.5, 97.5])
        assert got[high] - got[low] == pytest.approx(b - a, rel=0.08) and (got[high] + got[low]) / 2 == pytest.approx((a + b) / 2, abs=0.06 * (b - a))


class Counted:
    """Random numbers, and how many were asked for."""

    def __init__(self, seed):
        self.rng, self.asked = np.random.default_rng(seed), 0

    def random(self, n):
        self.asked += n
        return self.rng.random(n)

    def integers(self, low, high, size, dtype):
        self.asked += int(np.prod(size))
        return self.rng.integers(low, high, size, dtype=dtype)

    def multinomial(self, n, p, size):
        self.asked += size * len(p)
        return self.rng.multinomial(n, p, size=size)


SAMPLES = {
    "cents": lambda rng: np.round(rng.uniform(900, 105_000, 300), 2),
    "whole": lambda rng: rng.integers(1, 51, 300).astype(float),
    "tenths": lambda rng: rng.integers(0, 11, 300) / 100,
    "any": lambda rng: rng.lognormal(size=300),
    "outlier": lambda rng: np.append(rng.normal(size=299), 1e6),
    "few": lambda rng: rng.choice([math.pi, math.e, -1.5], 300),
    "small": lambda rng: rng.normal(size=3),
    "same": lambda rng: np.full(300, 0.1),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_sums_of_draws(kind):
    """Sums of redrawn samples are as those of plain draws, and those of many values are not drawn value by value."""
    rng = np.random.default_rng(11)
    values, times, counted = SAMPLES[kind](rng), 20_000, Counted(12)
    got = groups.drawn_sums(counted, values, np.full(times, 2))
    want = values[rng.integers(0, len(values), (times, 2 * len(values)))].sum(axis=1)
    assert counted.asked <= (2 * times * 3 if kind != "outlier" else 2 * times * 300)
    spread = want.std()
    assert got.mean() == pytest.approx(want.mean(), abs=0.04 * spread + 1e-9) and got.std() == pytest.approx(spread, rel=0.03, abs=1e-9)
    at = np.percentile(want, [1, 5, 25, 50, 75, 95, 99]) + 1e-9
    assert np.searchsorted(np.sort(got), at) / times == pytest.approx(np.searchsorted(np.sort(want), at) / times, abs=0.02)
    assert (groups.drawn_sums(counted, values, np.array([0, 3, 0])) != 0).tolist() == [False, True, False]


def test_chances_of_sums():
    """Of values with a step each sum's chance, also where sums are told apart modulo a size only; of others the chances of cells."""
    rng = np.random.default_rng(13)
    one = np.bincount(rng.integers(0, 40, 50), minlength=64) / 50
    whole = np.ones(1)
    for _ in range(50):
        whole = np.convolve(whole, one[:40])
    assert groups.sum_chances(np.append(one, np.zeros(4096 - 64)), 50)[: len(whole)] == pytest.approx(whole, abs=1e-14)
    assert groups.sum_chances(one, 50) == pytest.approx(np.bincount(np.arange(len(whole)) % 64, whole), abs=1e-14)

    x, often = np.unique(rng.integers(0, 2000, 60), return_counts=True)
    one, whole = np.bincount(x, often / 60), np.ones(1)
    for _ in range(60):
        whole = np.convolve(whole, one)
    gap = x - often @ x / 60
    spread = math.sqrt(often @ (gap * gap))
    cells = groups.cell_chances(gap, often, spread)
    edges = 60 * (often @ x / 60) + spread * ((np.arange(len(cells)) + 0.5) * 2 * groups.REACH / len(cells) - groups.REACH)
    exact = np.append(0.0, np.cumsum(whole))[np.clip(np.floor(edges).astype(int) + 1, 0, len(whole))]
    assert np.abs(np.cumsum(cells) - exact).max() < 1e-4
    place = np.arange(len(cells)) * 2 * groups.REACH / len(cells) - groups.REACH
    inside = (2 * groups.REACH / len(cells)) ** 2 / 12
    third = (np.arange(len(whole)) - whole @ np.arange(len(whole))) ** 3 @ whole / spread**3
    assert (cells @ place, cells @ place**2 + inside, cells @ place**3) == pytest.approx((0, 1, third), abs=1e-9)
    assert groups.cell_chances(np.append(gap, 1e6), np.append(often, 1), 1e6) is None


def test_steps_and_paths_to_the_last_bit(spark):
    """Steps by squares and paths in the order of frames, bit by bit: equal recordings tie in ranks, in bins as in SQL."""
    rng = np.random.default_rng(5)
    shifts = {f"r{i}": rng.integers(-500, 500, (60, 2)) / 1000 * 0.26 for i in range(40)}
    data = [(r, k + 1, float(x), float(y), 1.0, 0.26, k >= 10, False) for r, xy in shifts.items() for k, (x, y) in enumerate(xy)]
    frames = rows(spark, data, "recording string, frame int, dx_um double, dy_um double, fps double, px_um double, post boolean, reposition boolean")
    steps = series.step_size(frames)
    want = {r: [0.0] + [math.sqrt(x * x + y * y) for x, y in np.diff(xy, axis=0)] for r, xy in shifts.items()}
    assert {(r["recording"], r["frame"]): r["step_um"] for r in steps.collect()} == {(r, k + 1): v for r, s in want.items() for k, v in enumerate(s)}
    got = series.post_settle_stats(steps, 1, 1, 0.1, 2, 5).collect()
    assert {r["recording"]: r["cum_path_ps"] for r in got} == {r: sum_in_order(s[10:]) for r, s in want.items()}


def test_angles_at_the_edge_of_a_sector(spark):
    """An angle that a rounding error keeps from 90, 180 or 270 degrees is in the sector that begins there, as in SQL."""
    angles = rows(spark, [(math.degrees(math.atan2(y, x)),) for x, y in ((1.1102230246251565e-16, 0.533), (-0.020020000000000093, 1.3877787807814457e-17), (-1e-17, -0.2), (0.3, -1e-17))], "angle double")
    assert {r["sector"]: r["n"] for r in series.angle_histogram(angles, "angle").collect()} == {3: 1, 6: 1, 9: 1, 0: 1}


def test_drift_angles_to_the_last_bit(spark):
    """As atan2 of the C library gives them; without a shift there is none."""
    rng = np.random.default_rng(6)
    ends = {f"r{i}": (float(x), float(y)) for i, (x, y) in enumerate([*(rng.integers(-500, 500, (300, 2)) / 1000 * 0.26), (-2.220446049250313e-16, -0.4706)])}
    data = [(r, k, a, b, 1.0) for r, (x, y) in ends.items() for k, a, b in ((1, 0.0, 0.0), (9, x, y))] + [("lost", 1, 0.0, 0.0, 1.0), ("lost", 9, None, None, 1.0)]
    got = {r["recording"]: r["drift_angle"] for r in series.net_drift(rows(spark, data, "recording string, frame int, dx_um double, dy_um double, fps double"), 3).collect()}
    assert got == {r: math.degrees(math.atan2(y, x)) for r, (x, y) in ends.items()} | {"lost": None}


def test_lilliefors_far_from_the_middle(spark):
    """Values of more than 14 deviations, for which the sum of 120 odd powers in the query's SQL is too short."""
    x = np.append(np.random.default_rng(7).normal(size=2000), [400.0, 500.0])
    got = groups.lilliefors(rows(spark, [("m", "c", float(v)) for v in x], "metric string, condition string, value double")).first()
    z = (np.sort(x) - x.mean()) / x.std(ddof=1)
    f, place = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z]), np.arange(len(x))
    assert z[-1] > 14 and got["d"] == pytest.approx(np.maximum((place + 1) / len(x) - f, f - place / len(x)).max(), abs=1e-12)


def test_draws_one_by_one_and_by_counts_are_alike():
    """Draws of few values a place, which go one by one, have the moments of a multinomial; shuffled labels those of a hypergeometric."""
    rng, n, k = np.random.default_rng(9), np.array([1, 4, 0, 2, 3]), np.full(20_000, 10)
    for c in (groups.drawn_counts(rng, k, n), groups.shared_out(rng, k, k, n, n, True)[0]):
        assert (c.sum(1) == 10).all() and (c[:, 2] == 0).all() and c.mean(0) == pytest.approx(n, abs=0.05)
    c1, c2 = groups.shared_out(rng, k, k, n, n[::-1], False)
    assert c1.var(0) == pytest.approx(n * (1 - n / 10), abs=0.1) and (c2[:, 2] == 0).all()


def test_added_slices_count_all_pairs(spark, monkeypatch):
    """Sums that tasks have added give the effect of every replicate that the slices give; each draw is made once."""
    monkeypatch.setattr(groups, "SLICE_VALUES", 4)
    monkeypatch.setattr(groups, "BLOCK_SLICES", 3)
    means = groups.sample_means(long_of(spark, range(30), range(10, 35)))
    parts = groups.replicate_sums(means, "x", "y", 60, 3).toPandas().sort_values("slice")
    won = parts["u"] + parts["w1"] * (parts.groupby("replicate")["w2"].cumsum() - parts["w2"])
    added = groups.replicate_sums(means, "x", "y", 60, 3, added=True).toPandas().groupby("replicate")[["w1", "w2", "s1", "s2", "u"]].sum()
    want = parts.assign(u=won).groupby("replicate")[["w1", "w2", "s1", "s2", "u"]].sum()
    assert np.allclose(added, want) and len(added) == 60


def test_percentiles_take_their_rows_once(spark):
    """What is costly before the percentiles, as resampling, is not done a second time for their sizes."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    long = rows(spark, [("m", float(v)) for v in range(50)], "metric string, value double").mapInPandas(look, "metric string, value double")
    assert groups.percentiles(long, ["metric"], {"median": 50}).first()["median"] == 24.5 and seen.value == 50


@pytest.mark.parametrize("slices", [2, 9, 11, 40])
def test_values_find_their_slices(spark, monkeypatch, slices):
    """However many slices there are, each value has the total up to itself."""
    monkeypatch.setattr(groups, "SLICES", slices)
    counted = rows(spark, [("m", float(v * v), 1 + v % 3) for v in range(100)], "metric string, value double, n long")
    got = groups.running_counts(counted, ["metric"], "value", ["n"]).orderBy("value").collect()
    assert [r["n_upto"] for r in got] == np.cumsum([1 + v % 3 for v in range(100)]).tolist()


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_synchrony_of_a_half_is_not_above_it(spark, tmp_path):
    """Discounts whose mean is 0.05, added in any order."""
    from motionspark.jobs import group_queries

    rng = np.random.default_rng(2)
    lines = [("F", s, 1, "N", 9.0, float(d), 0.01) for s in range(1, 13) for d in rng.permutation([k / 100 for k in range(11)] * 7)]
    path = f"{tmp_path}/lineitem.parquet"
    rows(spark, lines, "l_linestatus string, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_discount double, l_tax double").repartition(7).write.parquet(path)
    assert {r["synchrony"] for r in group_queries.refined(spark, str(tmp_path)).collect()} == {0.5}
    assert group_queries.QUERIES["st10_sample_quality_counts"](spark, str(tmp_path)).first()["n_high_synchrony"] == 0


def test_motion_quality_counts_judge_every_recording(spark, tmp_path):
    """Recordings by the quality that their frames give; no other table is read."""
    from motionspark.jobs import group_queries

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    got = group_queries.QUERIES["st10_motion_quality_counts"](spark, str(tmp_path)).collect()
    users = spark.read.parquet(f"{tmp_path}/events.parquet").select("user_id").distinct().count()
    assert sum(r["good"] + r["high_motion"] + r["spiky"] for r in got) == users and {r["group"] for r in got} == {"control", "experimental"}


def test_equal_samples_tie(spark):
    """The same prices in any order and partition: one mean, so the rank correlation has its ties."""
    rng = np.random.default_rng(6)
    prices = np.round(rng.random(300) * 1e5, 2)
    values = [("price", "F", s, float(v)) for s in range(20) for v in rng.permutation(prices)]
    long = rows(spark, values, "metric string, condition string, sample long, value double").repartition(9)
    assert {r["mean"] for r in groups.sample_means(long).collect()} == {math.fsum(prices) / 300}


def test_counted_values_serve_every_statistic(spark, monkeypatch):
    """Box statistics and comparisons write counts of different values, never all rows."""
    written, whole = [], groups.checkpointed

    def seen(df):
        out = whole(df)
        written.append(out.count())
        return out

    values = [("m", c, s, float(v % 7)) for c, n in (("x", 700), ("y", 560)) for s in range(2) for v in range(n)]
    long = rows(spark, values, "metric string, condition string, sample int, value double")
    plain, counted = groups.moments(long, "x", "y").first(), groups.moments(groups.counted_values(long), "x", "y", counted=True).first()
    assert tuple(plain)[1:] == pytest.approx(tuple(counted)[1:]) and tuple(groups.rank_sums(long, "x", "y").first())[:5] == tuple(groups.rank_sums(groups.counted_values(long), "x", "y", counted=True).first())[:5]
    for module in (groups, tables):
        monkeypatch.setattr(module, "checkpointed", seen)
    assert {r["n_outliers"] for r in groups.box_stats(long).collect()} == {0} and tables.compare_conditions(long, "x", "y").first()["n1"] == 1400
    assert max(written) <= 14


def test_draws_are_shared_out_among_blocks(spark, monkeypatch):
    """A metric of several blocks: every replicate draws as many values as there are, and any value can come."""
    monkeypatch.setattr(groups, "SLICE_VALUES", 4)
    monkeypatch.setattr(groups, "BLOCK_SLICES", 3)
    monkeypatch.setattr(groups, "CHUNK", 40)
    means = groups.sample_means(long_of(spark, range(30), range(100, 125)))
    for shuffle in (False, True):
        sums = groups.replicate_sums(means, "x", "y", 100, 3, shuffle_labels=shuffle).toPandas()
        per = sums.groupby("replicate")[["w1", "w2"]].sum()
        assert len(per) == 100 and (per["w1"] == 30).all() and (per["w2"] == 25).all() and sums["slice"].nunique() == 14


def slow_rank_p(x, y):
    both = [*x, *y]
    rank = {v: (sum(w < v for w in both) + 1 + sum(w <= v for w in both)) / 2 for v in both}
    ranks = [rank[v] for v in both]
    seen, sums = sum(ranks[: len(x)]), [sum(c) for c in combinations(ranks, len(x))]
    return min(1.0, 2 * min(np.mean([s <= seen + 1e-9 for s in sums]), np.mean([s >= seen - 1e-9 for s in sums])))


def test_exact_ranks_with_ties_against_enumeration(spark):
    rng = np.random.default_rng(5)
    cases = {f"m{i}": (rng.integers(0, 6, int(rng.integers(1, 7))).tolist(), rng.integers(0, 6, int(rng.integers(1, 8))).tolist()) for i in range(50)}
    values = [(m, c, float(v)) for m, (x, y) in cases.items() for c, side in (("x", x), ("y", y)) for v in side]
    got = {r["metric"]: r["p"] for r in groups.mann_whitney(groups.rank_sums(rows(spark, values, "metric string, condition string, value double"), "x", "y")).collect()}
    assert all(got[m] == pytest.approx(slow_rank_p(x, y), abs=1e-12) for m, (x, y) in cases.items())


def test_which_rank_tests_are_exact(spark):
    """A plain call is exact for a smaller group below 10 and fewer than 20 values; the other stage asks for it below 20 each."""
    x, y = [1.0, 2.0, 14.5], [float(v) for v in range(3, 15)]
    ranks = groups.rank_sums(long_of(spark, x, y), "x", "y")
    assert groups.mann_whitney(ranks, groups.exact_if_small).first()["p"] == pytest.approx(slow_rank_p(x, y), abs=1e-12)
    ten = groups.rank_sums(long_of(spark, range(10), range(5, 15)), "x", "y")
    far, near = groups.mann_whitney(ten, groups.exact_if_small).first(), groups.mann_whitney(ten).first()
    assert far["p"] == pytest.approx(math.erfc(abs(far["z"]) / math.sqrt(2))) and near["p"] == pytest.approx(slow_rank_p(list(range(10)), list(range(5, 15))), abs=1e-12) and abs(far["p"] - near["p"]) > 1e-4
    large = groups.rank_sums(long_of(spark, range(25), range(25)), "x", "y")
    assert groups.mann_whitney(large).first()["p"] == 1.0


def test_p_of_rank_correlations(spark):
    """Tabled: rho 0.829 of 6 and 0.643 of 8 rows have two-sided p of 0.058 and 0.096; beyond that Student's t."""
    six, eight = [1, 2, 3, 4, 6, 5], [2, 1, 4, 6, 3, 5, 8, 7]
    more = [(float(k), float((k * 7) % 20)) for k in range(20)]
    pairs = [("a", float(k), float(v)) for k, v in enumerate(six)] + [("b", float(k), float(v)) for k, v in enumerate(eight)] + [("c", *p) for p in more] + [("d", 1.0, float(k)) for k in range(5)]
    pairs += [("e", *p) for p in ((1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (4.0, 7.0), (5.0, 6.0))]
    got = {r["g"]: r for r in tables.spearman(rows(spark, pairs, "g string, x double, y double"), "g", "x", "y").collect()}

    def slow(x, y):
        a, b = (np.array([(np.sum(np.array(v) < w) + 1 + np.sum(np.array(v) <= w)) / 2 for w in v]) for v in (x, y))
        sums = np.array([a @ np.array(p) for p in permutations(b)])
        return min(1.0, 2 * min((sums >= a @ b - 1e-9).mean(), (sums <= a @ b + 1e-9).mean()))

    assert got["a"]["p"] == pytest.approx(slow(range(6), six)) and got["b"]["p"] == pytest.approx(slow(range(8), eight))
    assert got["e"]["p"] == pytest.approx(slow([1, 1, 2, 4, 5], [2, 3, 3, 7, 6]))
    rho = got["c"]["rho"]
    assert got["c"]["p"] == pytest.approx(special.t_two_sided(rho * math.sqrt(18 / (1 - rho * rho)), 18))
    assert got["d"]["p"] in (None, 1.0)


def test_p_of_normality(spark):
    """Of normal samples about 5 percent are rejected, whatever their size; and the p is even up to a half."""
    rng = np.random.default_rng(3)
    values = [(f"n{n}", str(i), float(v)) for n in (5, 12, 60, 300) for i in range(400) for v in rng.normal(7, 3, n)]
    got = groups.lilliefors(rows(spark, values, "metric string, condition string, value double")).toPandas()
    for _, own in got.groupby("metric"):
        assert len(own) == 400 and own["rejected"].mean() == pytest.approx(0.05, abs=0.03) and (own["p"] <= 0.25).mean() == pytest.approx(0.25, abs=0.06) and own["p"].between(0.001, 0.5).all()
    flat = rows(spark, [("m", "x", 1.0)] * 5 + [("m", "y", float(v)) for v in (1, 2, 4)] + [("m", "z", math.exp(v / 4)) for v in range(40)], "metric string, condition string, value double")
    found = {r["condition"]: r for r in groups.normality(flat).collect()}
    assert (found["x"]["test"], found["x"]["non_normal"]) == ("moments", False) and (found["y"]["test"], found["y"]["non_normal"]) == (None, None)
    assert (found["z"]["test"], found["z"]["non_normal"], found["z"]["p"]) == ("Lilliefors", True, 0.001)


def test_first_column_of_the_tables_counts(spark):
    """A recording without a settled part has no value, not that of the whole; its duration is drift over drift rate."""
    judged = rows(spark, [("S1", "a", True, 2.0, 0.5, 0.1, 9.0, None, 7.0, 3.0, 0.2), ("S2", "a", True, None, None, None, None, None, 7.0, 3.0, 0.2), ("S3", "a", False, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.1), ("S4", "b", True, 3.0, 0.0, 0.1, 9.0, 4.0, 7.0, 3.0, 0.2)],
                  "recording string, group string, movement_valid boolean, net_drift_ps double, drift_rate_ps double, med_step_ps double, cum_path_ps double, jitter_ratio double, cum_path double, median_step double, pegged double")
    drift = rows(spark, [(f"S{k}", 99.0, 88.0, 45.0) for k in range(1, 5)], "recording string, net_drift double, drift_rate double, drift_angle double")
    got = {r["File"]: r for r in tables.per_file_metrics(judged, drift).collect()}
    assert set(got) == {"S1.avi", "S2.avi", "S4.avi"}
    assert tuple(got["S1.avi"])[2:] == (2.0, 0.5, 45.0, 0.1, 9.0, 4.5, 4.0, 2.25)
    assert tuple(got["S2.avi"])[2:] == (None, None, 45.0, None, None, None, None, None)
    assert got["S4.avi"]["duration_s"] is None and got["S4.avi"]["jitter_ratio"] == 4.0
    whole = tables.per_file_metrics(judged.drop("net_drift_ps", "drift_rate_ps").withColumn("duration_s", F.lit(60)), drift).filter("File = 'S1.avi'").first()
    assert (whole["net_drift"], whole["drift_rate"], whole["duration_s"]) == (99.0, 88.0, 60.0)


def test_samples_of_all_versions_are_read_together(spark, tmp_path):
    kind = "condition string, sample string, snr array<double>, event_rate array<double>"
    rows(spark, [("a", "plain", [1.0, 3.0], [0.5, 0.5]), ("b", "empty", [], [])], kind).write.parquet(f"{tmp_path}/v=1")
    old = f"{kind}, motion_quality string, refinement struct<n_original: long, n_removed: long, removed_shape: long, removed_correlated: long>"
    rows(spark, [("a", "old", [2.0], [1.0], "good", (4, 3, 1, 2))], old).write.parquet(f"{tmp_path}/v=2")
    new = f"{kind}, synchrony double, event_amplitude array<double>, baseline_flag array<boolean>, refinement struct<n_original: long, n_removed: long, removal_counts: struct<shape: long, correlation: long, edge_contact: long>>"
    rows(spark, [("a", "new", [5.0], [2.0], 0.7, [0.25], [True], (2, 1, (0, 3, 1))), ("a", "none", [], [], 0.9, [], [], (0, 0, (0, 0, 0)))], new).write.parquet(f"{tmp_path}/v=3")
    read = tables.read_samples(spark, str(tmp_path))
    got = {r["sample"]: r for r in tables.sample_table(read).collect()}
    pick = lambda s, *names: tuple(got[s][n] for n in names)
    names = ("n_original", "n_refined", "n_removed", "pct_removed", "removed_shape", "removed_correlated", "removed_edge", "pct_correlated_removed", "mean_snr", "synchrony", "motion_quality", "pct_baseline_flagged")
    assert pick("plain", *names) == (2, 2, 0, 0.0, 0, 0, 0, 0.0, 2.0, None, "unknown", 0.0)
    assert pick("empty", *names) == (0, 0, 0, 0.0, 0, 0, 0, 0.0, None, None, "unknown", 0.0)
    assert pick("old", *names) == (4, 1, 3, 75.0, 1, 2, 0, 50.0, 2.0, None, "good", 0.0)
    assert pick("new", *names) == (2, 1, 1, 50.0, 0, 3, 1, 100.0, 5.0, 0.7, "unknown", 100.0)  # more removals than regions: at most 100 percent
    assert pick("none", *names) == (0, 0, 0, 0.0, 0, 0, 0, 0.0, None, None, "unknown", 0.0)
    whole = {r["condition"]: r for r in tables.group_summary(tables.sample_table(read), read).collect()}
    assert (whole["a"]["n_samples"], whole["a"]["total_rois"], whole["a"]["mean_snr"], whole["a"]["mean_synchrony"]) == (4, 4, 2.75, 0.7) and whole["b"]["mean_snr"] is None


def test_better_half_of_odd_numbers(spark):
    ranked = rows(spark, [("a", 1, 2), ("a", 3, None), ("b", 2, 1), ("b", 4, 3), ("b", 5, None)], "c string, m_rank int, k_rank int")
    got = {(r["metric"], r["condition"]): (r["n"], r["n_better_half"]) for r in groups.better_half(ranked, ["m", "k"], "c").collect()}
    assert got == {("m", "a"): (2, 1), ("m", "b"): (3, 1), ("k", "a"): (1, 0), ("k", "b"): (2, 1)}


def test_permutation_p(spark):
    means = groups.sample_means(long_of(spark, [1, 2, 3], [10, 11, 12]))
    # of the 20 ways to deal six values, two are as far apart
    assert groups.permutation_test(means, "x", "y", 4000, plain=True).first()["p_permutation"] == pytest.approx(0.1, abs=0.02)
    same = groups.sample_means(long_of(spark, [5, 5], [5, 5]))
    assert groups.permutation_test(same, "x", "y", 50, plain=True).first()["p_permutation"] == 1.0
    assert groups.permutation_test(same, "x", "y", 50).first()["p_permutation"] == 1.0


def test_forest_table_uses_one_vector_for_both(spark):
    rng = np.random.default_rng(1)
    values = [("m", c, s, float(v)) for c, shift in (("x", 0.0), ("y", 1.0)) for s in range(6) for v in rng.normal(shift, 1, 30)]
    got = {r["metric"]: r for r in groups.forest_table(rows(spark, [(m, c, s + 100 * (c == "y"), v) for m, c, s, v in values], "metric string, condition string, sample long, value double"), "x", "y", 400).collect()}
    assert set(got) == {"m", "all_m"} and all(r["effect_low"] <= r["delta"] <= r["effect_high"] for r in got.values())


def test_tabled_p_values(spark):
    m = rows(spark, [("a", 5, 0.0, 1.0, 5, 2.306 * math.sqrt(0.4), 1.0)], "metric string, n1 long, m1 double, v1 double, n2 long, m2 double, v2 double")
    got = groups.welch_t(m).first()
    assert got["df"] == pytest.approx(8) and got["p"] == pytest.approx(0.05, abs=2e-4)
    long = long_of(spark, range(100, 130), [v + 0.5 for v in range(112, 142)])
    r = groups.mann_whitney(groups.rank_sums(long, "x", "y"))
    z = r.first()["z"]
    assert r.first()["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)


def test_places_by_ranges(spark):
    values = [(k, None if k % 7 == 0 else (k * 37) % 50) for k in range(300)]
    got = {r["id"]: r["place"] for r in groups.places(rows(spark, values, "id int, v int").repartition(5), ["v", "id"], "place").collect()}
    want = sorted(values, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {k: place for place, (k, _) in enumerate(want, 1)}


def test_spearman_and_conclusions(spark):
    df = rows(spark, [("a", float(x), float(y)) for x, y in ((1, 1), (2, 3), (2, 2), (4, 9), (5, 5))] + [("b", 1.0, 2.0), ("a", None, 3.0)], "c string, x double, y double")
    got = tables.spearman(df, "c", "x", "y").collect()
    want = np.corrcoef([1, 2.5, 2.5, 4, 5], [1, 3, 2, 5, 4])[0, 1]
    assert len(got) == 1 and got[0]["n"] == 5 and got[0]["rho"] == pytest.approx(want)
    c = rows(spark, [("mean_speed", 2.0, 1.0, -1.2, -2.0, -0.5, 0.01), ("path", -1.0, 1.0, 0.3, -1.0, 3.0, None)], "metric string, m1 double, m2 double, g double, ci_low double, ci_high double, q double")
    found = {r["metric"]: r for r in tables.conclusions(c).collect()}
    assert found["mean_speed"][1:] == (-50.0, "decrease", "large", True, True, True) and found["path"][1:] == (200.0, "increase", "small", True, False, False)
    counts = tables.conclusion_counts(tables.conclusions(c)).first()
    assert tuple(counts) == (1, 1, 0, 1, 50.0)


def test_compare_tables_have_all_columns(spark):
    rng = np.random.default_rng(2)
    long = long_of(spark, rng.normal(0, 1, 12), rng.normal(2, 1, 12))
    got = tables.compare_groups(long, "x", "y", 500).first()
    assert got["p_permutation"] < 0.02 and got["q"] == got["p_permutation"] and got["ci_low"] < got["mean_diff"] < got["ci_high"] and got["normal1"] is not None and got["label2"] == "y"
    both = tables.compare_conditions(long, "x", "y").first()
    assert both["significant"] and not both["significant_but_negligible"] and both["median2"] > both["median1"]


def test_windows_of_all_modes(spark):
    df = rows(spark, [(100, 60, 0.5)], "height int, width int, px_um double")
    px = lambda *a, **k: tuple(series.max_shift(df, *a, **k).select("max_shift_px_y", "max_shift_px_x").first())
    assert px("auto") == (24, 24) and px("auto_extreme") == (29, 29) and px("auto_conservative") == (6, 6)
    assert px("fixed_px", 40) == (40, 29) and px("fixed_um", (10.0, 5.0)) == (20, 10)
    assert px("auto", stage="movement") == (18, 18) and px("auto_conservative", stage="movement") == (29, 29) and px("auto_loose", stage="movement") == (29, 29)
    assert px("fixed_px", 40, stage="movement") == (29, 29)
    own = rows(spark, [("R", 1, 9.9, 0.0, 10.0, 5.0), ("R", 2, 0.0, 4.95, 10.0, 5.0), ("R", 3, 5.0, 4.8, 10.0, 5.0)], "recording string, frame int, dx_um double, dy_um double, max_shift_um_x double, max_shift_um_y double")
    assert [r["is_pegged"] for r in series.pegged(own).orderBy("frame").collect()] == [True, True, False]
    one = own.drop("max_shift_um_x", "max_shift_um_y").withColumn("max_shift_um", F.lit(6.0))
    assert [r["is_pegged"] for r in series.pegged(one).orderBy("frame").collect()] == [True, False, False]


def test_spectra_are_drawn_on_outside_their_grid(spark):
    s = rows(spark, [("a", 1.0, 1.0), ("a", 2.0, 3.0), ("b", 0.0, 0.0), ("b", 4.0, 8.0), ("c", 1.0, 5.0)], "recording string, f double, p double")
    grid = rows(spark, [(0.0,), (1.0,), (1.5,), (3.0,)], "f double")
    got = {(r["recording"], r["f"]): r["p"] for r in series.resampled(s, grid).collect()}
    assert [got["a", f] for f in (0.0, 1.0, 1.5, 3.0)] == [-1.0, 1.0, 2.0, 5.0] and [got["b", f] for f in (0.0, 1.0, 3.0)] == [0.0, 2.0, 6.0] and got["c", 1.0] is None


def test_list_file_comes_first(spark, tmp_path):
    (tmp_path / "list.txt").write_text("A B\n\n C\n")
    rec = rows(spark, [("A",), ("B",), ("D",)], "recording string")
    cand = rows(spark, [("A", False, True), ("D", True, True)], "Stem string, ROI_ELIGIBLE boolean, MOVEMENT_VALID boolean")
    listed = files.read_list(spark, str(tmp_path / "list.txt"))
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(files.eligible(rec, cand, listed=listed)) == ["A", "B"] and names(files.eligible(rec, cand)) == ["D"]
    assert names(files.eligible(rec, cand, "MOVEMENT_VALID", listed)) == ["A", "D"] and names(files.eligible(rec, None)) == ["A", "B", "D"]


def test_written_shifts_are_read_back(spark, tmp_path):
    f = rows(spark, [("S1", 1, 1.0, None), ("S1", 2, 2.0, 4.0), ("S2", 1, 0.5, 0.5)], "recording string, frame int, dx_px double, dy_px double")
    files.write_shifts(f, str(tmp_path / "x"))
    got = sorted(tuple(r)[:4] for r in files.read_shifts(spark, str(tmp_path / "x"), px_um=0.5, glob="*.csv").collect())
    assert got == [("S1", 1, 0.5, None), ("S1", 2, 1.0, 2.0), ("S2", 1, 0.25, 0.25)]


def test_savgol_ends_are_least_squares():
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    got = kernels.savgol(x, 50.0)
    half = 7 // 2 if len(x) > 7 else 0
    for win in (5, 7, 9):
        t = np.arange(win)
        fit = np.polyval(np.polyfit(t, x[:win], 3), t)
        if np.allclose(got[: win // 2], fit[: win // 2]):
            half = win // 2
            break
    else:
        raise AssertionError("no window fits")
    mid = 20
    t = np.arange(-half, half + 1)
    assert got[mid] == pytest.approx(np.polyval(np.polyfit(t, x[mid - half : mid + half + 1], 3), 0))


def maps_of(spark, cn, pnr, mask=None):
    h, w = cn.shape
    mask = np.ones((h, w), bool) if mask is None else mask
    return rows(spark, [("R", y, x, 1.0, float(cn[y, x]), float(pnr[y, x]), bool(mask[y, x])) for y in range(h) for x in range(w)], "recording string, y int, x int, mean double, cn double, pnr double, in_mask boolean")


def test_even_maps_give_peak_seeds_only(spark):
    rng = np.random.default_rng(4)
    cn = 0.8 + 0.05 * rng.random((20, 20))
    pnr = 1 + rng.random((20, 20))
    pnr[6, 6] = pnr[14, 12] = 30
    maps = maps_of(spark, cn, pnr)
    stats = movies.map_stats(maps)
    s = stats.first()
    assert s["cn_uniform"] and s["weak_signal_mode"] and s["effective_min_pnr"] == pytest.approx(2.25) and s["effective_min_corr"] == pytest.approx(0.24) and s["data_quality"] == "normal"
    levels = movies.threshold_levels(stats)
    seeds = movies.find_regions(maps, levels, 2.0, 1, 50, grow=False).collect()
    assert seeds and {r["level"] for r in seeds} == {4}
    got = movies.detection_thresholds(stats, levels, movies.find_regions(maps, levels, 2.0, 1, 50, grow=False)).first()
    assert got["method"] == "pnr_only" and (got["cn"], got["pnr"]) == (0.3, 3.0)


def test_map_stats_stay_in_the_mask(spark):
    cn = np.arange(16.0).reshape(4, 4) / 100
    mask = np.zeros((4, 4), bool)
    mask[1:3, 1:3] = True
    s = movies.map_stats(maps_of(spark, cn, cn * 10 + 5, mask)).first()
    inside = cn[1:3, 1:3].ravel()
    assert s["cn_max"] == inside.max() and s["cn_std"] == pytest.approx(inside.std(ddof=1)) and s["cn_p95"] == pytest.approx(kernels.hazen(inside, 95)) and s["data_quality"] == "poor_correlation" and not s["weak_signal_mode"]
    last = movies.detection_thresholds(movies.map_stats(maps_of(spark, cn, cn, mask)), movies.threshold_levels(movies.map_stats(maps_of(spark, cn, cn, mask))), rows(spark, [], "recording string, roi_id int, level int")).first()
    assert last["method"] == "none" and last["n_rois"] == 0 and last["pnr"] == pytest.approx(2.25) and movies.zero_roi_diagnostics(movies.map_stats(maps_of(spark, cn, cn, mask)), rows(spark, [], "recording string, n_rois long")).count() == 13


def trace(n=300, fps=10.0):
    """A trace that passes all criteria: noise and events that rise at once and decay in a second."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-0.02, 0.02, n)
    for s in (40, 120, 200):
        x[s : s + 40] += np.concatenate([np.linspace(0, 1, 5)[1:], np.exp(-np.arange(36) / 8)])
    return x


def test_each_criterion_removes_one_region(spark):
    rng = np.random.default_rng(6)
    noise = lambda size: rng.uniform(-size, size, 300)
    dff = {k: np.roll(trace(), 23 * k) + noise(0.001) for k in range(11)}
    dff[3] = noise(0.02)
    dff[3][50] = -1.0
    dff[4] = noise(0.02) + 0.7 * (np.arange(300) > 100) + 0.7 * (np.arange(300) > 200)
    dff[6] = np.where(np.arange(300) < 140, noise(0.1), 0.45)
    dff[7] = dff[0] + noise(0.0001)
    values = []
    for k in range(11):
        values.append(("R", "c", k, dff[k].tolist(), (200.0 if k == 1 else 5.0 + 0.01 * (10 - k)), 0 if k == 9 else 3, 0.5, 10.0, float(20 * k if k != 8 else 2.0), 5.0, "edge_contact" if k == 2 else None, "shape_extent" if k == 5 else None))
    rois = rows(spark, values, "recording string, condition string, roi_id long, dff array<double>, snr double, event_count int, event_rate double, fps double, center_x double, center_y double, c_edge string, c_shape string")
    measured = refine.trace_criteria(rois.withColumn("dff_smooth", F.col("dff")), max_plateau_s=15).withColumn("c_kinetics", F.lit(None).cast("string"))
    measured = measured.withColumn("c_drift", F.when(F.col("roi_id") == 10, "baseline_drift"))
    got = refine.refine(measured, most_corr=0.98)
    found = {r["roi_id"]: (r["category"], r["reason"]) for r in got.collect()}
    assert {k: c for k, (c, _) in found.items()} == {
        0: None, 1: "extreme_snr", 2: "edge_contact", 3: "kinetics_negative", 4: "kinetics_step", 5: "shape_extent", 6: "kinetics_plateau", 7: "correlation", 8: "spatial", 9: "inactive", 10: "baseline_drift"
    }
    assert found[1][1] == "SNR too high (200.0 > 150.0)" and found[7][1].startswith("Correlated with ROI 0 (r=") and found[8][1] == "Too close to ROI 0 (2.0 px)" and found[9][1] == "No events (0 < 1)" and found[3][1].startswith("Negative transient (z=-")
    counts = refine.removal_counts(got).first().asDict()
    assert counts == {"recording": "R", "snr": 1, "edge": 1, "shape": 1, "negative": 1, "step": 1, "kinetics": 0, "plateau": 1, "corr": 1, "spatial": 1, "inactive": 1, "baseline": 1}
    merged = refine.category_counts(got).first().asDict()
    assert merged["kinetics"] == 3 and merged["shape"] == 1 and merged["baseline"] == 1
    summary = refine.refinement_summary(got)
    s = summary.first()
    assert (s["n_original"], s["n_refined"], s["n_removed"], s["removed_shape"], s["motion_quality"], s["synchrony_score"]) == (11, 1, 10, 1, "unknown", None)
    by = refine.refinement_by_condition(summary).first()
    assert (by["n_files"], by["total_rois_original"], by["total_kinetics_removed"], by["total_edge_removed"]) == (1, 11, 3, 1)
    log = {r["ROI_Original"]: r for r in refine.refinement_log(got).collect()}
    assert log[0]["Kept"] and log[0]["Category"] == "" and log[8]["Removal_Reason"] == found[8][1]
    assert refine.rejection_examples(got, 1, 3).count() == 3
    assert [tuple(r) for r in refine.refined_rois(got).select("roi_id", "roi_original").collect()] == [(1, 0)]


def test_chunks_give_what_whole_recordings_give(spark, monkeypatch):
    """Passes by chunks of frames against NumPy on the whole movie, and no window or exchange by recording holds pixels."""
    monkeypatch.setattr(movies, "CHUNK", 7)
    rng = np.random.default_rng(7)
    film = rng.normal(100, 5, (40, 9, 11))
    df = rows(spark, [("R", k + 1, 9, 11, f.ravel().tolist()) for k, f in enumerate(film)], "recording string, frame int, height int, width int, pixels array<double>").repartition(3)
    change = {r["frame"]: r["d"] for r in movies.frame_changes(df, 7).collect()}
    assert change == pytest.approx({k + 1: float(np.median(np.abs(film[k] - film[k - 1]))) for k in range(1, 40)})
    got = {(r["y"], r["x"]): (r["mean"], r["std"]) for r in movies.pixel_mean_std(df).collect()}
    assert all(got[y, x] == pytest.approx((film[:, y, x].mean(), film[:, y, x].std(ddof=1))) for y in range(9) for x in range(11))
    masks = rows(spark, [("R", 1, 2, 3), ("R", 1, 2, 4), ("R", 2, 5, 5), ("R", 2, 6, 5), ("R", 2, 6, 6)], "recording string, roi_id int, y int, x int")
    found = {(r["roi_id"], r["frame"]): r["f"] for r in movies.extract_traces(df, masks, "median").collect()}
    assert len(found) == 80 and found[2, 33] == pytest.approx(np.median([film[32, 5, 5], film[32, 6, 5], film[32, 6, 6]])) and found[1, 8] == pytest.approx(film[7, 2, 3:5].mean())
    signal = movies.global_signal(df, masks, 40, 10).first()["signal"]
    free = np.ones((9, 11), bool)
    free[[2, 2, 5, 6, 6], [3, 4, 5, 5, 6]] = False
    assert signal == pytest.approx(film[:, free].mean(1))
    base = movies.template(df, rows(spark, [("R", 5)], "recording string, start int"), 10).first()["template"]
    assert base == pytest.approx(film[4:14].mean(0).ravel())
    for plan in (movies.quiet_window(df, 10, 10, 1), movies.cn_pnr_maps(df, 20), movies.pixel_mean_std(df), movies.extract_traces(df, masks)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert not any("pixels" in line for line in text.split("\n") if "Window [" in line or "Generate explode(pixels" in line or "posexplode(pixels" in line)


def test_shape_reasons(spark):
    s = rows(spark, [("R", 1, 0.1, 0.5, 1.0, 0.9, 0.1), ("R", 2, 0.5, 0.99, 1.0, 0.9, 0.1), ("R", 3, 0.5, 0.5, 1.0, 0.9, 0.1)], "recording string, roi_id int, compactness double, extent double, aspect double, solidity double, eccentricity double")
    got = {r["roi_id"]: (r["c_shape"], r["why_shape"]) for r in movies.reject_shape(s).collect()}
    assert got == {1: ("shape_compactness", "Low compactness (0.10 < 0.20)"), 2: ("shape_extent", "High extent (0.99 > 0.95) - rectangular"), 3: (None, None)}
    assert images.hazen(np.array([1.0, 2.0]), 50) == 1.5 and traces is not None


def test_spike_header_and_candidates(spark):
    assert gates.spike_header(3.0) == "SpikeFrac_postSettle_over_3um_per_s" and gates.spike_header(0.25) == "SpikeFrac_postSettle_over_0p25um_per_s"
    c = rows(spark, [("A", True), ("B", False)], "Stem string, ROI_ELIGIBLE boolean")
    assert [r[0] for r in gates.candidate_list(c).collect()] == ["A"]


def test_traces_of_one_file_go_to_many_tasks(spark, tmp_path, monkeypatch):
    """A table that is one file with one row group is measured by all tasks, and the peaks and ends of a trace are looked at once."""
    from motionspark.jobs import trace_queries

    values = [(k, [float(v) for v in np.random.default_rng(k).normal(size=64)], k % 2) for k in range(200)]
    spark.createDataFrame(values, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    at = trace_queries.criteria(spark, str(tmp_path)).select(F.spark_partition_id().alias("p"), "c_kinetics").groupBy("p").count().collect()
    assert len(at) > 8 and max(r["count"] for r in at) < 50 and sum(r["count"] for r in at) == 200
    calls = {"kinetics_values": 0, "drift_values": 0}

    def counted(name, real):
        def run(*args):
            calls[name] += 1
            return real(*args)

        return run

    for name in calls:
        monkeypatch.setattr(kernels, name, counted(name, getattr(kernels, name)))
    x = np.asarray(values[0][1])
    got = refine.trace_measures(x, x, 2.0, 0.5)
    assert calls == {"kinetics_values": 1, "drift_values": 1}
    assert (got[3], got[9]) == (kernels.kinetics(x, 2.0), kernels.drifted(x, 2.0))
