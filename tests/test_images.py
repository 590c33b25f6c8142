"""Images of real size and parts of images, against plain forms; maps by bands; greedy rounds against a walk."""

import time

import numpy as np
import pytest

from motionspark.functions import images, kernels
from motionspark.operators import movies, rounds


def slow_components(mask, diagonal=True, values=None):
    h, w = mask.shape
    label = np.zeros((h, w), int)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not label[y, x]:
            stack, label[y, x] = [(y, x)], y * w + x + 1
            while stack:
                a, b = stack.pop()
                for da, db in steps:
                    c, d = a + da, b + db
                    if 0 <= c < h and 0 <= d < w and mask[c, d] and not label[c, d] and (values is None or values[c, d] == values[a, b]):
                        label[c, d] = y * w + x + 1
                        stack.append((c, d))
    return label


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.6, 0.9, 1.0])
def test_parts_by_runs(share):
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (1, 30), (30, 1), (23, 31)):
        mask, values = rng.random((h, w)) < share, rng.integers(0, 2, (h, w))
        for diagonal in (True, False):
            assert (images.components(mask, diagonal) == slow_components(mask, diagonal)).all()
            assert (images.components(mask, diagonal, values) == slow_components(mask, diagonal, values)).all()


def test_spirals_are_one_part():
    mask = np.zeros((101, 101), bool)
    y = x = 50
    for k in range(1, 50):
        for dy, dx in ((0, 1), (1, 0)) if k % 2 else ((0, -1), (-1, 0)):
            for _ in range(2 * k):
                if 0 <= y < 101 and 0 <= x < 101:
                    mask[y, x] = True
                y, x = y + dy, x + dx
    assert (images.components(mask, False) == slow_components(mask, False)).all()


def slow_regional_maxima(image):
    label, out = slow_components(np.ones(image.shape, bool), values=image), np.zeros(image.shape, bool)
    for k in np.unique(label):
        own = label == k
        ring = images.dilate(own, np.ones((3, 3), bool)) & ~own
        out |= own & (not ring.any() or image[ring].max() < image[own][0])
    return out


def test_regional_maxima_with_plateaus():
    rng = np.random.default_rng(2)
    flat = np.zeros((9, 9))
    flat[2:4, 2:4] = 5
    flat[6, 6:9] = 3
    flat[7, 8] = 4  # the row of threes touches a higher pixel
    got = images.local_maxima(flat)
    assert got[2:4, 2:4].all() and not got[6, 6:9].any() and got[7, 8] and got.sum() == 5
    for levels in (2, 3, 6, 100):
        for _ in range(8):
            image = rng.integers(0, levels, (13, 17)).astype(float)
            assert (images.local_maxima(image) == slow_regional_maxima(image)).all()
    assert images.local_maxima(np.ones((5, 5))).all()


def test_filter_against_its_sum():
    rng = np.random.default_rng(3)
    image, sigma = rng.normal(size=(11, 14)), 1.3
    half = int(np.ceil(2 * sigma))
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    w /= w.sum()
    want = np.array([[sum(w[i + half] * w[j + half] * image[np.clip(y + i, 0, 10), np.clip(x + j, 0, 13)] for i in range(-half, half + 1) for j in range(-half, half + 1)) for x in range(14)] for y in range(11)])
    assert np.allclose(images.smooth(image, sigma), want)


def test_images_of_real_size_take_seconds():
    """A mask of 1024 by 1024 in less than 2 s, and 300 seeds in less than 20 s (on a machine several times slower too)."""
    size = 1024
    yy, xx = np.mgrid[:size, :size]
    both = (np.hypot(yy - 500, xx - 520) < 400) + 0.01 * np.random.default_rng(4).random((size, size))
    both[480:520, 500:540] = 0
    began = time.process_time()
    mask = images.mask_of(both)
    assert time.process_time() - began < 2 and mask[500, 520] and mask.sum() == pytest.approx(np.pi * 405**2, rel=0.01)
    rng = np.random.default_rng(5)
    cn = images.smooth(rng.random((size, size)), 3)
    began = time.process_time()
    top = np.argwhere(images.local_maxima(cn) & mask)[:600]
    found = images.grow([(int(y), int(x), 1) for y, x in top], cn, cn, cn, mask)
    assert time.process_time() - began < 20 and len(found) > 100
    taken = [c for _, cells in found for c in cells]
    assert len(taken) == len(set(taken)) and all(12 <= len(cells) <= 120 for _, cells in found)


def test_maps_by_bands_equal_whole_images(spark, monkeypatch):
    """Bands of a few rows, some lower than the filter reaches; a recording of its own size beside it."""
    rng = np.random.default_rng(6)
    movies_ = {"R": rng.normal(100, 5, (60, 70, 23)), "S": rng.normal(90, 3, (20, 9, 40))}
    for m in movies_.values():
        m[::7, 3:6, 5:9] += 30
    rows = [(name, k + 1, f.shape[0], f.shape[1], f.ravel().tolist()) for name, m in movies_.items() for k, f in enumerate(m)]
    df = spark.createDataFrame(rows, "recording string, frame int, height int, width int, pixels array<double>").repartition(3)
    for band in (8, 64):
        monkeypatch.setattr(movies, "BAND", band)
        monkeypatch.setattr(movies, "HELD_RECORDINGS", 1)
        got = movies.recording_maps(df, 20, (2.0, 10, 1), (1.5, 1.0)).toPandas()
        for name, m in movies_.items():
            own = got[got["recording"] == name]
            mean, std, cn, pnr, mask = movies.assembled(own, "mean", "std", "cn", "pnr", "in_mask")
            assert len(own) == -(-m.shape[1] // band) and np.allclose(mean, m.mean(0)) and np.allclose(std, m.std(0, ddof=1))
            unit = lambda a: (a - a.min()) / (a.max() - a.min() + np.finfo(float).eps)
            want = images.mask_of(images.smooth(unit(m.mean(0)) * unit(m.std(0, ddof=1)), 2.0), 10, 1)
            assert ((mask > 0) == want).all()
            raw = np.mean([images.correlation_maps(m[k : k + 20]) for k in range(0, len(m), 20)], axis=0)
            assert np.allclose(cn, images.smooth(raw[0] * want, 1.5)) and np.allclose(pnr, images.smooth(raw[1] * want, 1.0))


def test_a_chain_at_512(spark):
    """Cells planted in frames of 512 by 512 pixels are found again, in whole."""
    rng = np.random.default_rng(7)
    size, n = 512, 60
    yy, xx = np.mgrid[:size, :size]
    body = 200.0 * (np.hypot(yy - 256, xx - 256) < 200)
    centres = [(150, 200), (256, 256), (330, 180), (300, 340)]
    flashes = [rng.integers(0, n - 8, 6) for _ in centres]
    rows = []
    for k in range(n):
        frame = body * (1 + 0.05 * np.sin(k / 3)) + rng.normal(100, 3, (size, size)) + body / 20 * rng.normal(0, 1, (size, size))
        for (a, b), at in zip(centres, flashes, strict=True):
            frame[np.hypot(yy - a, xx - b) <= 4] += 300 * sum(np.exp(-(k - s) / 3) for s in at if 0 <= k - s < 8)
        rows.append(("R", k + 1, size, size, frame.astype(np.float32).ravel().tolist()))
    df = spark.createDataFrame(rows, "recording string, frame int, height int, width int, pixels array<float>").repartition(8)
    bands = spark.createDataFrame(movies.recording_maps(df, 50).toPandas(), movies.band_schema("mean", "std", "in_mask", "cn", "pnr"))
    levels = movies.threshold_levels(movies.map_stats(bands))
    found = movies.find_regions(bands, levels, blur=None).toPandas()
    mids = found.groupby("roi_id")[["y", "x"]].mean().to_numpy()
    assert all(np.hypot(*(mids - np.array(c)).T).min() <= 1.5 for c in centres)


def random_pairs(rng, nodes, share):
    return [(i, j) for i in range(nodes) for j in range(i + 1, nodes) if rng.random() < share]


def test_rounds_equal_the_walk(spark):
    rng = np.random.default_rng(8)
    graphs = {f"g{k}": (random_pairs(rng, int(rng.integers(2, 30)), rng.choice([0.05, 0.2, 0.6, 1.0])), rng.integers(0, 12, 30).tolist()) for k in range(30)}
    graphs["chain"] = ([(k, k + 1) for k in range(12)], [int(v) for v in rng.integers(0, 5, 30)])
    rows = [(g, i, j, float(snr[i]), float(snr[j])) for g, (pairs, snr) in graphs.items() for i, j in pairs]
    got = {}
    for r in rounds.weaker_goes(spark.createDataFrame(rows, "recording string, i long, j long, snr_i double, snr_j double").repartition(5)).collect():
        got.setdefault(r["recording"], {})[r["node"]] = r["by"]
    for g, (pairs, snr) in graphs.items():
        assert got.get(g, {}) == kernels.greedy(pairs, dict(enumerate(snr))), g
    kept = {}
    for r in rounds.first_come(spark.createDataFrame([r[:3] for r in rows], "recording string, i long, j long")).collect():
        kept.setdefault(r["recording"], set()).add(r["node"])
    for g, (pairs, _) in graphs.items():
        gone = set()
        for i in range(30):
            if i not in gone:
                gone |= {j for a, j in pairs if a == i}
        assert kept.get(g, set()) == gone
    assert rounds.weaker_goes(spark.createDataFrame([], "recording string, i long, j long, snr_i double, snr_j double")).count() == 0


def test_thinned_seeds_equal_the_walk(spark):
    rng = np.random.default_rng(9)
    seeds = [(str(g), k + 1, int(y), int(x), 1.0, 1) for g in range(4) for k, (y, x) in enumerate(rng.integers(0, 40, (150, 2)))]
    got = {(r["recording"], r["place"]) for r in movies.thinned(spark.createDataFrame(seeds, "recording string, place int, y int, x int, score double, level int"), 4.5).collect()}
    want = set()
    for g in range(4):
        kept = []
        for _, k, y, x, _, _ in (s for s in seeds if s[0] == str(g)):
            if all(np.hypot(y - a, x - b) >= 4.5 for a, b in kept):
                kept.append((y, x))
                want.add((str(g), k))
    assert got == want
