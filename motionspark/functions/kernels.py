"""Small NumPy functions on one trace; callers send batches of traces to them."""

from __future__ import annotations

import numpy as np
import pandas as pd


def hazen(x: np.ndarray, p: float) -> float:
    """Percentile at midpoint positions of the finite values."""
    x = np.sort(x[np.isfinite(x)])
    if not len(x):
        return float("nan")
    h = min(max(1.0, len(x) * p / 100 + 0.5), len(x))
    lo = int(h)
    return float(x[lo - 1] + (h - lo) * (x[min(lo, len(x) - 1)] - x[lo - 1]))


def moving(x: np.ndarray, k: int, how: str) -> np.ndarray:
    """Moving min, mean or median of k points; an even window reaches one further back; windows shrink at the ends."""
    after = k - k // 2 - 1
    padded = pd.Series(np.concatenate([x, np.full(after, np.nan)]))
    return getattr(padded.rolling(k, min_periods=1), how)().to_numpy()[after:]


def dff(f: np.ndarray, fneu: np.ndarray, fps: float, coef: float = 0.7, seconds: float = 30) -> np.ndarray:
    """Change over baseline after neuropil subtraction; a baseline that is not positive gives way to the 8th percentile,
    and then to zeros."""
    x = f - coef * fneu
    win = max(1, int(seconds * fps + 0.5))
    base = moving(moving(x, win, "min"), win, "mean")
    if base.mean() <= 0:
        base = np.full(len(x), hazen(x, 8))
    if base.mean() <= 0:
        return np.zeros(len(x))
    return (x - base) / (base + np.finfo(float).eps)


def mad(x: np.ndarray) -> float:
    return float(np.median(np.abs(x - np.median(x))))


def snr(x: np.ndarray, fps: float) -> float:
    noise = 1.4826 * mad(x - moving(x, max(1, int(2 * fps + 0.5)), "mean"))
    return (hazen(x, 95) - hazen(x, 25)) / (noise + np.finfo(float).eps)


def savgol(x: np.ndarray, fps: float, seconds: float = 0.15, order: int = 3) -> np.ndarray:
    """Cubic Savitzky-Golay smoothing over an odd window of at least 5; the ends take the first and last fit."""
    win = max(5, int(seconds * fps + 0.5))
    win += win % 2 == 0
    if len(x) < win:
        return x.copy()
    half = win // 2
    design = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    hat = design @ np.linalg.pinv(design)
    out = np.convolve(x, hat[half][::-1], "same")
    out[:half], out[-half:] = (hat @ x[:win])[:half], (hat @ x[-win:])[-half:]
    return out


def median3(x: np.ndarray) -> np.ndarray:
    """Three-point median with zeros beyond the ends."""
    p = np.concatenate([[0.0], x, [0.0]])
    return np.median(np.stack([p[:-2], p[1:-1], p[2:]]), axis=0)


def gaussian(x: np.ndarray, win: int) -> np.ndarray:
    """Moving Gaussian mean; the spread is a fifth of the window, and weights are shared out anew at the ends."""
    half = max(1, win // 2)
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / max(1e-9, win / 5)) ** 2)
    return np.convolve(x, w, "full")[half : half + len(x)] / np.convolve(np.ones(len(x)), w, "full")[half : half + len(x)]


def find_peaks(x: np.ndarray, prominence: float = 0, distance: int = 0, width: tuple[float, float] = (0, np.inf)) -> np.ndarray:
    """Indices of local maxima. A flat top counts at its first point and ends are no peaks; then by prominence, by width at
    half prominence (linear between points), and last by distance, from the tallest down."""
    n = len(x)
    if n < 3:
        return np.zeros(0, int)
    turns = np.concatenate([[0], np.nonzero(np.diff(x))[0] + 1])  # first point of each level
    v = x[turns]
    top = np.nonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]))[0] + 1
    kept = []
    for p in turns[top]:
        left = np.nonzero(x[:p] > x[p])[0]
        right = np.nonzero(x[p + 1 :] > x[p])[0]
        a, b = (left[-1] if len(left) else 0), (p + 1 + right[0] if len(right) else n - 1)
        prom = x[p] - max(x[a : p + 1].min(), x[p : b + 1].min())
        if prom < prominence:
            continue
        level, i, j = x[p] - prom / 2, p, p
        while i > 0 and x[i] > level:
            i -= 1
        while j < n - 1 and x[j] > level:
            j += 1
        lo = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else i
        hi = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else j
        if width[0] <= hi - lo <= width[1]:
            kept.append(p)
    kept = np.array(kept, int)
    if distance > 0 and len(kept):
        alive = np.ones(len(kept), bool)
        for k in np.argsort(-x[kept], kind="stable"):
            if alive[k]:
                alive &= (np.abs(kept - kept[k]) >= distance) | (np.arange(len(kept)) == k)
        kept = kept[alive]
    return kept


def detect_events(x: np.ndarray, fps: float, prominence: float = 0.03, widths: tuple[float, float] = (0.2, 10), distance: float = 0.3, rise: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Indices and heights of events over a smoothed moving minimum; slow rises are left out."""
    win = max(1, min(int(30 * fps + 0.5), len(x) // 4))
    y = median3(x - gaussian(moving(x, win, "min"), max(1, int(win / 2 + 0.5))))
    found = []
    for p in find_peaks(y, prominence, int(distance * fps + 0.5), (widths[0] * fps, widths[1] * fps)):
        start = max(0, p - int(2 * fps + 0.5))
        low = start + int(np.argmin(y[start : p + 1]))
        if p == low or (y[p] - y[low]) / ((p - low) / fps) >= rise:
            found.append(p)
    found = np.array(found, int)
    return found, y[found]


def kinetics_values(x: np.ndarray, fps: float) -> tuple[float | None, float | None]:
    """Rise over decay and decay time (medians) of up to five of the tallest peaks; None with fewer than two peaks."""
    peaks = find_peaks(x, 0.05, int(0.5 * fps + 0.5))
    if len(peaks) < 2:
        return None, None
    rises, decays = [], []
    for p in peaks[np.argsort(-x[peaks], kind="stable")][:5]:
        start = max(0, p - int(2 * fps + 0.5))
        low = start + int(np.argmin(x[start : p + 1]))
        tail = x[p : p + int(3 * fps + 0.5) + 1]
        below = np.nonzero(tail < x[low] + 0.37 * (x[p] - x[low]))[0]
        if len(below) and below[0] > 0 and (p - low) / fps > 0.01:
            rises.append((p - low) / fps)
            decays.append((below[0] + 1) / fps)
    if not rises:
        return None, None
    up, down = np.median(rises), np.median(decays)
    return float(up / (down + np.finfo(float).eps)), float(down)


def kinetics(x: np.ndarray, fps: float, most_ratio: float = 3, taus: tuple[float, float] = (0.05, 8)) -> str | None:
    """The category of the kinetics that are wrong, if they are."""
    return kinetics_category(*kinetics_values(x, fps), most_ratio, taus)


def kinetics_category(ratio: float | None, tau: float | None, most_ratio: float = 3, taus: tuple[float, float] = (0.05, 8)) -> str | None:
    if ratio is None:
        return None
    if ratio > most_ratio:
        return "kinetics_ratio"
    return "kinetics_decay" if not taus[0] <= tau <= taus[1] else None


def bad_steps(x: np.ndarray, fps: float, jump: float = 0.5) -> int:
    """Jumps after which half a second stays up."""
    after, n = int(0.5 * fps + 0.5), len(x)
    size = np.abs(np.diff(x))
    return sum(x[j + 1 : j + 1 + after].mean() > x[max(0, j - 5) : j + 1].mean() + 0.8 * size[j] for j in np.nonzero(size > jump)[0] if j + 1 < n - after)


def longest_plateau(x: np.ndarray, level: float = 0.7) -> int:
    """Longest run over 70 % of the way from P10 to P99, 0 if they are close together."""
    lo, hi = hazen(x, 10), hazen(x, 99)
    if hi - lo < 0.05:
        return 0
    up = np.concatenate([[0], (x > lo + level * (hi - lo)).astype(int), [0]])
    d = np.diff(up)
    return int((np.nonzero(d == -1)[0] - np.nonzero(d == 1)[0]).max(initial=0))


def drift_values(x: np.ndarray, fps: float, seconds: float = 5, limit: float = 0.5) -> tuple[float, float]:
    """How far the trimmed end lies off the trimmed start, and how much of the end is raised."""
    n = min(int(seconds * fps + 0.5), len(x) // 4)
    if n < 1:
        return 0.0, 0.0
    start, end = x[:n], x[-n:]
    a, b = (np.median(w[w <= hazen(w, 90)]) for w in (start, end))
    return float(abs(b - a)), float((end > a + limit / 2).mean())


def drifted(x: np.ndarray, fps: float, seconds: float = 5, limit: float = 0.5) -> bool:
    """Whether the trimmed end lies off the trimmed start and most of the end is raised."""
    return off_start(*drift_values(x, fps, seconds, limit), limit)


def off_start(drift: float, raised: float, limit: float = 0.5) -> bool:
    return drift > limit and raised > 0.5


def negative_z(x: np.ndarray) -> float:
    low = x[x < hazen(x, 50)]
    low = x if len(low) < 10 else low
    return float((x.min() - np.median(low)) / max(0.001, 1.4826 * mad(low)))


def high_share(x: np.ndarray) -> float:
    low = x[x < hazen(x, 75)]
    low = x if not len(low) else low
    return float((x > 8 * max(0.001, 1.4826 * mad(low))).mean())


def greedy(pairs, snr: dict) -> dict:
    """{removed: by}: walks pairs (i, j), i < j, in order. The outer i is looked at once, so after losing it still meets
    later j; ties keep i."""
    gone: dict = {}
    outer, skip = None, False
    for i, j in pairs:
        if i != outer:
            outer, skip = i, i in gone
        if skip or j in gone:
            continue
        if snr[i] >= snr[j]:
            gone[j] = i
        else:
            gone[i] = j
    return gone


def robust_fit(y: np.ndarray, g: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Intercept and slope by bisquare weights with tuning 4.685, leverage and MAD scale."""
    z = np.column_stack([np.ones(len(g)), g])
    q, _ = np.linalg.qr(z)
    lever = np.sqrt(np.clip(1 - (q * q).sum(1), 1e-6, None))
    w = np.ones(len(y))
    b = np.zeros(2)
    for _ in range(rounds):
        new = np.linalg.lstsq(z * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        r = (y - z @ new) / lever
        scale = max(np.sort(np.abs(r))[1:].size and np.median(np.sort(np.abs(r))[1:]) / 0.6745, 1e-9)
        w = np.where(np.abs(r) < 4.685 * scale, (1 - np.clip(np.abs(r) / (4.685 * scale), 0, 1) ** 2) ** 2, 0)
        if np.allclose(new, b, rtol=1e-6, atol=1e-9):
            break
        b = new
    return float(new[0]), float(new[1])


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation, held level beyond the ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
    m[0], m[-1] = d[0], d[-1]
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * m[k + 1]
