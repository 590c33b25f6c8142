"""Small NumPy functions on one image."""

from __future__ import annotations

import numpy as np

from motionspark.functions.kernels import hazen


def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter over 2*ceil(2*sigma)+1 pixels with the border repeated."""
    half = int(np.ceil(2 * sigma))
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    w /= w.sum()
    h, width = image.shape
    tall = np.pad(image, [(half, half), (0, 0)], "edge")
    image = sum(v * tall[k : k + h] for k, v in enumerate(w))
    wide = np.pad(image, [(0, 0), (half, half)], "edge")
    return sum(v * wide[:, k : k + width] for k, v in enumerate(w))


def otsu(image: np.ndarray, bins: int = 256) -> float:
    """The level between two classes of greatest variance, for values scaled to [0, 1]."""
    counts, edges = np.histogram(np.clip(image, 0, 1), bins, (0, 1))
    p = counts / max(1, counts.sum())
    mid = np.arange(bins)
    w, m = np.cumsum(p), np.cumsum(p * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    between[~np.isfinite(between)] = -1
    return float(np.flatnonzero(between == between.max()).mean() / (bins - 1))


def runs_of(mask: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each horizontal run of the mask, in order; with ``values`` a run ends where the value changes."""
    h, w = mask.shape
    new = mask.copy()
    new[:, 1:] &= ~mask[:, :-1] if values is None else ~(mask[:, :-1] & (values[:, 1:] == values[:, :-1]))
    last = mask.copy()
    last[:, :-1] &= ~mask[:, 1:] | new[:, 1:]
    row, start = np.nonzero(new)
    return row, start, np.nonzero(last)[1] + 1


def joined_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, diagonal: bool = True, values: np.ndarray | None = None) -> np.ndarray:
    """For each run the first run of its part: runs of neighbouring rows that touch belong together, where ``values`` are the same."""
    wide = width + 2
    first, last = row * wide + start, row * wide + end
    below = (row + 1) * wide
    lo = np.searchsorted(last, below + start, "left" if diagonal else "right")
    hi = np.searchsorted(first, below + end, "right" if diagonal else "left")
    n = np.maximum(0, hi - lo)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    if values is not None:
        same = values[a] == values[b]
        a, b = a[same], b[same]
    root = np.arange(len(row))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        while (least[least] != least).any():
            least = least[least]
        if (least == root).all():
            return root
        root = least


def components(mask: np.ndarray, diagonal: bool = True, values: np.ndarray | None = None) -> np.ndarray:
    """Labels of connected parts of the mask, 0 outside: the number, from 1, of a part's first pixel. With ``values`` parts are of one value."""
    h, w = mask.shape
    row, start, end = runs_of(mask, values)
    root = joined_runs(row, start, end, w, diagonal, values[row, start] if values is not None else None)
    label = np.zeros(h * w, np.int64)
    label[mask.ravel()] = np.repeat((row * w + start + 1)[root], end - start)
    return label.reshape(h, w)


def disk(radius: float) -> np.ndarray:
    r = int(radius)
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return y * y + x * x <= radius * radius


def dilate(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    r = shape.shape[0] // 2
    p = np.pad(mask, r)
    h, w = mask.shape
    return np.any([p[a : a + h, b : b + w] for a, b in zip(*np.nonzero(shape), strict=True)], axis=0)


def erode(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return ~dilate(~mask, shape)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that the border does not reach becomes mask."""
    label = components(np.pad(~mask, 1, constant_values=True), diagonal=False)
    return (label != label[0, 0])[1:-1, 1:-1]


def mask_of(both: np.ndarray, least: int = 5000, widen: int = 5) -> np.ndarray:
    """The largest area above half of Otsu's level, filled and widened; empty if none has ``least`` pixels."""
    mask = fill_holes(both > otsu(both) * 0.5)
    label = components(mask)
    sizes = np.bincount(label.ravel())
    sizes[0] = 0
    if sizes.max() < least:
        return np.zeros_like(mask)
    return dilate(label == sizes.argmax(), disk(widen))


def correlation_maps(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of frames [n, h, w]: mean product of z-scores with the 8 neighbours (the image wraps around), and peak over noise."""
    eps = np.finfo(np.float32).eps
    mean, std = y.mean(0), y.std(0, ddof=1) if len(y) > 1 else np.zeros(y.shape[1:])
    z = (y - mean) / (std + eps)
    cn = sum((z * np.roll(z, (a, b), (1, 2))).mean(0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b) / 8
    return cn, (y.max(0) - mean) / (std + eps)


def local_maxima(image: np.ndarray) -> np.ndarray:
    """Pixels of parts of one value, single pixels mostly, whose neighbours are all lower."""
    h, w = image.shape
    p = np.pad(image, 1, constant_values=-np.inf)
    around = np.full((h, w), -np.inf)
    for a in range(3):
        for b in range(3):
            if (a, b) != (1, 1):
                np.maximum(around, p[a : a + h, b : b + w], out=around)
    flat = image == around  # has a neighbour of its own value and none that is higher
    if flat.any():
        # a part is a maximum if none of its pixels has a higher neighbour: those that do are of it, but not in ``flat``
        label = components(np.ones_like(flat), values=image) if flat.mean() > 0.5 else components(image <= around, values=image)
        low = np.zeros(h * w + 1, bool)
        low[label[image < around]] = True
        flat &= ~low[label]
    return (image > around) | flat


def seeds(cn, pnr, mask, levels, cn_scales, pnr_scales, cn_uniform=False, mean=None):
    """(y, x, score, level): regional maxima of the smoothed maps over each level's limits; the peak map alone, and then the smoothed
    mean image, if there are none. The first level that finds a pixel keeps it; the best score comes first."""
    found = {}

    def take(where, score, level):
        for y, x in zip(*np.nonzero(where & mask), strict=True):
            found.setdefault((int(y), int(x)), (float(score[y, x]), level))

    if not cn_uniform:
        tops = [local_maxima(s) for s in cn_scales]
        for level, (c, p) in enumerate(levels, 1):
            for top in tops:
                take((cn > c) & (pnr > p) & top, cn * pnr, level)
    if not found or cn_uniform:
        limit = max(0.9 * levels[-1][1], hazen(pnr[mask], 70)) if mask.any() else 0
        for s in pnr_scales:
            take(local_maxima(s) & (pnr > limit), pnr, 4)
    if not found and mean is not None and mask.any():
        take(local_maxima(mean) & (mean > hazen(mean[mask], 40)), mean, 5)
    return sorted(((y, x, s, k) for (y, x), (s, k) in found.items()), key=lambda r: (-r[2], r[0], r[1]))


#: Shares of the seed's correlation, peak ratio or brightness that a region keeps, when grown, relaxed and tightened.
GROW = {"first": (0.80, 0.70, 0.75, 0.85), "relaxed": (0.65, 0.55, 0.60, None), "tight": (0.92, 0.88, 0.92, None)}


def grow(found, cn, pnr, mean, mask, g_sig=3.0, least=12, most=120, max_rois=300, overlap=0.3, factor=1.2):
    """[(level, [(y, x), ...])]: regions grown from the seeds (y, x, level) in order, none on pixels that are taken. All that a seed looks at lies
    in a window around it."""
    h, w = cn.shape
    used = np.zeros((h, w), bool)
    target = min(np.pi * (g_sig * factor) ** 2, most)
    reach = int(g_sig * 2 + 0.5)
    side = max(reach, int(np.ceil(1.2 * g_sig)), int(np.ceil(np.sqrt(target / np.pi)))) + 2
    out = []
    for y0, x0, level in found:
        if len(out) >= max_rois:
            break
        if used[y0, x0]:
            continue
        top, left = max(0, y0 - side), max(0, x0 - side)
        window = np.s_[top : y0 + side + 1, left : x0 + side + 1]
        y, x, free = y0 - top, x0 - left, mask[window] & ~used[window]
        c, p, m = cn[window], pnr[window], mean[window]
        yy, xx = np.indices(free.shape)
        distance = np.hypot(yy - y, xx - x)
        near = np.s_[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        search = (abs(yy - y) <= reach) & (abs(xx - x) <= reach) & free

        def part(kind, y=y, x=x, c=c, p=p, m=m, level=level, near=near, search=search, distance=distance, free=free):
            share_c, share_p, only_p, share_m = GROW[kind]
            if level <= 3:
                area = (c >= share_c * c[near].max()) & (p >= share_p * p[near].max()) & search
            elif level == 4:
                area = (p >= only_p * p[near].max()) & search
            elif share_m is not None:
                area = (m >= share_m * m[near].max()) & search
            else:
                area = (distance <= g_sig * (1.2 if kind == "relaxed" else 1)) & free
            label = components(area)
            return label == label[y, x] if label[y, x] else np.zeros_like(area)

        if search.sum() < 5:
            region = (distance <= g_sig) & free
        else:
            region = part("first")
            if region.sum() < least:
                region = part("relaxed")
            if region.sum() < least:
                region = (distance <= 1.2 * g_sig) & free
            if region.sum() > most:
                tight = part("tight")
                if least <= tight.sum() <= most:
                    region = tight
                else:
                    shrunk = region
                    while shrunk.sum() > most and (smaller := erode(shrunk, disk(1)))[y, x]:
                        shrunk = smaller
                    region = shrunk if shrunk.sum() >= least else (distance <= np.sqrt(target / np.pi)) & free
            if not region[y, x]:
                region = (distance <= g_sig) & free
        size, taken = region.sum(), used[window]
        if not least <= size <= most:
            continue
        if (region & taken).any():
            if (region & taken).sum() / size > overlap or (region & ~taken).sum() < least:
                continue
            region = region & ~taken
        out.append((level, [(int(a) + top, int(b) + left) for a, b in zip(*np.nonzero(region), strict=True)]))
        used[window] |= region
    return out


def hull_area(y: np.ndarray, x: np.ndarray) -> float:
    """Area of the convex hull of pixels, taken as unit squares."""
    corners = sorted({(float(a) + s, float(b) + t) for a, b in zip(y, x, strict=True) for s in (-0.5, 0.5) for t in (-0.5, 0.5)})

    def chain(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(corners) + chain(corners[::-1]))
    a, b = hull, np.roll(hull, -1, 0)
    return float(abs((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum()) / 2)


def shape(y: np.ndarray, x: np.ndarray) -> dict:
    """Area, extent, axes, eccentricity, solidity, perimeter and compactness of a region's pixels."""
    n = len(y)
    box = (y.max() - y.min() + 1) * (x.max() - x.min() + 1)
    uyy, uxx, uxy = y.var() + 1 / 12, x.var() + 1 / 12, ((y - y.mean()) * (x - x.mean())).mean()
    root = np.sqrt((uxx - uyy) ** 2 + 4 * uxy**2)
    major, minor = 2 * np.sqrt(2) * np.sqrt(uxx + uyy + root), 2 * np.sqrt(2) * np.sqrt(max(0, uxx + uyy - root))
    cells = {*zip(y.tolist(), x.tolist(), strict=True)}
    edges = sum((a + i, b + j) not in cells for a, b in cells for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    perimeter = edges * np.pi / 4  # of a large disk, whose outline of unit edges is 8r long
    return {"area": n, "extent": n / box, "major": major, "minor": minor, "eccentricity": float(np.sqrt(max(0, 1 - (minor / major) ** 2))), "solidity": n / hull_area(y, x), "perimeter": perimeter, "compactness": float(4 * np.pi * n / perimeter**2)}


def translate(image: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """The image moved right by dx and down by dy, bilinear; what comes from outside is the mean."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w]
    y, x = y - dy, x - dx
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    inside = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
    at = lambda a, b: image[np.clip(a, 0, h - 1), np.clip(b, 0, w - 1)]
    value = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.where(inside, value, image.mean())


def shift_between(frame: np.ndarray, template: np.ndarray, most: int, up: int = 10) -> tuple[float, float]:
    """(right, down): the shift of ``frame`` against the template: the peak of the circular cross-correlation within the
    window, then a search around it on a grid of 1/up pixels by the Fourier sum."""
    h, w = frame.shape
    cross = np.fft.fft2(frame - frame.mean()) * np.conj(np.fft.fft2(template - template.mean()))
    corr = np.fft.ifft2(cross).real
    dy, dx = np.fft.fftfreq(h, 1 / h), np.fft.fftfreq(w, 1 / w)
    corr[np.abs(dy)[:, None] + 0 * dx > most] = -np.inf
    corr[np.abs(dx)[None, :] + 0 * dy[:, None] > most] = -np.inf
    a, b = np.unravel_index(corr.argmax(), corr.shape)
    fine = np.arange(-up, up + 1) / up
    ys, xs = dy[a] + fine, dx[b] + fine
    ey = np.exp(2j * np.pi * np.outer(ys, np.fft.fftfreq(h)))
    ex = np.exp(2j * np.pi * np.outer(np.fft.fftfreq(w), xs))
    peak = (ey @ cross @ ex).real
    p, q = np.unravel_index(peak.argmax(), peak.shape)
    return float(np.clip(xs[q], -most, most)), float(np.clip(ys[p], -most, most))
