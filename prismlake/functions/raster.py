"""Numpy kernels for images of any size, used inside Arrow batches. Rasters are 2-D arrays (or H x W x C)."""

from __future__ import annotations

import struct
import zlib

import numpy as np


# ---- files


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray or RGB image as PNG."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    kind = 0 if image.ndim == 2 else 2
    rows = b"".join(b"\0" + image[i].tobytes() for i in range(h))

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def from_spark(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """An image as Spark's reader gives it (BGR) as gray or RGB."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[:, :, 0] if channels == 1 else a[:, :, 2::-1]


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


# ---- sampling


def _at(image: np.ndarray, y: np.ndarray, x: np.ndarray, border: str) -> np.ndarray:
    h, w = image.shape[:2]
    if border == "reflect":
        y, x = (np.where((k := np.mod(c, 2 * n)) < n, k, 2 * n - 1 - k) for c, n in ((y, h), (x, w)))
        return image[y, x]
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    got = image[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
    return np.where(inside if image.ndim == 2 else inside[..., None], got, 0)


def warp(image: np.ndarray, matrix: np.ndarray, size: tuple[int, int], *, nearest: bool = False, border: str = "constant", inverse: bool = False) -> np.ndarray:
    """Affine map of an image to size (width, height); matrix maps source to output unless inverse says the opposite."""
    m = np.vstack([np.asarray(matrix, float).reshape(2, 3), [0, 0, 1]])
    back = m if inverse else np.linalg.inv(m)
    ys, xs = np.mgrid[0 : size[1], 0 : size[0]].astype(float)
    sx, sy = back[0, 0] * xs + back[0, 1] * ys + back[0, 2], back[1, 0] * xs + back[1, 1] * ys + back[1, 2]
    source = image.astype(float)
    if nearest:
        out = _at(source, np.rint(sy).astype(int), np.rint(sx).astype(int), border)
    else:
        y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
        fy, fx = sy - y0, sx - x0
        if image.ndim == 3:
            fy, fx = fy[..., None], fx[..., None]
        out = sum(_at(source, y0 + a, x0 + b, border) * (fy if a else 1 - fy) * (fx if b else 1 - fx) for a in (0, 1) for b in (0, 1))
    return out if image.dtype.kind == "f" else np.clip(np.rint(out), 0, 255).astype(image.dtype)


def resize(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear to (width, height) with half-pixel centres and clamped borders."""
    h, w = image.shape[:2]

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((np.arange(m) + 0.5) * n / m - 0.5, 0)
        low = np.minimum(at.astype(int), n - 1)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = axis(h, size[1]), axis(w, size[0])
    a = image.astype(float)
    more = (slice(None), None) + (None,) * (image.ndim - 2)
    rows = a[y0] * (1 - fy)[more] + a[y1] * fy[more]
    fx = fx[(None, slice(None)) + (None,) * (image.ndim - 2)]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


# ---- crops


def principal_axis(mask: np.ndarray) -> tuple[tuple[float, float], float, float, float]:
    """Mean (x, y), angle in degrees in (-90, 90], and deviations along both axes."""
    y, x = np.nonzero(mask)
    h, w = mask.shape
    if len(x) < 5:
        return (w / 2, h / 2), 0.0, max(w, h) / 4, min(w, h) / 4
    c = np.cov(x, y)
    spread = np.hypot((c[0, 0] - c[1, 1]) / 2, c[0, 1])
    mid = (c[0, 0] + c[1, 1]) / 2
    angle = float(np.degrees(np.arctan2(2 * c[0, 1], c[0, 0] - c[1, 1]) / 2))
    return (float(x.mean()), float(y.mean())), angle, float(np.sqrt(mid + spread)), float(np.sqrt(max(mid - spread, 0)))


def rotation(mean: tuple[float, float], angle: float, scale: float, out: tuple[int, int]) -> np.ndarray:
    a, b = scale * np.cos(np.radians(angle)), scale * np.sin(np.radians(angle))
    mx, my = mean
    return np.array([[a, b, (1 - a) * mx - b * my + out[0] / 2 - mx], [-b, a, b * mx + (1 - a) * my + out[1] / 2 - my]])


def iou(a: np.ndarray, b: np.ndarray) -> float:
    union = np.count_nonzero((a > 0) | (b > 0))
    return np.count_nonzero((a > 0) & (b > 0)) / union if union else 0.0


def cover_fit(size: tuple[int, int], out: tuple[int, int]) -> np.ndarray:
    s = max(out[0] / size[0], out[1] / size[1])
    return np.array([[s, 0, (out[0] - size[0] * s) / 2], [0, s, (out[1] - size[1] * s) / 2]])


def crop_mask(mask: np.ndarray, matrix: np.ndarray, out: tuple[int, int]) -> np.ndarray:
    return (warp((mask > 0).astype(np.uint8) * 255, matrix, out, nearest=True) > 127).astype(np.uint8)


def aligned_crop(image: np.ndarray | None, mask: np.ndarray, out: tuple[int, int], *, scale: float = 1.0, offset: float = 0.0, align: bool = True, candidates: list | tuple = (0, 180), reference: np.ndarray | None = None) -> dict:
    """Crop of a masked object: turned to its main axis, scaled to its length, centred.

    Masks below ten pixels give a centred crop that covers the output (angle 0, overlap 0, no mask). With a
    reference mask and several candidates the one of the largest overlap is added to the angle, the first on
    ties; otherwise candidates don't count. Without a reference the overlap is the ratio of both masks' areas.
    """
    mask = mask > 0
    if mask.sum() < 10:
        matrix = cover_fit((mask.shape[1], mask.shape[0]), out)
        return {"image": None if image is None else warp(image, matrix, out), "mask": np.zeros(out[::-1], np.uint8), "matrix": matrix, "angle": 0.0, "iou": 0.0}
    mean, main, major, _ = principal_axis(mask)
    zoom = out[0] / max(1.0, 4 * major) * scale
    angle = 0.0 if not align else main + offset
    if align and reference is not None and len(candidates) > 1:
        tries = [main + offset + float(c) for c in candidates]
        overlaps = [iou(crop_mask(mask, rotation(mean, t, zoom, out), out), reference) for t in tries]
        angle = tries[int(np.argmax(overlaps))]
    matrix = rotation(mean, angle, zoom, out)
    cut = crop_mask(mask, matrix, out)
    overlap = iou(cut, reference) if reference is not None else cut.sum() / mask.sum()
    return {"image": None if image is None else warp(image, matrix, out, border="reflect"), "mask": cut, "matrix": matrix, "angle": float(angle), "iou": float(overlap)}


# ---- refinement


def normalized(a: np.ndarray) -> np.ndarray:
    low, high = float(a.min()), float(a.max())
    return np.zeros_like(a, dtype=float) if high - low < 1e-8 else (a - low) / (high - low)


def _windows(a: np.ndarray, half: int, mode: str) -> np.ndarray:
    padded = np.pad(a, half, mode=mode) if half else a
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * half + 1, 2 * half + 1))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur, int(4 sigma) | 1 taps, mirrored borders without repeating the edge."""
    if sigma <= 0:
        return a
    half = (int(4 * sigma) | 1) // 2
    k = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.arange(-half, n + half)
        at = np.abs(at) if n > 1 else np.zeros_like(at)
        at = (n - 1) - np.abs((n - 1) - np.mod(at, max(1, 2 * n - 2)))
        a = np.moveaxis(sum(w * np.take(a, at[i : i + n], axis=axis) for i, w in enumerate(k)), 0, 0)
    return a


def bilateral(a: np.ndarray, d: int = 9, sigma_color: float = 75, sigma_space: float = 75) -> np.ndarray:
    a = normalized(a)
    half = d // 2
    near = _windows(a, half, "reflect" if min(a.shape) > half else "edge")
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    weight = np.exp(-(y**2 + x**2) / (2 * sigma_space**2)) * (y**2 + x**2 <= half * half)
    weight = weight * np.exp(-((near - a[..., None, None]) ** 2) / (2 * sigma_color**2))
    return (weight * near).sum(axis=(2, 3)) / weight.sum(axis=(2, 3))


def box(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean over windows, with mirrored borders."""
    n = 2 * radius + 1
    padded = np.pad(a, radius, mode="symmetric")
    s = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def guided(a: np.ndarray, guide: np.ndarray | None, radius: int = 8, eps: float = 0.01) -> np.ndarray:
    """Guided filter of the heatmap (256 levels) along the edges of the source image; without one the heatmap stays.

    Intensities count from 0 to 255, for eps too. A colour image guides with its three channels: in each window the
    heatmap is fitted as a linear function of the colour.
    """
    if guide is None:
        return a
    source = np.floor(normalized(a) * 255)
    g = resize(guide.astype(float), (a.shape[1], a.shape[0])).reshape(*a.shape, -1)
    every = range(g.shape[2])
    mean_a, mean_g = box(source, radius), np.stack([box(g[..., i], radius) for i in every], axis=2)
    spread = np.empty((*a.shape, len(every), len(every)))
    for i in every:
        for j in every:
            spread[..., i, j] = box(g[..., i] * g[..., j], radius) - mean_g[..., i] * mean_g[..., j] + eps * (i == j)
    shared = np.stack([box(g[..., i] * source, radius) - mean_g[..., i] * mean_a for i in every], axis=2)
    slope = np.linalg.solve(spread, shared[..., None])[..., 0]
    rest = mean_a - (slope * mean_g).sum(axis=2)
    out = sum(box(slope[..., i], radius) * g[..., i] for i in every) + box(rest, radius)
    return np.rint(np.clip(out, 0, 255)) / 255


def _ellipse(size: int) -> np.ndarray:
    from prismlake.operators.grids import ellipse

    out, half = np.zeros((2 * (size // 2) + 1,) * 2, bool), size // 2
    for dy, dx in ellipse(size):
        out[dy + half, dx + half] = True
    return out


def morph(a: np.ndarray, percent: float = 95.0, opening: int = 3, closing: int = 3) -> np.ndarray:
    """Pixels above a percentile, opened and closed by ellipses."""
    out = (a > np.percentile(a, percent)).astype(float)

    def step(b: np.ndarray, size: int, least: bool) -> np.ndarray:
        shape = _ellipse(size)
        half = size // 2
        padded = np.pad(b, half, constant_values=1.0 if least else 0.0)
        near = np.lib.stride_tricks.sliding_window_view(padded, shape.shape)[..., shape]
        return near.min(axis=-1) if least else near.max(axis=-1)

    if opening > 0:
        out = step(step(out, opening, True), opening, False)
    if closing > 0:
        out = step(step(out, closing, False), closing, True)
    return out


def refiner(config: dict, method: str):
    """The function (heatmap, image) -> heatmap of a method; None for raw, identity for an unknown one."""
    get = config.get
    guide = lambda a, image: guided(a, image, get("guided_radius", 8), get("guided_eps", 0.01))
    cut = lambda a: morph(a, get("morph_threshold_pct", 95.0), get("morph_open_size", 3), get("morph_close_size", 3))
    return {
        "raw": None,
        "gaussian": lambda a, image: gaussian(a, get("gaussian_sigma", 5)),
        "bilateral": lambda a, image: bilateral(a, get("bilateral_d", 9), get("bilateral_sigma_color", 75), get("bilateral_sigma_space", 75)),
        "guided": guide,
        "morph": lambda a, image: cut(a),
        "guided_morph": lambda a, image: cut(guide(a, image)),
    }.get(method, lambda a, image: a)


# ---- drawings


def segment_distance(shape: tuple[int, int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the segment from a to b (x, y)."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    d = b - a
    t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(float(d @ d), 1e-12), 0, 1)
    return np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1])


def crop_box(matrix: np.ndarray, crop: tuple[int, int], size: tuple[int, int], colour: tuple[int, int, int] = (255, 0, 255)) -> np.ndarray:
    """A crop's frame, its long axis and its centre, drawn on a black canvas of the original's (width, height)."""
    m = matrix.reshape(2, 3)
    back = lambda x, y: np.linalg.solve(m[:, :2], np.array([x, y], float) - m[:, 2])
    w, h = crop
    corners = [back(x, y) for x, y in ((0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1))]
    axis = (back(0, h / 2), back(w - 1, h / 2)) if w >= h else (back(w / 2, 0), back(w / 2, h - 1))
    out, shape = np.zeros((size[1], size[0], 3), np.uint8), (size[1], size[0])
    for a, b in [*zip(corners, corners[1:] + corners[:1]), axis]:
        out[segment_distance(shape, a, b) <= 1] = colour
    centre = back(w / 2, h / 2)
    out[segment_distance(shape, centre, centre) <= 4] = colour
    return out


#: Colours of an overlay's heat, evenly spaced from the least to the most.
HEAT = np.array([(0, 0, 4), (81, 18, 124), (183, 55, 121), (252, 137, 97), (252, 253, 191)], float)


def overlay(image: np.ndarray, heatmap: np.ndarray, share: float = 0.6) -> np.ndarray:
    """The image with a heatmap, scaled to its range, over it: `share` of the heat's colour in each pixel."""
    rgb = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image
    heat = resize(heatmap.astype(float), (rgb.shape[1], rgb.shape[0]))
    heat = (heat - heat.min()) / (heat.max() - heat.min() + 1e-8)
    colour = np.stack([np.interp(heat, np.linspace(0, 1, len(HEAT)), HEAT[:, c]) for c in range(3)], axis=2)
    return ((1 - share) * rgb + share * colour).astype(np.uint8)


# ---- scoring


def band(a: np.ndarray, low: float, high: float, method: str = "mean") -> float:
    """Band score of one raster in double precision; NaN for an empty one or one with NaN."""
    v = np.asarray(a, float).ravel()
    if not v.size or np.isnan(v).any():
        return float("nan")
    lo, hi = np.percentile(v, [low, high])
    kept = v[(v >= lo) & (v <= hi)]
    if not kept.size:
        kept = v[v >= lo]
    if not kept.size:
        kept = v
    return float({"max": np.max, "sum": np.sum}.get(method, np.mean)(kept))
