"""Pixels: fingerprints, quality, variants and warps of raw RGBA images, as numpy kernels behind Arrow UDFs.

An image is (height, width, data) with four bytes a pixel, row by row. Decoding
of files is left to a plug-in. Resizing averages areas and rotation samples
bilinearly, so hashes agree bit by bit with other implementations only for
images that need neither.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DCT_SIZE, LOW = 32, 8
GAMMAS = (2.0, 1.4, 1.0, 0.7, 0.5)
ANGLES = (-8.0, 8.0)
NEAR_DUPLICATE = 1
#: Named regions as left, top, width and height shares.
CROPS = {
    "center-80": (0.1, 0.1, 0.8, 0.8), "center-60": (0.2, 0.2, 0.6, 0.6), "center-50": (0.25, 0.25, 0.5, 0.5),
    "top-left-70": (0.0, 0.0, 0.7, 0.7), "top-right-70": (0.3, 0.0, 0.7, 0.7), "bottom-left-70": (0.0, 0.3, 0.7, 0.7),
    "bottom-right-70": (0.3, 0.3, 0.7, 0.7),
}
#: Bytes of made images that a task holds before they go on.
PIECE = 4_000_000
_K = np.arange(DCT_SIZE)
COSINES = np.cos((2 * _K[None, :] + 1) * np.arange(LOW)[:, None] * np.pi / (2 * DCT_SIZE))
ALPHA = np.where(np.arange(LOW) == 0, 1 / np.sqrt(2), 1.0)
LUMA = (0.299, 0.587, 0.114)


def pixels(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def _luma(rgba: np.ndarray) -> np.ndarray:
    r, g, b = (rgba[..., k].astype(np.float64) for k in range(3))
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def gray(rgba: np.ndarray) -> np.ndarray:
    """Brightness, cut to whole numbers."""
    return _luma(rgba).astype(np.uint8)


def gray_rounded(rgba: np.ndarray) -> np.ndarray:
    """Brightness, rounded half to even: the form that rectangles are found in."""
    return np.clip(np.rint(_luma(rgba)), 0, 255).astype(np.uint8)


def gray_image(rgba: np.ndarray) -> np.ndarray:
    out = rgba.copy()
    out[..., :3] = gray(rgba)[..., None]
    return out


def _weights(source: int, target: int) -> np.ndarray:
    """Share of each source cell in each target cell when areas are averaged."""
    edges = np.arange(target + 1) * source / target
    low, high = edges[:-1, None], edges[1:, None]
    cell = np.arange(source)[None, :]
    overlap = np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None)
    return overlap / overlap.sum(axis=1, keepdims=True)


def resize(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    if rgba.shape[:2] == (height, width):
        return rgba
    down, across = _weights(rgba.shape[0], height), _weights(rgba.shape[1], width)
    out = np.einsum("ih,hwc,jw->ijc", down, rgba.astype(np.float64), across, optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _hex(bits: np.ndarray) -> str:
    """Bits, four to a digit; the last digit is filled up with zeros."""
    return np.packbits(bits).tobytes().hex()


def coefficients(rgba: np.ndarray) -> np.ndarray:
    """The 63 low-frequency cosine coefficients besides the constant one.

    Sums run term by term, so that images without any structure, whose
    coefficients are rounding noise, give the noise of that order of addition.
    """
    g = gray(resize(rgba, DCT_SIZE, DCT_SIZE)).astype(np.float64)
    rows = np.zeros((DCT_SIZE, LOW))
    for y in range(DCT_SIZE):
        rows += g[:, y, None] * COSINES[None, :, y]
    both = np.zeros((LOW, LOW))
    for x in range(DCT_SIZE):
        both += rows[x][None, :] * COSINES[:, x, None]
    return (ALPHA[:, None] * ALPHA[None, :] * both / 2).ravel()[1:]


def phash(rgba: np.ndarray) -> str:
    """16 digits: which coefficients exceed the median; the last bit is 0."""
    c = coefficients(rgba)
    return _hex(c > np.sort(c)[31])


def dhash(rgba: np.ndarray) -> str:
    """32 digits: which of 17 by 8 cells are brighter than their right neighbour."""
    g = gray(resize(rgba, 17, 8))
    return _hex((g[:, :-1] > g[:, 1:]).ravel())


def brightness(rgba: np.ndarray, delta: int) -> np.ndarray:
    out = rgba.copy()
    out[..., :3] = np.clip(rgba[..., :3].astype(np.int64) + delta, 0, 255)
    return out


def gamma(rgba: np.ndarray, exponent: float) -> np.ndarray:
    if exponent == 1.0:
        return rgba
    table = np.floor((np.arange(256) / 255) ** exponent * 255 + 0.5).astype(np.uint8)
    out = rgba.copy()
    out[..., :3] = table[rgba[..., :3]]
    return out


def _sample(rgba: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at places, those outside taken to the edge."""
    h, w = rgba.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = (x - x0)[..., None], (y - y0)[..., None]
    at = rgba.astype(np.float64)
    top = at[y0, x0] + (at[y0, x1] - at[y0, x0]) * tx
    bottom = at[y1, x0] + (at[y1, x1] - at[y1, x0]) * tx
    return top + (bottom - top) * ty


def rotate(rgba: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre on black."""
    if not np.isfinite(degrees) or degrees == 0:
        return rgba
    h, w = rgba.shape[:2]
    t = np.deg2rad(degrees)
    ys, xs = np.mgrid[0:h, 0:w] + 0.5
    dx, dy = xs - w / 2, ys - h / 2
    sx, sy = np.cos(t) * dx + np.sin(t) * dy + w / 2 - 0.5, -np.sin(t) * dx + np.cos(t) * dy + h / 2 - 0.5
    inside = (sx > -0.5) & (sx < w - 0.5) & (sy > -0.5) & (sy < h - 0.5)
    out = np.zeros_like(rgba)
    out[..., 3] = 255
    out[inside] = np.clip(np.rint(_sample(rgba, sx, sy)), 0, 255).astype(np.uint8)[inside]
    return out


def clean_angles(angles) -> list[float]:
    """To two digits, without zero and repetitions."""
    out: list[float] = []
    for a in angles or ():
        value = float(np.floor(a * 100 + 0.5) / 100) if np.isfinite(a) else 0.0
        if value and value not in out:
            out.append(value)
    return out


def clean_threshold(t) -> int:
    return max(0, int(t)) if np.isfinite(t) else NEAR_DUPLICATE


def _distance(a: str, b: str) -> float:
    return bin(int(a, 16) ^ int(b, 16)).count("1") if len(a) == len(b) else float("inf")


def prune(hashes: list[str], most: int = NEAR_DUPLICATE, base: list[str] | None = None) -> list[str]:
    """The hashes, after the base, that are more than ``most`` bits from all before them."""
    out = list(base or ())
    for h in hashes:
        if h and all(_distance(h, k) > most for k in out):
            out.append(h)
    return out


def exposures(rgba: np.ndarray, gammas=GAMMAS) -> list[np.ndarray]:
    return [gamma(rgba, g) for g in gammas]


def exposures_and_rotations(rgba: np.ndarray, gammas=GAMMAS, angles=ANGLES) -> list[np.ndarray]:
    turned = clean_angles(angles)
    return [v for e in exposures(rgba, gammas) for v in (e, *(rotate(e, a) for a in turned))]


def _variants(rgba: np.ndarray, width: int, height: int, hash_of: Callable, gammas, angles, most: int) -> list[str]:
    """Hashes of exposures, then of their rotations: exposed at full size, turned after resizing."""
    small = [resize(e, width, height) for e in exposures(rgba, gammas)]
    turned = [rotate(s, a) for s in small for a in clean_angles(angles)]
    return prune([hash_of(t) for t in turned], most, prune([hash_of(s) for s in small], most))


def hash_variants(rgba: np.ndarray, gammas=GAMMAS, angles=ANGLES, most: int = NEAR_DUPLICATE) -> dict[str, list[str]]:
    most = clean_threshold(most)
    return {
        "phash": _variants(rgba, DCT_SIZE, DCT_SIZE, phash, gammas, angles, most),
        "dhash": _variants(rgba, 17, 8, dhash, gammas, angles, most),
    }


def crop(rgba: np.ndarray, key: str) -> np.ndarray:
    h, w = rgba.shape[:2]
    left, top, across, down = CROPS[key]
    whole = lambda x: int(np.floor(x + 0.5))
    x, y, cw, ch = whole(left * w), whole(top * h), whole(across * w), whole(down * h)
    out = np.zeros((ch, cw, 4), np.uint8)
    part = rgba[y : y + ch, x : x + cw]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def crop_hash_variants(rgba: np.ndarray, gammas=GAMMAS, angles=ANGLES, most: int = NEAR_DUPLICATE) -> dict[str, list[str]]:
    return {k: _variants(crop(rgba, k), DCT_SIZE, DCT_SIZE, phash, gammas, angles, clean_threshold(most)) for k in CROPS}


# --- quality -------------------------------------------------------------------------------------


def laplacian_variance(g: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian inside the border; 0 without an inside."""
    if min(g.shape) < 3:
        return 0.0
    v = g.astype(np.int64)
    lap = v[:-2, 1:-1] + v[2:, 1:-1] + v[1:-1, :-2] + v[1:-1, 2:] - 4 * v[1:-1, 1:-1]
    return float(lap.var())


def quality(rgba: np.ndarray, sharp: float = 100.0, glare_level: int = 250, glare_percent: float = 20.0, low: float = 50.0, high: float = 220.0) -> dict:
    g = gray(rgba)
    sharpness, glare, light = laplacian_variance(g), float((g > glare_level).mean() * 100), float(g.mean())
    kind = "underexposed" if light < low else "overexposed" if light > high else "ok"
    return {
        "sharpness": sharpness, "is_sharp": sharpness >= sharp, "glare_percent": glare, "has_glare": glare > glare_percent,
        "brightness": light, "poor_light": kind != "ok", "light": kind,
    }


def changed_pixels(before: np.ndarray, after: np.ndarray, most: float) -> int:
    """Pixels of which some channel differs by more than the given amount."""
    d = np.abs(before[..., :3].astype(np.int64) - after[..., :3].astype(np.int64))
    return int((d > most).any(axis=2).sum())


# --- warps ---------------------------------------------------------------------------------------


def homography(target: np.ndarray, source: np.ndarray) -> np.ndarray | None:
    """The 3 by 3 map that takes four target corners to the source's; None if there is none."""
    rows, values = [], []
    for (x, y), (u, v) in zip(target, source, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    m = np.array(rows, float)
    if not np.isfinite(m).all() or np.linalg.matrix_rank(m, tol=1e-10) < 8:
        return None
    return np.append(np.linalg.solve(m, np.array(values, float)), 1.0).reshape(3, 3)


def warp(rgba: np.ndarray, corners: np.ndarray, aspect: str) -> np.ndarray | None:
    """The quadrilateral (top left first, clockwise) as a flat 96 by 64 or 64 by 96 image."""
    w, h = (96, 64) if aspect == "3:2" else (64, 96)
    m = homography(np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float), np.asarray(corners, float))
    if m is None:
        return None
    ys, xs = np.mgrid[0:h, 0:w].astype(float)
    u, v, d = (m[k, 0] * xs + m[k, 1] * ys + m[k, 2] for k in range(3))
    fine = np.abs(d) >= 1e-8
    d = np.where(fine, d, 1.0)
    out = np.clip(np.rint(_sample(rgba, u / d, v / d)), 0, 255).astype(np.uint8)
    out[~fine] = 0
    return out


def letterbox(rgba: np.ndarray, size: int = DCT_SIZE) -> np.ndarray:
    """The whole image, centred on a black square."""
    h, w = rgba.shape[:2]
    scale = min(size / w, size / h)
    nw, nh = max(1, int(np.floor(w * scale + 0.5))), max(1, int(np.floor(h * scale + 0.5)))
    out = np.zeros((size, size, 4), np.uint8)
    out[..., 3] = 255
    y, x = (size - nh) // 2, (size - nw) // 2
    out[y : y + nh, x : x + nw] = resize(rgba, nw, nh)
    return out


# --- degraded images for tests ---------------------------------------------------------------------


def motion_blur(rgba: np.ndarray, reach: int = 10) -> np.ndarray:
    w = rgba.shape[1]
    total = np.pad(np.cumsum(rgba.astype(np.int64), axis=1), ((0, 0), (1, 0), (0, 0)))
    low, high = np.maximum(np.arange(w) - reach, 0), np.minimum(np.arange(w) + reach + 1, w)
    out = ((total[:, high] - total[:, low]) / (high - low)[None, :, None]).round().astype(np.uint8)
    out[..., 3] = 255
    return out


def add_glare(rgba: np.ndarray, spots: int = 3, seed: int = 0) -> np.ndarray:
    rng, (h, w) = np.random.default_rng(seed), rgba.shape[:2]
    out = rgba.astype(np.float64)
    ys, xs = np.mgrid[0:h, 0:w]
    for _ in range(spots):
        x, y, r = rng.random() * w, rng.random() * h, 40 + rng.random() * 60
        t = np.hypot(xs - x, ys - y) / r
        alpha = np.interp(t, (0, 0.3, 1), (0.9, 0.6, 0.0))[..., None]
        out[..., :3] = out[..., :3] * (1 - alpha) + 255 * alpha
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def low_light(rgba: np.ndarray, seed: int = 0) -> np.ndarray:
    noise = (np.random.default_rng(seed).random(rgba.shape[:2]) - 0.5) * 20
    out = rgba.copy()
    out[..., :3] = np.clip(np.rint(rgba[..., :3] * 0.3 + noise[..., None]), 0, 255)
    return out


def shear(rgba: np.ndarray, degrees: float = 30.0) -> np.ndarray:
    h, w = rgba.shape[:2]
    skew = np.tan(np.deg2rad(degrees)) * h * 0.3
    ys, xs = np.mgrid[0:h, 0:w].astype(float)
    sx = xs - skew * (1 - ys / h)
    out = np.zeros_like(rgba)
    inside = (sx >= 0) & (sx <= w - 1)
    out[inside] = np.clip(np.rint(_sample(rgba, sx, ys)), 0, 255).astype(np.uint8)[inside]
    return out


# --- Spark ----------------------------------------------------------------------------------------


def _per_image(kernel: Callable, returns: str) -> Callable[[Column, Column, Column], Column]:
    """A UDF of (height, width, data); an image that can't be read gives null."""

    def safe(h, w, d):
        try:
            return kernel(pixels(int(h), int(w), bytes(d)))
        except (TypeError, ValueError):
            return None

    if returns.startswith("struct"):
        names = [f.split(":")[0] for f in returns[7:-1].split(",") if ":" in f and "<" not in f.split(":")[0]]

        def run(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.DataFrame:
            rows = [safe(*x) or {} for x in zip(h, w, d, strict=True)]
            return pd.DataFrame({n: [r.get(n) for r in rows] for n in names}, dtype=object)
    else:

        def run(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series([safe(*x) for x in zip(h, w, d, strict=True)], dtype=object)

    return F.pandas_udf(run, returns)


def phash_column(h: Column, w: Column, d: Column) -> Column:
    return _per_image(phash, "string")(h, w, d)


def dhash_column(h: Column, w: Column, d: Column) -> Column:
    return _per_image(dhash, "string")(h, w, d)


def quality_column(h: Column, w: Column, d: Column, **limits) -> Column:
    kind = "struct<sharpness:double,is_sharp:boolean,glare_percent:double,has_glare:boolean,brightness:double,poor_light:boolean,light:string>"
    return _per_image(lambda p: quality(p, **limits), kind)(h, w, d)


def hash_variants_column(h: Column, w: Column, d: Column, **how) -> Column:
    return _per_image(lambda p: hash_variants(p, **how), "struct<phash:array<string>,dhash:array<string>>")(h, w, d)


def crop_hashes_column(h: Column, w: Column, d: Column, **how) -> Column:
    return _per_image(lambda p: list(crop_hash_variants(p, **how).items()), "array<struct<region:string,hashes:array<string>>>")(h, w, d)


def adjusted_column(h: Column, w: Column, d: Column, delta: int = 0, exponent: float = 1.0) -> Column:
    """The pixels made brighter by an amount, then by a gamma curve, as bytes."""
    return _per_image(lambda p: gamma(brightness(p, delta), exponent).tobytes(), "binary")(h, w, d)


def crop_column(h: Column, w: Column, d: Column, key: str) -> Column:
    return _per_image(lambda p: crop(p, key).tobytes(), "binary")(h, w, d)


def rgba_of_bgr(channels: Column, data: Column) -> Column:
    """RGBA bytes of grey, BGR or BGRA bytes; null for other layouts."""

    def run(n: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for k, raw in zip(n, d, strict=True):
            if k not in (1, 3, 4) or raw is None:
                out.append(None)
                continue
            p = np.frombuffer(raw, np.uint8).reshape(-1, int(k))
            rgba = np.full((len(p), 4), 255, np.uint8)
            rgba[:, :3] = p[:, [0, 0, 0] if k == 1 else [2, 1, 0]]
            if k == 4:
                rgba[:, 3] = p[:, 3]
            out.append(rgba.tobytes())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")(channels, data)


def with_content_hash(files: DataFrame) -> DataFrame:
    """Add the sha256 of the content, by which unchanged files are known."""
    return files.withColumn("sha256", F.sha2("content", 256))


def checksum(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _image_of(kernel: Callable) -> Callable[..., Column]:
    """A UDF of (height, width, data, ...) that gives an image's bytes; null where there is no image or the kernel gives none.

    Images go on in pieces of some MB, as those of a whole batch can be hundreds of times what comes in.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out, size = [], 0
            for h, w, d, *more in zip(*columns, strict=True):
                try:
                    made = kernel(pixels(int(h), int(w), bytes(d)), *more)
                except (TypeError, ValueError):
                    made = None
                out.append(None if made is None else np.ascontiguousarray(made).tobytes())
                size += len(out[-1] or b"")
                if size >= PIECE:
                    yield pd.Series(out, dtype=object)
                    out, size = [], 0
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")


def warp_column(h: Column, w: Column, d: Column, corners: Column, aspect: Column) -> Column:
    """The flat image inside four corners, an array of x, y, x, y, ... from the top left on; aspect is 3:2 or 2:3."""
    return _image_of(lambda p, c, a: warp(p, np.asarray(c, float).reshape(4, 2), a))(h, w, d, corners, aspect)


def region_column(h: Column, w: Column, d: Column, key: Column) -> Column:
    """The region of each image that its key names."""
    return _image_of(lambda p, k: crop(p, k) if k in CROPS else None)(h, w, d, key)


def letterbox_column(h: Column, w: Column, d: Column) -> Column:
    return _image_of(letterbox)(h, w, d)
