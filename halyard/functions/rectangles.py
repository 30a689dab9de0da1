"""Finding the printed rectangle in a frame: edges, connected regions, hulls, four corners and a score."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .images import gray_rounded, pixels

#: Fixed values of the search and the score.
LIMITS = {"min_area": 0.05, "max_area": 0.9, "min_aspect": 0.4, "max_aspect": 3.0, "edge": 100.0, "min_confidence": 0.4}
ASPECTS = (1.5, 1.33, 1.0)
KIND = (
    "struct<detected:boolean,confidence:double,top_left:array<double>,top_right:array<double>,bottom_right:array<double>,"
    "bottom_left:array<double>,width:double,height:double,aspect:double>"
)


def _neighbours(a: np.ndarray) -> np.ndarray:
    """The nine 3 by 3 neighbours of every inner pixel, first axis row by row."""
    h, w = a.shape
    return np.stack([a[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def _inner(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    out[1:-1, 1:-1] = inside
    return out


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def stretch(g: np.ndarray) -> np.ndarray:
    low, high = int(g.min()), int(g.max())
    return g if low == high else _byte((g.astype(np.float64) - low) * 255 / (high - low))


def blur(g: np.ndarray) -> np.ndarray:
    kernel = np.array([1, 2, 1, 2, 4, 2, 1, 2, 1])
    return _inner(g, _byte(np.tensordot(kernel, _neighbours(g.astype(np.int64)), 1) / 16))


def edges(g: np.ndarray, limit: float) -> np.ndarray:
    n = _neighbours(g.astype(np.int64))
    gx = np.tensordot(np.array([-1, 0, 1, -2, 0, 2, -1, 0, 1]), n, 1)
    gy = np.tensordot(np.array([-1, -2, -1, 0, 0, 0, 1, 2, 1]), n, 1)
    return _inner(np.zeros(g.shape, bool), gx * gx + gy * gy > limit * limit)


def close(mask: np.ndarray) -> np.ndarray:
    grown = _inner(mask, _neighbours(mask).any(axis=0))
    return _inner(grown, _neighbours(grown).all(axis=0))


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) of each 8-connected region of four pixels or more, in reading order of their first pixel.

    Runs of a row are joined with those of the row above that they touch.
    """
    parent: list[int] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    runs: list[tuple[int, int, int]] = []
    above: list[int] = []
    for y, row in enumerate(mask):
        step = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        here = []
        for a, b in zip(step[::2], step[1::2], strict=True):
            k = len(runs)
            runs.append((y, int(a), int(b)))
            parent.append(k)
            for j in above:
                if runs[j][1] <= b and runs[j][2] >= a:
                    p, q = root(j), root(k)
                    parent[max(p, q)] = min(p, q)
            here.append(k)
        above = here
    groups: dict[int, list[np.ndarray]] = {}
    for k, (y, a, b) in enumerate(runs):
        groups.setdefault(root(k), []).append(np.column_stack([np.arange(a, b), np.full(b - a, y)]))
    return [p for _, parts in sorted(groups.items()) if len(p := np.concatenate(parts)) >= 4]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, lowest y first (then lowest x), turning towards larger angles; by two monotone chains."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def chain(seq):
        out: list[tuple] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(pts) + chain(pts[::-1])
    first = min(range(len(ring)), key=lambda k: (ring[k][1], ring[k][0]))
    return np.array(ring[first:] + ring[:first])


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The ends and, again and again, the point farthest from the line if it is farther than the tolerance."""
    if len(points) < 3:
        return points
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        rest = points[a + 1 : b] - points[a]
        far = np.hypot(*rest.T) if not d.any() else np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / math.hypot(*d)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[sorted(keep)]


def four_corners(points: np.ndarray) -> np.ndarray:
    """Four corners of a region: of its hull, simplified if need be, else its extremes along both diagonals."""
    if len(points) <= 4:
        return points
    ring = hull(points)
    if len(ring) > 4:
        around = np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum()
        ring = simplify(ring, around * 0.02)
    if len(ring) == 4:
        return ring
    total, diff = points.sum(axis=1), points[:, 0] - points[:, 1]
    return points[[total.argmin(), diff.argmax(), total.argmax(), diff.argmin()]]


def order_corners(points: np.ndarray) -> np.ndarray | None:
    """Top left, top right, bottom right, bottom left; None unless there are four different points."""
    if len(points) != 4 or len(set(map(tuple, points.tolist()))) != 4:
        return None
    cx, cy = points.mean(axis=0)
    ring = points[np.argsort(np.arctan2(points[:, 1] - cy, points[:, 0] - cx), kind="stable")]
    top = min(range(4), key=lambda k: (ring[k][1], ring[k][0]))
    ring = np.roll(ring, -top, axis=0)
    return ring[[0, 3, 2, 1]] if ring[1][0] < ring[3][0] else ring


def rectangularity(corners: np.ndarray) -> float:
    """1 for four right angles, 0 from a sum of 120 degrees off."""
    a, b = np.roll(corners, 1, axis=0) - corners, np.roll(corners, -1, axis=0) - corners
    cosine = (a * b).sum(axis=1) / (np.hypot(*a.T) * np.hypot(*b.T))
    off = np.abs(np.degrees(np.arccos(np.clip(cosine, -1, 1))) - 90).sum()
    return float(1 - min(off / 120, 1))


def confidence(corners: np.ndarray, aspect: float, area: float) -> float:
    score = min(area / 0.3, 1.0) * 0.4 + 0.3
    score *= max(0.5, 1 - min(abs(aspect - a) for a in ASPECTS) / 3)
    score *= 0.7 + rectangularity(corners) * 0.3
    return max(0.0, min(1.0, score))


def detect(rgba: np.ndarray, **changes) -> dict:
    """The most convincing rectangle, its corners in shares of the frame."""
    limits, none = LIMITS | changes, {"detected": False, "confidence": 0.0}
    h, w = rgba.shape[:2]
    if min(h, w) < 3:
        return none
    best = None
    for points in regions(close(edges(blur(stretch(gray_rounded(rgba))), limits["edge"]))):
        corners = order_corners(four_corners(points))
        if corners is None:
            continue
        across, down = np.ptp(corners, axis=0).astype(float)
        aspect, area = across / down if down else 0.0, across * down / (w * h)
        if not (limits["min_area"] <= area <= limits["max_area"] and limits["min_aspect"] <= aspect <= limits["max_aspect"]):
            continue
        score = confidence(corners.astype(float), aspect, area)
        if score >= limits["min_confidence"] and (best is None or score > best[0]):
            best = score, corners / np.array([w, h]), across / w, down / h, aspect
    if best is None:
        return none
    names = ("top_left", "top_right", "bottom_right", "bottom_left")
    return {"detected": True, "confidence": best[0], "width": best[2], "height": best[3], "aspect": best[4]} | {
        n: c.tolist() for n, c in zip(names, best[1], strict=True)
    }


def detect_column(h: Column, w: Column, d: Column, **changes) -> Column:
    names = ["detected", "confidence", "top_left", "top_right", "bottom_right", "bottom_left", "width", "height", "aspect"]

    def run(hs: pd.Series, ws: pd.Series, ds: pd.Series) -> pd.DataFrame:
        rows = [detect(pixels(int(a), int(b), bytes(c)), **changes) for a, b, c in zip(hs, ws, ds, strict=True)]
        return pd.DataFrame({n: [r.get(n) for r in rows] for n in names}, dtype=object)

    return F.pandas_udf(run, KIND)(h, w, d)
