"""Boxes as expressions; polygons, hulls, matching and homographies as numpy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-16


def to_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Pixel corners x1, y1, x2, y2 of a normalised centre box."""
    return [((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2")]


def crop_rectangle(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Corners clamped to the image and cut to whole pixels."""
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most).cast("int")
    return [inside(x1, width).alias("x1"), inside(y1, height).alias("y1"), inside(x2, width).alias("x2"), inside(y2, height).alias("y2")]


def area(box: Column) -> Column:
    """Area of a struct with x1, y1, x2, y2."""
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; zero where both are empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def size_bucket(pixels: Column) -> Column:
    """small, medium or large; fixed values: 32 x 32 and 96 x 96 pixels."""
    return F.when(pixels < 1024, "small").when(pixels < 9216, "medium").otherwise("large")


def edge_distance(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Pixels between a box and the nearest image edge."""
    return F.least(x1, y1, width - x2, height - y2)


def polygon_area(p: np.ndarray) -> float:
    """Area of a polygon given as rows of x, y."""
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def _anticlockwise(p: np.ndarray) -> np.ndarray:
    x, y = p[:, 0], p[:, 1]
    return p if x @ np.roll(y, -1) - y @ np.roll(x, -1) >= 0 else p[::-1]


def convex_intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of a within b, both convex: a is cut by the line through each side of b."""
    out = [tuple(map(float, v)) for v in _anticlockwise(np.asarray(a, float))]
    edges = _anticlockwise(np.asarray(b, float))
    for p, q in zip(edges, np.roll(edges, -1, axis=0), strict=True):
        side = [(q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0]) for v in out]
        kept: list[tuple[float, float]] = []
        for k, (v, s) in enumerate(zip(out, side, strict=True)):
            before, was = out[k - 1], side[k - 1]
            if (s >= 0) != (was >= 0):
                t = was / (was - s)
                kept.append((before[0] + t * (v[0] - before[0]), before[1] + t * (v[1] - before[1])))
            if s >= 0:
                kept.append(v)
        out = kept
        if not out:
            break
    return np.array(out, float).reshape(-1, 2)


def containment(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Intersection over the area of a, and over the area of b; zero for an empty polygon."""
    shared = polygon_area(convex_intersection(a, b))
    sizes = polygon_area(np.asarray(a, float)), polygon_area(np.asarray(b, float))
    return tuple(min(shared / s, 1.0) if s > 0 else 0.0 for s in sizes)


def projected_containment(h: np.ndarray, crop: tuple[float, float], parent: tuple[float, float]) -> tuple[float, float]:
    """(containment, area ratio) of a crop under its map into a parent, sizes as (width, height): the part of the mapped
    crop's bounding box that lies in the parent, and the parent's area over the crop's."""
    w, height = crop
    corners = project(np.asarray(h, float), np.array([[0, 0], [w, 0], [w, height], [0, height]], float))
    low, high = corners.min(axis=0), corners.max(axis=0)
    inside = np.clip(high, 0, parent) - np.clip(low, 0, parent)
    box, own = float(np.prod(high - low)), w * height
    return (float(np.prod(np.maximum(inside, 0))) / box if box > 0 else 0.0), (parent[0] * parent[1] / own if own > 0 else 0.0)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, anticlockwise, by monotone chains."""
    ordered = sorted({(float(x), float(y)) for x, y in points})
    if len(ordered) < 3:
        return np.array(ordered, float).reshape(-1, 2)

    def chain(ps: list[tuple[float, float]]) -> list[tuple[float, float]]:
        held: list[tuple[float, float]] = []
        for p in ps:
            while len(held) > 1 and (held[-1][0] - held[-2][0]) * (p[1] - held[-2][1]) <= (held[-1][1] - held[-2][1]) * (p[0] - held[-2][0]):
                held.pop()
            held.append(p)
        return held[:-1]

    return np.array(chain(ordered) + chain(ordered[::-1]), float)


def hull_coverage(points: np.ndarray, mask_pixels: float, image_pixels: float, least_mask: float = 100.0) -> float:
    """Hull area over the mask's area, or over the image's where the mask is nearly empty; at most one."""
    whole = mask_pixels if mask_pixels >= least_mask else image_pixels
    return min(polygon_area(convex_hull(points)) / whole, 1.0) if whole > 0 else 0.0


def ratio_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.75) -> np.ndarray:
    """Rows (i, j) where descriptor i of a is nearest to j of b and clearly nearer than to the second."""
    if len(a) == 0 or len(b) < 2:
        return np.empty((0, 2), int)
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    d = np.sqrt(np.maximum(d2, 0))
    two = np.argpartition(d, 1, axis=1)[:, :2]
    two = np.take_along_axis(two, np.argsort(np.take_along_axis(d, two, 1), axis=1, kind="stable"), 1)
    rows = np.arange(len(a))
    good = d[rows, two[:, 0]] < ratio * d[rows, two[:, 1]]
    return np.stack([rows[good], two[good, 0]], axis=1)


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 map of four or more points, by the direct linear transform; null where they are degenerate."""
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    _, s, vt = np.linalg.svd(np.array(rows, float))
    if s[7] < 1e-9 * s[0]:
        return None
    h = vt[-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points under a homography."""
    p = np.c_[points, np.ones(len(points))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return p[:, :2] / p[:, 2:]


def ransac(src: np.ndarray, dst: np.ndarray, reach: float = 5.0, rounds: int = 500, seed: int = 42) -> tuple[np.ndarray | None, np.ndarray]:
    """(homography, inlier mask) of the map with the most points within reach; refitted on its inliers."""
    none = np.zeros(len(src), bool)
    if len(src) < 4:
        return None, none
    rng, best = np.random.default_rng(seed), none
    for _ in range(rounds):
        pick = rng.choice(len(src), 4, replace=False)
        h = fit_homography(src[pick], dst[pick])
        if h is not None:
            good = np.linalg.norm(project(h, src) - dst, axis=1) < reach
            best = good if good.sum() > best.sum() else best
    return (fit_homography(src[best], dst[best]), best) if best.sum() >= 4 else (None, none)


def best_variant(src: list[np.ndarray], dst: np.ndarray, descriptors: list[np.ndarray], target: np.ndarray, reach: float = 4.0, seed: int = 42) -> tuple[int, int, np.ndarray]:
    """(variant, inliers, their points in the target) of the variant of an image that fits a target best; ties to the first.

    src and descriptors hold the key points of each variant, dst and target those of the other image.
    """
    best = (0, 0, np.empty((0, 2)))
    for k, (points, own) in enumerate(zip(src, descriptors, strict=True)):
        m = ratio_matches(own, target)
        if len(m) >= 4:
            _, good = ransac(points[m[:, 0]], dst[m[:, 1]], reach, seed=seed)
            if good.sum() > best[1]:
                best = (k, int(good.sum()), dst[m[good, 1]])
    return best
