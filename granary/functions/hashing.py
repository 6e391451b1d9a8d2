"""Perceptual and vector hashes: numpy kernels over grey arrays, and 64-bit distances as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 8


def cosine_basis(n: int) -> np.ndarray:
    """Rows of the orthonormal cosine transform of length n."""
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def low_frequencies(grey: np.ndarray) -> np.ndarray:
    """The top-left 8 x 8 coefficients of a square grey image."""
    basis = cosine_basis(grey.shape[0])[:BLOCK]
    return basis @ grey.astype(float) @ basis.T


def _pack(bits: np.ndarray, first_high: bool) -> int:
    flat = bits.reshape(-1)
    word = np.packbits(flat, bitorder="big" if first_high else "little").tobytes()
    return int.from_bytes(word, "big" if first_high else "little", signed=True)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of a grey image over the cells of a height x width grid, edges weighted by the part that a cell covers."""

    def cover(n: int, cells: int) -> np.ndarray:
        ends = np.arange(cells + 1) * (n / cells)
        low, high = np.maximum.outer(ends[:-1], np.arange(n)), np.minimum.outer(ends[1:], np.arange(1, n + 1))
        return np.maximum(high - low, 0) * (cells / n)

    return cover(grey.shape[0], height) @ grey.astype(float) @ cover(grey.shape[1], width).T


def phash_median(grey: np.ndarray) -> int:
    """64 bits of an image resized to 32 x 32: coefficients above their median, the constant one included; first bit
    highest, as a signed number."""
    c = low_frequencies(np.rint(area_resize(grey, 32, 32)))
    return _pack(c > np.median(c), True)


def phash_median_flipped(grey: np.ndarray) -> int:
    """phash_median of the mirror image."""
    return phash_median(np.fliplr(grey))


def phash_mean(grey: np.ndarray) -> int:
    """64 bits of an image resized to 32 x 32: coefficients above the mean of all but the constant one; first bit lowest,
    as a signed number."""
    c = low_frequencies(area_resize(grey, 32, 32))
    return _pack(c > c.reshape(-1)[1:].mean(), False)


def dhash(grey: np.ndarray) -> int:
    """64 bits of an image resized to 8 rows of 9: each cell brighter than its right neighbour; first bit highest."""
    tile = np.rint(area_resize(grey, 8, 9))
    return _pack(tile[:, :-1] > tile[:, 1:], True)


def dihedral(grey: np.ndarray) -> list[np.ndarray]:
    """The eight images that turns and a flip make: four turns, then four turns of the mirror image."""
    return [np.rot90(x, k) for x in (grey, np.fliplr(grey)) for k in range(4)]


def dihedral_hashes(grey: np.ndarray | None) -> list[int] | None:
    """phash_mean of the eight images; null for an image that can't be read."""
    return None if grey is None else [phash_mean(np.ascontiguousarray(x)) for x in dihedral(grey)]


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian: low for blurred images."""
    g = np.pad(grey.astype(float), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def green_mask(rgb: np.ndarray, low: int = 35, high: int = 85, least: int = 40) -> np.ndarray:
    """Pixels whose hue is green, in half degrees, and whose saturation and value are at least least."""
    c = rgb.astype(float)
    top, bottom = c.max(-1), c.min(-1)
    spread = np.where(top > bottom, top - bottom, 1)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    hue = np.select([top == r, top == g], [(g - b) / spread, 2 + (b - r) / spread], 4 + (r - g) / spread) * 30 % 180
    saturation = np.where(top > 0, (top - bottom) / np.where(top > 0, top, 1) * 255, 0)
    return (hue >= low) & (hue <= high) & (saturation >= least) & (top >= least)


def not_white_mask(rgb: np.ndarray, most: int = 240) -> np.ndarray:
    """Pixels with a channel under most."""
    return (rgb < most).any(-1)


def foreground_mask(rgb: np.ndarray, prefix: str, leafy: frozenset[str] | set[str]) -> np.ndarray:
    """What belongs to the subject: green pixels where the prefix is one of leaves in the field, else all that are not white."""
    return green_mask(rgb) if prefix in leafy else not_white_mask(rgb)


def sign_bits(vector: Column, n: int = 64) -> Column:
    """Bit i is one where element i is positive; a signed number."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers; null if one is null."""
    return F.bit_count(a.bitwiseXOR(b))


def min_flip(a: Column, b: Column, b_flip: Column) -> Column:
    """The smaller of the distances to an image and to its mirror image."""
    return F.least(hamming(a, b), hamming(a, b_flip))


def min_dihedral(a: Column, b: Column) -> Column:
    """Least distance of two arrays of variant hashes: the first of one to any of the other, both ways."""
    one = lambda x, y: F.array_min(F.transform(y, lambda v: hamming(F.get(x, F.lit(0)), v)))
    return F.least(one(a, b), one(b, a))


def unit(vector: Column) -> Column:
    """A vector over its length; the query fails on a zero vector."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    safe = F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("zero vector")).cast("double"))
    return F.transform(vector, lambda x: x.cast("double") / safe)
