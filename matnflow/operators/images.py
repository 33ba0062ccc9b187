"""Preparing pictures of text for reading: grey, contrast, polarity, threshold, letter height, scale (numpy)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LETTER_HEIGHT, PAD = 30, 20


def read_netpbm(content: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of a binary PGM or PPM file."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content)
    if not m or int(m[4]) > 255:
        raise ValueError("no binary PGM or PPM picture of eight bits")
    bands, w, h = (1 if m[1] == b"5" else 3), int(m[2]), int(m[3])
    pixels = np.frombuffer(content, np.uint8, w * h * bands, m.end()).reshape(h, w, bands)
    return np.repeat(pixels, 3, axis=2) if bands == 1 else pixels


def write_pgm(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """O1: luma, rounded."""
    return np.floor(rgb[..., :3].astype(np.float64) @ [0.299, 0.587, 0.114] + 0.5).astype(np.uint8)


def stretch(grey: np.ndarray) -> np.ndarray:
    """O2: the levels between the darkest and the lightest hundredth spread over the whole range."""
    counts = np.bincount(grey.ravel(), minlength=256)
    cut = grey.size * 0.01
    low = min(int(np.searchsorted(np.cumsum(counts), cut)), 255)
    high = max(255 - int(np.searchsorted(np.cumsum(counts[::-1]), cut)), 0)
    return np.clip(np.rint((grey.astype(np.float64) - low) * 255 / max(1, high - low)), 0, 255).astype(np.uint8)


def dark_on_light(grey: np.ndarray) -> np.ndarray:
    """O3: inverted where the median of the border, four pixels wide and each side by itself, is dark."""
    rows = [y for y in (0, 1, 2, 3, -4, -3, -2, -1) if -len(grey) <= y < len(grey)]
    cols = [x for x in (0, 1, 2, 3, -4, -3, -2, -1) if -grey.shape[1] <= x < grey.shape[1]]
    border = np.sort(np.concatenate([grey[rows].ravel(), grey[:, cols].ravel()]))
    return 255 - grey if len(border) and border[len(border) // 2] < 128 else grey


def otsu(grey: np.ndarray) -> int:
    """The level that best parts letters from ground; 128 if there is one level only."""
    p = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    w, s = np.cumsum(p), np.cumsum(p * np.arange(256))
    back, fore = w, w[-1] - w
    ok = (back > 0) & (fore > 0)
    between = np.zeros(256)
    between[ok] = back[ok] * fore[ok] * (s[ok] / back[ok] - (s[-1] - s[ok]) / fore[ok]) ** 2
    return int(between.argmax()) if between.max() > 0 else 128


def components(dark: np.ndarray) -> list[tuple[int, int, int]]:
    """(pixels, height, width) of the 8-connected dark blobs, by merging runs of adjoining rows."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs, above = [], []
    for y, row in enumerate(dark):
        edges = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        here = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            i = len(parent)
            parent.append(i)
            runs.append((y, a, b))
            here.append((a, b, i))
            for c, d, j in above:
                if c <= b and a <= d:
                    parent[root(i)] = root(j)
        above = here
    boxes: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(runs):
        box = boxes.setdefault(root(i), [0, y, y, a, b])
        box[:] = box[0] + b - a, min(box[1], y), max(box[2], y), min(box[3], a), max(box[4], b)
    return [(n, y1 - y0 + 1, x1 - x0) for n, y0, y1, x0, x1 in boxes.values()]


def letter_height(grey: np.ndarray, threshold: int) -> int:
    """Height at nine tenths of the letter-sized blobs; 0 for fewer than five."""
    h, w = grey.shape
    heights = sorted(b for n, b, c in components(grey <= threshold) if n >= 15 and b < 0.4 * h and c < 0.5 * w)
    return heights[int(0.9 * (len(heights) - 1))] if len(heights) >= 5 else 0


def line_height(grey: np.ndarray, threshold: int) -> float:
    """Median length of the runs of rows that hold ink; 0 without any."""
    inked = (grey <= threshold).any(axis=1).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.r_[0, inked, 0]))
    return float(np.median(edges[1::2] - edges[::2])) if len(edges) else 0.0


def rescale(grey: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear scaling and a white margin."""
    h, w = grey.shape
    nh, nw = max(1, int(h * scale + 0.5)), max(1, int(w * scale + 0.5))
    y = np.clip((np.arange(nh) + 0.5) / nh * h - 0.5, 0, h - 1)
    x = np.clip((np.arange(nw) + 0.5) / nw * w - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    g, fy, fx = grey.astype(np.float64), (y - y0)[:, None], (x - x0)[None, :]
    top = g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx
    low = g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx
    return np.pad(np.rint(top * (1 - fy) + low * fy).astype(np.uint8), PAD, constant_values=255)


def prepare(rgb: np.ndarray) -> tuple[np.ndarray, int, int, float]:
    """O1-O6 in turn: (picture, threshold, letter height, scale)."""
    grey = dark_on_light(stretch(grey_of(rgb)))
    threshold = otsu(grey)
    letters = letter_height(grey, threshold)
    scale = min(4.0, max(0.25, LETTER_HEIGHT / letters)) if letters else 1.0
    return rescale(grey, scale), threshold, letters, scale


def prepare_images(files: DataFrame) -> DataFrame:
    """(path, content, threshold, letters, scale, error) of ``binaryFile`` rows; an unreadable picture has its error only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part.path, part.content):
                try:
                    picture, threshold, letters, scale = prepare(read_netpbm(content))
                    rows.append((path, write_pgm(picture), threshold, letters, scale, None))
                except (ValueError, TypeError) as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "threshold", "letters", "scale", "error"])

    schema = "path string, content binary, threshold int, letters int, scale double, error string"
    return files.select("path", "content").mapInPandas(run, schema)
