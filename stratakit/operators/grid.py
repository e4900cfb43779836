"""Operations on matrices in cell form: rows (r, c, v), optionally of several images by ``image``."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blur(cells: DataFrame) -> DataFrame:
    """Sums of neighbours by 1, 2, 1 along columns, then along rows; outside is 0. image, r, c, v (image may be absent)."""
    by = ["image"] if "image" in cells.columns else []
    v = F.col("v").cast("double")
    for line, along in (("r", "c"), ("c", "r")):
        w = Window.partitionBy(*by, line).orderBy(along)
        before = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(v).over(w))
        after = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(v).over(w))
        cells = cells.withColumn("v", F.coalesce(before, F.lit(0.0)) + 2 * v + F.coalesce(after, F.lit(0.0)))
        v = F.col("v")
    return cells


def umat_fill_outer(u: np.ndarray) -> np.ndarray:
    """Places at even rows and columns of the border get the mean of their known neighbours along it."""
    out = u.astype(float).copy()
    h, w = out.shape
    for r in range(0, h, 2):
        for c in range(0, w, 2):
            if r in (0, h - 1) or c in (0, w - 1):
                near = [out[a, b] for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= a < h and 0 <= b < w]
                out[r, c] = float(np.mean(near))
    return out


def umat_infill(u: np.ndarray) -> np.ndarray:
    """All other places without a distance of their own get the mean of their neighbours: first even, then odd ones."""
    out = u.astype(float).copy()
    h, w = out.shape
    for start in (0, 1):
        for r in range(start, h, 2):
            for c in range(start, w, 2):
                if start == 1 or (0 < r < h - 1 and 0 < c < w - 1):
                    near = [out[a, b] for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= a < h and 0 <= b < w]
                    out[r, c] = float(np.mean(near))
    return out


def _around(h: int, w: int, r: int, c: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(max(0, r - 1), min(h, r + 2)) for b in range(max(0, c - 1), min(w, c + 2)) if (a, b) != (r, c)]


def watershed(img: np.ndarray, levels: int = 25) -> np.ndarray:
    """Basins numbered from 1, boundaries 0.

    The image floods in ``levels`` even steps. In each, the newly flooded places next to basins are taken in breadth
    first, those between two basins become boundary; what remains in one piece starts a basin.
    """
    h, w = img.shape
    label = np.full((h, w), -1, dtype=int)
    basins = 0
    low = -np.inf
    for top in np.linspace(img.min(), img.max(), levels):
        wet = (img > low) & (img <= top) & (label == -1)
        low = top
        queue = deque((r, c) for r, c in np.argwhere(wet).tolist() if any(label[p] > 0 for p in _around(h, w, r, c)))
        queued = set(queue)
        while queue:
            r, c = queue.popleft()
            near = {int(label[p]) for p in _around(h, w, r, c) if label[p] > 0}
            label[r, c] = near.pop() if len(near) == 1 else 0
            if label[r, c] > 0:
                for p in _around(h, w, r, c):
                    if wet[p] and label[p] == -1 and p not in queued:
                        queued.add(p)
                        queue.append(p)
        for r, c in np.argwhere(wet & (label == -1)).tolist():
            if label[r, c] == -1:
                basins += 1
                label[r, c] = basins
                fill = deque([(r, c)])
                while fill:
                    for p in _around(h, w, *fill.popleft()):
                        if wet[p] and label[p] == -1:
                            label[p] = basins
                            fill.append(p)
    return np.maximum(label, 0)


def watershed_cells(cells: DataFrame, levels: int = 25) -> DataFrame:
    """image, r, c, basin: each image in one task, as flooding goes in order; places without a cell count as highest."""

    def flood(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame.r.to_numpy() - frame.r.min(), frame.c.to_numpy() - frame.c.min()
        img = np.full((r.max() + 1, c.max() + 1), frame.v.max())
        img[r, c] = frame.v
        return pd.DataFrame({"image": frame.image, "r": frame.r, "c": frame.c, "basin": watershed(img, levels)[r, c]})

    if "image" not in cells.columns:
        cells = cells.withColumn("image", F.lit(0))
    return cells.select(F.col("image").cast("long").alias("image"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v")).groupBy("image").applyInPandas(flood, "image long, r int, c int, basin int")
