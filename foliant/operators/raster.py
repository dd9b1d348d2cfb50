"""Rule lines of page rasters: local threshold, openings by long thin kernels, boxes of what is left.

A page is one row (doc_id, page_no, width, height, gray: its bytes row by row), so a task holds a few pages at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.session import cut

RULES = T.StructType().add("doc_id", "long").add("page_no", "long").add("orient", "string").add("c", "double").add("v0", "double").add("v1", "double")

#: Pages that a Python worker is handed at a time.
BATCH = 16


def ink(gray: np.ndarray) -> np.ndarray:
    """Pixels at least 2 darker than the 1-2-1 weighted mean of their 3 x 3 surroundings, edges repeated."""
    p = np.pad(gray.astype(np.float32), 1, mode="edge")
    rows = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    mean = np.rint((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 4)
    return gray.astype(np.float32) - mean <= -2


def spans_of(on: np.ndarray) -> np.ndarray:
    """(row, start, end) of each run of set pixels, end excluded, in reading order."""
    step = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    return np.stack([row, start, np.nonzero(step == -1)[1]], axis=1)


def components(runs: np.ndarray, reach: int = 1) -> np.ndarray:
    """Component (its first run) of each run of `spans_of`; reach 1 joins across corners, 0 along edges only."""
    parent = list(range(len(runs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(runs[:, 0], np.arange(runs[-1, 0] + 3)) if len(runs) else []
    listed = runs.tolist()
    for i, (row, start, end) in enumerate(listed):
        for j in range(first[row + 1], first[row + 2]):
            if listed[j][1] >= end + reach:
                break
            if listed[j][2] > start - reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(runs))], dtype=np.int64)


def without_specks(on: np.ndarray, least: int) -> np.ndarray:
    """Clears components (corners join) of under `least` pixels."""
    runs = spans_of(on)
    label = components(runs)
    size = np.bincount(label, runs[:, 2] - runs[:, 1], minlength=len(runs) + 1)
    out = on.copy()
    for row, start, end in runs[size[label] < least].tolist():
        out[row, start:end] = False
    return out


def opened(on: np.ndarray, length: int, times: int = 4) -> np.ndarray:
    """Each row eroded, then dilated, `times` times by a kernel of `length`, in one step of that reach.

    Outside the page nothing erodes. Both steps look the same way, so that an even kernel shifts what is left by `times`.
    """
    back, ahead = times * (length // 2), times * (length - 1 - length // 2)
    width = on.shape[1]

    def counts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.pad(np.cumsum(a, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
        lo = np.clip(np.arange(width) - back, 0, width)
        hi = np.clip(np.arange(width) + ahead + 1, 0, width)
        return total[:, hi] - total[:, lo], hi - lo

    n, all_of = counts(on)
    return counts(n == all_of)[0] > 0


def outlines(on: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of each component's outline and of the outline around each hole in it."""
    found = []
    for pixels, reach, grow in ((on, 1, 0), (~on, 0, 1)):
        runs = spans_of(pixels)
        if not len(runs):
            continue
        label = components(runs, reach)
        order = np.argsort(label, kind="stable")
        r, at = runs[order], np.flatnonzero(np.diff(label[order], prepend=-1))
        least, most = (f.reduceat(r, at, axis=0) for f in (np.minimum, np.maximum))
        for (y0, x0, _), (y1, _, x1) in zip(least.tolist(), (most + (1, 0, 0)).tolist(), strict=True):
            if grow and (x0 == 0 or y0 == 0 or x1 == on.shape[1] or y1 == on.shape[0]):
                continue
            found.append((x0 - grow, y0 - grow, x1 - x0 + 2 * grow, y1 - y0 + 2 * grow))
    return found


def rules_of(gray: np.ndarray) -> list[tuple[str, int, int, int]]:
    """(orient, c, v0, v1) of the rules of one page: openings as long as 1/150 of the width, boxes of a usual length."""
    height, width = gray.shape
    on, kernel = without_specks(ink(gray), 10), max(1, width // 150)
    flat = [("H", y, x, x + w) for x, y, w, _ in outlines(opened(on, kernel)) if width / 30 < w < 0.9 * width]
    tall = [("V", x, y, y + h) for y, x, h, _ in outlines(opened(on.T, kernel)) if height / 75 < h < 0.9 * height]
    return sorted({*flat, *tall})


def rules(pages: DataFrame) -> DataFrame:
    """Rules of all pages. A page without bytes, or with a number of them that its size does not give, has none.

    Pages go to Python BATCH at a time, not ten thousand, so the rules are written to the shared folder under that setting.
    """
    spark, setting = pages.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b.itertuples(index=False):
                if p.gray is None or not p.width > 0 or not p.height > 0 or len(p.gray) != int(p.width) * int(p.height):
                    continue
                gray = np.frombuffer(p.gray, np.uint8).reshape(int(p.height), int(p.width))
                rows += [(p.doc_id, p.page_no, o, float(c), float(v0), float(v1)) for o, c, v0, v1 in rules_of(gray)]
            yield pd.DataFrame(rows, columns=RULES.names)

    try:
        spark.conf.set(setting, str(BATCH))
        return cut(pages.select("doc_id", "page_no", "width", "height", "gray").mapInPandas(find, RULES), "rules")
    finally:
        spark.conf.set(setting, before)
