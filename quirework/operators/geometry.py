"""Geometry of scanned words and masks: rows, columns, components, boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import column_of

#: Columns of a table of contents as shares of the page width.
TOC_COLUMNS = {"model": (0.22, 0.48), "years": (0.48, 0.62), "type": (0.62, 0.73), "section": (0.73, 0.86), "page": (0.86, 0.98)}
ROW_TOLERANCE = 18.0


def centres(words: DataFrame) -> DataFrame:
    """mid_x, mid_y, right, bottom of each word box."""
    return (
        words.withColumn("mid_x", F.col("left") + F.col("width") / 2)
        .withColumn("mid_y", F.col("top") + F.col("height") / 2)
        .withColumn("right", F.col("left") + F.col("width"))
        .withColumn("bottom", F.col("top") + F.col("height"))
    )


def assign_rows(page: pd.DataFrame, tolerance: float = ROW_TOLERANCE) -> pd.DataFrame:
    """Words of one page, top down, into the first row whose running middle is near enough.

    The middle moves half-way to each word it takes, so a row can drift.
    """
    page = page.sort_values(["mid_y", "left"], kind="stable")
    middles: list[float] = []
    numbers = []
    for y in page["mid_y"]:
        near = next((i for i, m in enumerate(middles) if abs(y - m) <= tolerance), None)
        if near is None:
            near = len(middles)
            middles.append(float(y))
        else:
            middles[near] = (middles[near] + y) / 2
        numbers.append(near)
    return page.assign(row_no=numbers)


def cluster_rows(words: DataFrame, page: str = "page") -> DataFrame:
    """``words`` (with mid_y, left) and row_no, per page; a page is a bounded group."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(words.schema.fields)).add("row_no", LongType())
    return words.groupBy(page).applyInPandas(lambda pdf: assign_rows(pdf), schema)


def row_columns(words: DataFrame, page: str, page_width: str, columns: dict[str, tuple[float, float]] = TOC_COLUMNS) -> DataFrame:
    """Per page and row: the words of each column joined from left to right as text_<column>, and the mean confidence."""
    placed = words.withColumn("__qw_column", column_of(F.col("mid_x") / F.col(page_width), columns))
    grouped = placed.groupBy(page, "row_no")
    texts = [
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__qw_column") == name, F.struct("left", "text")))), lambda w: w["text"]), " ").alias(f"text_{name}")
        for name in columns
    ]
    return grouped.agg(*texts, F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.round(F.avg("confidence") / 100, 2))).alias("confidence"))


def component_boxes(mask: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Boxes (x1, y1, x2, y2), ends excluded, of 4-connected areas of at least ``least`` cells, in reading order.

    Labels spread by repeated minimum over the neighbours, a whole grid at a time.
    """
    mask = np.asarray(mask, dtype=bool)
    if not mask.any():
        return []
    big = mask.size
    labels = np.where(mask, np.arange(mask.size).reshape(mask.shape), big)
    while True:
        padded = np.pad(labels, 1, constant_values=big)
        new = np.minimum.reduce([labels, padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        new = np.where(mask, new, big)
        if (new == labels).all():
            break
        labels = new
    boxes = []
    for label in np.unique(labels[mask]):
        ys, xs = np.nonzero(labels == label)
        if len(xs) >= least:
            boxes.append((int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1))
    return boxes


def touching(a, b, padding: int) -> bool:
    return a[0] <= b[2] + padding and b[0] <= a[2] + padding and a[1] <= b[3] + padding and b[1] <= a[3] + padding


def merge_boxes(boxes, size: tuple[int, int], grow: int, padding: int) -> list[tuple[int, int, int, int]]:
    """Each box, grown within the page, joins the first merged box it touches; top to bottom, left to right."""
    width, height = size
    merged: list[list[int]] = []
    for x1, y1, x2, y2 in sorted(boxes, key=lambda b: (b[1], b[0])):
        box = [max(0, x1 - grow), max(0, y1 - grow), min(width, x2 + grow), min(height, y2 + grow)]
        home = next((m for m in merged if touching(box, m, padding)), None)
        if home is None:
            merged.append(box)
        else:
            home[:] = [min(home[0], box[0]), min(home[1], box[1]), max(home[2], box[2]), max(home[3], box[3])]
    return [tuple(m) for m in merged]


def grid_boxes(df: DataFrame, key: str, values: str, side: int, threshold: float, least: int = 1, grow: int = 0, padding: int = 0) -> DataFrame:
    """Merged component boxes of each row's ``side`` x ``side`` grid: key, box_no, x1, y1, x2, y2."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, v in zip(pdf[key], pdf[values], strict=True):
                mask = np.asarray(v, dtype=float).reshape(side, side) >= threshold
                for i, box in enumerate(merge_boxes(component_boxes(mask, least), (side, side), grow, padding)):
                    rows.append((k, i, *box))
            yield pd.DataFrame(rows, columns=[key, "box_no", "x1", "y1", "x2", "y2"]).astype({key: "int64"})

    return df.select(key, values).mapInPandas(run, f"{key} long, box_no int, x1 int, y1 int, x2 int, y2 int")


def expected_rows(texts: list[int], step: int, positions: int = 8, tolerance: int = 4, least: int = 3) -> list[int] | None:
    """An evenly falling row of thousandths from noisy anchors: the largest start that enough anchors support."""
    anchors = sorted({v for v in texts if 150 <= v <= 1200 and abs(v - step) > tolerance}, reverse=True)
    for first in anchors if 0 < step <= 250 else []:
        row = [first - step * i for i in range(positions)]
        if row[-1] > 0 and sum(any(abs(a - v) <= tolerance for a in anchors) for v in row) >= least:
            return row
    return None


def rebuilt_rows(df: DataFrame, anchors: str, step: int, positions: int = 8, tolerance: int = 4, least: int = 3) -> DataFrame:
    """``df`` with row: expected_rows of the array ``anchors``, by array functions alone (null where there is none)."""
    known = F.array_distinct(F.filter(anchors, lambda v: v.between(150, 1200) & (F.abs(v - step) > tolerance)))
    places = F.sequence(F.lit(0), F.lit(positions - 1))
    near = lambda first: F.size(F.filter(places, lambda i: F.exists("__qw_known", lambda a: F.abs(a - (first - i * step)) <= tolerance)))
    fits = F.filter("__qw_known", lambda first: (first - step * (positions - 1) > 0) & (near(first) >= least))
    best = F.array_max(fits) if 0 < step <= 250 else F.lit(None).cast("int")
    out = df.withColumn("__qw_known", known).withColumn("__qw_best", best)
    return out.withColumn("row", F.when(F.col("__qw_best").isNotNull(), F.transform(places, lambda i: F.col("__qw_best") - i * step))).drop("__qw_known", "__qw_best")
