"""Decisions and pixel arithmetic on images that come as columns: grids, boxes and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds that are text and go to structured data.
TEXT_HEAVY = ("table", "programmer_matrix", "strattec_table", "spacing_depth_chart", "paragraph_note")


def use_of(kind: Column, has_text: Column, explains_step: Column) -> Column:
    """struct(public_kind, publish_image, extract_text, render_as_schema), tried in that order: data, procedure, discard."""
    made = lambda k, publish, extract: F.struct(F.lit(k).alias("public_kind"), F.lit(publish).alias("publish_image"), F.lit(extract).alias("extract_text"), F.lit(extract).alias("render_as_schema"))
    is_text = F.coalesce(kind.isin(*TEXT_HEAVY), F.lit(False)) | F.coalesce(has_text, F.lit(False))
    return F.when(is_text, made("structured_data", False, True)).when(F.coalesce(explains_step, F.lit(False)), made("procedure_image", True, False)).otherwise(made("discard", False, False))


def expand_box(box: Column, width: Column, height: Column, pad: int) -> Column:
    """struct(x1, y1, x2, y2) grown by ``pad`` within the page."""
    return F.struct(
        F.greatest(F.lit(0), box["x1"] - pad).alias("x1"), F.greatest(F.lit(0), box["y1"] - pad).alias("y1"), F.least(width, box["x2"] + pad).alias("x2"), F.least(height, box["y2"] + pad).alias("y2")
    )


def plausible_box(box: Column, width: Column, height: Column, least_area: int = 4500, most_share: float = 0.35, least_width: int = 80, least_height: int = 55) -> Column:
    """Neither a speck nor most of the page."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return (w * h > least_area) & (w * h < width * height * most_share) & (w > least_width) & (h > least_height)


def ink(grid: Column, threshold: float) -> Column:
    """struct(density, width, height) of the cells darker than the threshold and of the box around them."""
    dark = F.transform(grid, lambda row: F.transform(row, lambda v: v < threshold))
    rows = F.transform(dark, lambda row: F.exists(row, lambda v: v))
    columns = F.flatten(F.transform(dark, lambda row: F.filter(F.transform(row, lambda v, x: F.when(v, x)), lambda x: x.isNotNull())))
    lines = F.filter(F.transform(rows, lambda v, y: F.when(v, y)), lambda y: y.isNotNull())
    cells = F.greatest(F.size(F.flatten(grid)), F.lit(1))
    return F.struct(
        (F.size(columns) / cells).alias("density"),
        F.when(F.size(columns) > 0, F.array_max(columns) - F.array_min(columns) + 1).otherwise(0).alias("width"),
        F.when(F.size(lines) > 0, F.array_max(lines) - F.array_min(lines) + 1).otherwise(0).alias("height"),
    )


def good_ink(grid: Column, threshold: float = 245, least: float = 0.012, most: float = 0.48, least_share: float = 0.08) -> Column:
    """Enough ink, not too much, over enough of the area."""
    i = ink(grid, threshold)
    cells = F.greatest(F.size(F.flatten(grid)), F.lit(1))
    return (i["density"] >= least) & (i["density"] <= most) & (i["width"] * i["height"] / cells >= least_share)


def suppress_watermark(pixels: Column) -> Column:
    """Pale coloured, faint grey and near-white struct(r, g, b) pixels become white; dark ones stay."""

    def clean(p: Column) -> Column:
        low, high = F.least(p["r"], p["g"], p["b"]), F.greatest(p["r"], p["g"], p["b"])
        brightness, spread = (p["r"] + p["g"] + p["b"]) / 3, high - low
        pale = (brightness > 178) & (low > 138) & (spread > 8) & (spread < 72)
        faint = (brightness > 188) & (spread <= 12)
        near_white = (brightness > 222) & (spread < 42)
        white = F.struct(F.lit(255).cast("int").alias("r"), F.lit(255).cast("int").alias("g"), F.lit(255).cast("int").alias("b"))
        return F.when(pale | faint | near_white, white).otherwise(p)

    return F.transform(pixels, clean)


def has_cue(text: Column, words: Sequence[str]) -> Column:
    """Whether any word occurs in the upper-cased text."""
    up, out = F.upper(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        out = out | F.contains(up, F.lit(w.upper()))
    return out
