"""Spatial look-ups among the lines of one page, as functions of an array of lines.

A line is a struct of line_no, text and bbox (x0, y0, x1, y1). All of a page's lines are in one row, so that nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import text as T


def middle(line: Column) -> Column:
    return (line["bbox"]["y0"] + line["bbox"]["y1"]) / 2


def height(line: Column) -> Column:
    return line["bbox"]["y1"] - line["bbox"]["y0"]


def _others(lines: Column, label: Column, test) -> Column:
    return F.filter(lines, lambda l: (l["line_no"] != label["line_no"]) & test(l))


def _ordered(lines: Column, key: str) -> Column:
    """By a coordinate, then by line."""
    keyed = F.array_sort(F.transform(lines, lambda l: F.struct(l["bbox"][key].alias("k"), l["line_no"].alias("n"), l["text"].alias("text"))))
    return F.transform(keyed, lambda l: l["text"])


def _first_token(texts: Column, allow_cjk: bool) -> Column:
    found = F.transform(texts, lambda t: T.first_token(t, allow_cjk))
    return F.get(F.filter(found, lambda v: v.isNotNull()), 0)


def right_cell(lines: Column, label: Column) -> Column:
    """The first identifier to the right of a label, on its band."""
    near = _others(
        lines,
        label,
        lambda l: (F.abs(middle(l) - middle(label)) < height(label) * 0.8) & (l["bbox"]["x0"] > label["bbox"]["x0"] + 10),
    )
    return _first_token(_ordered(near, "x0"), True)


def below_cell(lines: Column, label: Column) -> Column:
    """The first identifier in the column under a label, within three times its height."""
    h, box = height(label), label["bbox"]

    def under(l: Column) -> Column:
        gap, x = l["bbox"]["y0"] - box["y1"], (l["bbox"]["x0"] + l["bbox"]["x1"]) / 2
        aligned = ((x >= box["x0"] - h) & (x <= box["x1"] + h)) | (F.abs(l["bbox"]["x0"] - box["x0"]) < h)
        return (gap >= h * -0.3) & (gap <= h * 3) & aligned

    return _first_token(_ordered(_others(lines, label, under), "y0"), False)


def below_lines(lines: Column, label: Column, most: int = 3) -> Column:
    """The first identifier in the next lines under a label, wherever they are."""
    near = _others(lines, label, lambda l: l["bbox"]["y0"] > label["bbox"]["y1"] - 5)
    return _first_token(F.slice(_ordered(near, "y0"), 1, most), False)


def has_left_label(lines: Column, cell: Column) -> Column:
    """Whether a line with CJK text is to the left of a cell, on its band."""
    return F.exists(
        lines,
        lambda l: (l["line_no"] != cell["line_no"])
        & T.has_cjk(l["text"])
        & (l["bbox"]["x1"] <= cell["bbox"]["x0"])
        & (F.abs(middle(l) - middle(cell)) < height(cell) * 1.2),
    )
