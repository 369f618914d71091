"""Lines out of the fragments of a page's text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as T

#: Pages with fewer characters than this have no text layer to speak of.
LEAST = 30
_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_LINE = f"struct<text:string,bbox:{_BOX}>"


def _joined(lines: Column, f: Column) -> Column:
    """One fragment more: it belongs to the last line if it is on its band and close to its end."""

    def onto(last: Column) -> Column:
        box, own = last["bbox"], f["bbox"]
        near = (F.abs(box["y0"] - own["y0"]) < f["height"] * 0.5) & (own["x0"] - box["x1"] < f["height"] * 2)
        both = F.struct(
            F.concat_ws(" ", last["text"], f["text"]).alias("text"),
            F.struct(
                box["x0"].alias("x0"), F.least(box["y0"], own["y0"]).alias("y0"), F.greatest(box["x1"], own["x1"]).alias("x1"), F.greatest(box["y1"], own["y1"]).alias("y1")
            ).alias("bbox"),
        )
        alone = F.struct(f["text"].alias("text"), own.alias("bbox")).cast(_LINE)
        return F.when(last.isNotNull() & near, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(both.cast(_LINE)))).otherwise(F.concat(lines, F.array(alone)))

    return F.get(F.transform(F.array(F.get(lines, F.size(lines) - 1)), onto), 0)


def text_layer(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lines (line_no, text, bbox), page_height from fragments (keys, text, x, baseline, width, height, page_height).

    Baselines are measured from the bottom, lines from the top. Fragments are taken from top to bottom, then from left to
    right; equal places by their text. Blank fragments don't count; a page with fewer than LEAST characters that aren't at
    the ends of fragments has no row. A missing or zero height is taken as 10. A page's fragments meet in one task.
    """
    real = fragments.filter(T.trimmed(F.col("text")) != "")
    height = F.coalesce(F.nullif(F.col("height").cast("double"), F.lit(0.0)), F.lit(10.0))
    bottom = F.col("page_height") - F.col("baseline")
    box = F.struct(F.col("x").cast("double").alias("x0"), (bottom - height).cast("double").alias("y0"), (F.col("x") + F.col("width")).cast("double").alias("x1"), bottom.cast("double").alias("y1"))
    part = F.struct((bottom - height).cast("double").alias("top"), F.col("x").cast("double").alias("left"), "text", height.alias("height"), box.alias("bbox"))
    pages = real.groupBy(*keys).agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum(F.length(T.trimmed(F.col("text")))).alias("n"), F.max("page_height").cast("double").alias("page_height")
    )
    lines = F.aggregate("parts", F.array().cast(f"array<{_LINE}>"), _joined)
    lines = F.transform(lines, lambda l, i: F.struct(i.alias("line_no"), l["text"].alias("text"), l["bbox"].alias("bbox")))
    return pages.filter(F.col("n") >= LEAST).select(*keys, lines.alias("lines"), "page_height")
