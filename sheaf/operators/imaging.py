"""From pixels and probabilities to lines: thresholds, boxes, direction, decoding and the signs for sexes.

Histograms, boxes as rows and decoding are DataFrame operations. What needs a grid of pixels (components, holes) is numpy over
one image in a row; images are of a page and bounded. The neural models between them are a reader's business.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of detection: probability of a box's pixel and of a whole box, growth, least pixels, longest side, sides' step.
PIXEL, BOX, UNCLIP, LEAST_AREA, LONGEST, STEP = 0.3, 0.5, 1.6, 40, 960, 32
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Pixels of maps whose components are found at once.
TOGETHER = 1 << 20
#: Boxes whose tops are closer than this are in one band, which is read from left to right.
BAND = 10
PAD_X, PAD_Y, LEAST_SIDE, RULE, RULE_RATIO = 0.04, 0.12, 6, 20, 4
ALT_RATIO, ALTS = 0.25, 2
SYMMETRY, HOLE = 0.87, 0.04


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def is_seal(r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel is of the saturated red of seals, which becomes white before recognition."""
    return (r > 130) & (r - g > 45) & (r - b > 45)


def otsu(pixels: DataFrame, image: str = "image", level: str = "gray") -> DataFrame:
    """image, threshold: the gray level that separates dark from light best, the first of equal ones; 128 if none does.

    One aggregation to at most 256 rows an image, and sums over these. Levels outside 0 to 255 and nulls don't count.
    """
    counts = pixels.filter(F.col(level).between(0, 255)).groupBy(image, level).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(image).orderBy(level)
    whole = Window.partitionBy(image)
    value = F.col(level).cast("double")
    sums = counts.select(
        image, level, F.sum("c").over(up).cast("double").alias("w"), F.sum(value * F.col("c")).over(up).alias("s"),
        F.sum("c").over(whole).cast("double").alias("n"), F.sum(value * F.col("c")).over(whole).alias("all"),
    )
    rest = F.col("n") - F.col("w")
    apart = F.col("s") / F.col("w") - (F.col("all") - F.col("s")) / F.nullif(rest, F.lit(0.0))
    sums = sums.withColumn("v", F.col("w") * rest * apart * apart)
    return sums.groupBy(image).agg(
        F.coalesce(F.max_by(F.when(F.col("v") > 0, F.col(level)), F.when(F.col("v") > 0, F.struct("v", (-F.col(level)).alias("low")))), F.lit(128)).alias("threshold")
    )


def detection_size(width: Column, height: Column) -> Column:
    """Struct of the width and height for detection: the longest side bounded, both multiples of a step."""
    scale = F.least(F.lit(1.0), LONGEST / F.greatest(width, height))

    def side(x: Column) -> Column:
        return F.greatest(F.lit(STEP), F.floor(x * scale / STEP + 0.5) * STEP).cast("int")

    return F.struct(side(width).alias("width"), side(height).alias("height"))


def to_planes(rgb: np.ndarray, mean: tuple[float, ...] = MEAN, std: tuple[float, ...] = STD) -> np.ndarray:
    """Height, width, colour of bytes as normalised colour planes in single precision."""
    return ((rgb / 255 - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def without_seals(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(int) for k in range(3))
    return np.where(((r > 130) & (r - g > 45) & (r - b > 45))[..., None], np.uint8(255), rgb)


def turned(image: np.ndarray) -> np.ndarray:
    return image[::-1, ::-1]


def components(grid: np.ndarray) -> np.ndarray:
    """A number for each true pixel, equal for those connected by sides: the smallest place in the component; -1 elsewhere."""
    h, w = grid.shape
    wide = w + 2  # a false pixel on either side ends the runs of each row
    flat = np.pad(grid.astype(bool), ((0, 0), (1, 1))).ravel()
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    low, high = np.searchsorted(end, start + wide, "right"), np.searchsorted(start, end + wide, "left")  # runs of the next row beside each
    n = high - low
    above = np.repeat(np.arange(len(start)), n)
    below = np.arange(len(above)) + np.repeat(low - np.cumsum(n) + n, n)
    root = np.arange(len(start))
    while True:  # roots hang on the smallest one beside them, then all runs on their root
        a, b = root[above], root[below]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    out = np.full(grid.size, -1)
    first = start // wide * w + start % wide - 1
    out[np.flatnonzero(grid)] = np.repeat(first[root], end - start)
    return out.reshape(grid.shape)


def boxes(prob: np.ndarray) -> list[tuple[float, float, float, float, float]]:
    """x0, y0, x1, y1, score of likely components, grown, by bands from the top and from left to right within a band.

    A band ends where the next box's top is BAND or more below that of the one before; pairwise comparison of tops,
    as is sometimes done, isn't transitive and would let the order depend on the sort.
    """
    _, found = boxes_of([prob])
    return [tuple(b) for b in found.tolist()]


def boxes_of(maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of maps of one width, and a row as of `boxes` for each box, map by map. Maps are taken at once, one under the other."""
    heights, w = np.array([len(m) for m in maps]), maps[0].shape[1]
    gap = np.zeros((1, w))
    prob = np.concatenate([part for m in maps for part in (m, gap)])
    top = np.cumsum(heights + 1) - heights - 1
    label = components(prob > PIXEL)
    ys, xs = np.nonzero(label >= 0)
    if not len(ys):
        return np.zeros(0, int), np.zeros((0, 5))
    _, at = np.unique(label[ys, xs], return_inverse=True)
    count, total = np.bincount(at), np.bincount(at, prob[ys, xs])
    order, begin = np.argsort(at, kind="stable"), np.cumsum(count) - count
    kept = (count >= LEAST_AREA) & (total / count >= BOX)
    x0, x1 = (f.reduceat(xs[order], begin)[kept] for f in (np.minimum, np.maximum))
    y0, y1 = (f.reduceat(ys[order], begin)[kept] for f in (np.minimum, np.maximum))
    count, total = count[kept], total[kept]
    of = np.searchsorted(top, y0, "right") - 1
    y0, y1 = y0 - top[of], y1 - top[of]
    grow = count * UNCLIP / (2 * (x1 - x0 + y1 - y0 + 2))
    found = np.stack([np.maximum(0.0, x0 - grow), np.maximum(0.0, y0 - grow), np.minimum(w - 1.0, x1 + grow), np.minimum(heights[of] - 1.0, y1 + grow), total / count], axis=1)
    order = np.lexsort((found[:, 1], of))
    of, found = of[order], found[order]
    band = np.cumsum((np.diff(found[:, 1], prepend=0.0) >= BAND) | (np.diff(of, prepend=-1) != 0))
    order = np.lexsort((found[:, 0], band))
    return of[order], found[order]


def detect(maps: DataFrame, key: str = "page") -> DataFrame:
    """key, box_no, x0, y0, x1, y1, score from probability maps (key, width, height, prob: an array in rows)."""
    kind = maps.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, grids, pixels = [], [], 0
            for name, w, h, prob in zip(frame[key], frame["width"], frame["height"], frame["prob"], strict=True):
                if prob is None:
                    continue
                grid = np.asarray(prob, float).reshape(int(h), int(w))
                if grids and (grid.shape[1] != grids[0].shape[1] or pixels + grid.size > TOGETHER):
                    yield framed(names, grids)
                    names, grids, pixels = [], [], 0
                names.append(name)
                grids.append(grid)
                pixels += grid.size
            if grids:
                yield framed(names, grids)

    def framed(names: list, grids: list[np.ndarray]) -> pd.DataFrame:
        of, found = boxes_of(grids)
        out = pd.DataFrame(found, columns=["x0", "y0", "x1", "y1", "score"])
        out.insert(0, "box_no", np.arange(len(of)) - np.searchsorted(of, of))
        out.insert(0, key, pd.Series([names[k] for k in of], dtype=object))
        return out

    return maps.select(key, "width", "height", "prob").mapInPandas(run, f"{key} {kind}, box_no int, x0 double, y0 double, x1 double, y1 double, score double")


def rects(found: DataFrame) -> DataFrame:
    """Boxes (x0, y0, x1, y1 on a map of map_width by map_height) on a page of page_width by page_height, padded; without specks and rules."""

    def rounded(c: Column) -> Column:
        return F.floor(c + 0.5)

    sx, sy = F.col("page_width") / F.col("map_width"), F.col("page_height") / F.col("map_height")
    dx, dy = (F.col("x1") - F.col("x0")) * PAD_X, (F.col("y1") - F.col("y0")) * PAD_Y
    rows = found.withColumns({
        "x0": F.greatest(F.lit(0), rounded((F.col("x0") - dx) * sx)), "y0": F.greatest(F.lit(0), rounded((F.col("y0") - dy) * sy)),
        "x1": F.least("page_width", rounded((F.col("x1") + dx) * sx)), "y1": F.least("page_height", rounded((F.col("y1") + dy) * sy)),
    })
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rule = ((h < RULE) & (w / h > RULE_RATIO)) | ((w < RULE) & (h / w > RULE_RATIO))
    return rows.filter((w >= LEAST_SIDE) & (h >= LEAST_SIDE)).filter(~rule)


def inverted(crops: DataFrame, page: str = "page") -> DataFrame:
    """page, inverted: whether most of the eight tallest rectangles, three at least, are surely upside down.

    crops: page, box_no, height, p0, p180. Of equal heights the earlier box is taken.
    """
    tallest = F.row_number().over(Window.partitionBy(page).orderBy(F.col("height").desc(), "box_no"))
    voted = (F.col("p180") > 0.9) & (F.col("p180") > F.col("p0"))
    counts = crops.withColumn("k", tallest).filter("k <= 8").groupBy(page).agg(F.count_if(voted).alias("votes"), F.count(F.lit(1)).alias("n"))
    return counts.select(page, ((F.col("n") >= 3) & (F.col("votes") >= 3) & (F.col("votes") * 2 > F.col("n"))).alias("inverted"))


def ctc_decode(probs: Column, keys: Column) -> Column:
    """Struct of text, confidence and alts from steps of probabilities (array of arrays) over keys, whose first is the blank.

    The likeliest symbol of each step counts, repeats in a row once. Confidence is the mean over steps that aren't
    blank. Where the second symbol of an emitted step is likely enough, the two most doubtful places give another reading.
    """

    def step(p: Column) -> Column:
        ranked = F.slice(F.array_sort(F.transform(p, lambda x, j: F.struct((-x).alias("p"), j.alias("j")))), 1, 2)
        return F.get(
            F.transform(
                F.array(ranked),
                lambda r: F.struct(
                    F.when(r[0]["p"] < 0, r[0]["j"]).otherwise(0).alias("best"), (-r[0]["p"]).cast("double").alias("p"),
                    F.get(r, 1)["j"].alias("second"), (-F.get(r, 1)["p"]).cast("double").alias("q"),
                ),
            ),
            0,
        )

    def char(j: Column) -> Column:
        return F.when((j >= 1) & (F.get(keys, j) != "blank"), F.get(keys, j))

    def decoded(steps: Column) -> Column:
        real = F.filter(steps, lambda s: s["best"] != 0)
        sent = F.filter(steps, lambda s, i: (s["best"] != 0) & ((i == 0) | (s["best"] != F.coalesce(F.get(steps, i - 1)["best"], F.lit(-1)))))
        total = F.aggregate(real, F.lit(0.0), lambda a, s: a + s["p"])

        def readings(sent: Column) -> Column:
            text = F.array_join(F.transform(sent, lambda s: F.coalesce(char(s["best"]), F.lit(""))), "")
            doubt = F.transform(sent, lambda s, i: F.when((s["second"] > 0) & (s["q"] / s["p"] >= ALT_RATIO), F.struct((-(s["q"] / s["p"])).alias("r"), i.alias("at"), s["second"].alias("j"))))
            doubt = F.slice(F.array_sort(F.filter(doubt, lambda d: d.isNotNull())), 1, ALTS)
            other = F.transform(doubt, lambda d: F.when(d["at"] < F.length(text), F.concat(F.substr(text, F.lit(1), d["at"]), char(d["j"]), F.substr(text, d["at"] + 2))))
            return F.struct(
                text.alias("text"), F.when(F.size(real) > 0, total / F.size(real)).otherwise(0.0).alias("confidence"),
                F.array_distinct(F.filter(other, lambda v: v.isNotNull() & (v != text))).alias("alts"),
            )

        return F.get(F.transform(F.array(sent), readings), 0)

    return F.get(F.transform(F.array(F.transform(probs, step)), decoded), 0)


def sex_sign(rgba: np.ndarray) -> str | None:
    """F or M for a picture of the female or male sign, None where it is neither for sure.

    Both have a ring, so some white can't be reached from outside. The female sign is symmetric and has ink below; the male one
    isn't, and has ink at the upper right.
    """
    ink = rgba[..., :3].astype(int).sum(axis=2) < 384
    ys, xs = np.nonzero(ink)
    if len(ys) < 10:
        return None
    glyph = ink[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    h, w = glyph.shape
    if h < 12 or w < 12 or not 0.02 <= len(ys) / (h * w) <= 0.6:
        return None
    around = np.pad(~glyph, 1, constant_values=True)  # a white frame is connected with all white at the edges
    if (around & (components(around) != 0)).sum() < HOLE * h * w:
        return None

    def ink_in(x0: float, x1: float, y0: float, y1: float) -> float:
        a, b = int(np.floor(x0 * w)), int(np.floor(y0 * h))
        return float(glyph[b : max(int(np.ceil(y1 * h)), b + 1), a : max(int(np.ceil(x1 * w)), a + 1)].mean())

    half = w // 2
    alike = (glyph[:, :half] == glyph[:, ::-1][:, :half]).mean()
    below, corner = ink_in(0.28, 0.72, 0.62, 1), ink_in(0.7, 1, 0, 0.3)
    if alike >= SYMMETRY:
        return "F" if below > 0.15 and below > corner else None
    return "M" if corner > 0.25 and corner > below * 1.3 else None


def sex_signs(cells: DataFrame, key: str = "page") -> DataFrame:
    """key, sign from pictures of cells (key, width, height, rgba: bytes)."""
    schema = T.StructType([cells.schema[key], T.StructField("sign", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            signs = [
                None if raw is None else sex_sign(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 4))
                for raw, w, h in zip(frame["rgba"], frame["width"], frame["height"], strict=True)
            ]
            yield pd.DataFrame({key: frame[key], "sign": pd.Series(signs, dtype=object)})

    return cells.select(key, "width", "height", "rgba").mapInPandas(run, schema)


def sex_cell(lines: Column, boxes_of_page: Column) -> Column:
    """Struct of the box right of the label for the sex and the number of the line in it (NULL for none); NULL if there is no such box.

    A cell whose line says the sex already is passed over.
    """
    label = r"性别\s*/?\s*[Ss]ex|[Ss]ex\s*性\s*别|^\s*性\s*别\s*[:：]?\s*$"
    head = F.get(F.filter(lines, lambda l: l["text"].rlike(label)), 0)

    def near(head: Column) -> Column:
        box = head["bbox"]
        middle, height = (box["y0"] + box["y1"]) / 2, box["y1"] - box["y0"]
        right = F.filter(boxes_of_page, lambda r: (r["x0"] > box["x1"] + 10) & (F.abs((r["y0"] + r["y1"]) / 2 - middle) < height * 0.8))
        cell = F.get(F.array_sort(right), 0)

        def told(cell: Column) -> Column:
            over = F.filter(
                lines,
                lambda l: (l["line_no"] != head["line_no"]) & (l["bbox"]["x0"] < cell["x1"]) & (l["bbox"]["x1"] > cell["x0"])
                & (l["bbox"]["y0"] < cell["y1"]) & (l["bbox"]["y1"] > cell["y0"]),
            )
            line = F.get(over, 0)
            known = F.coalesce(line["text"].rlike("^(?i:[MF公母])$"), F.lit(False))
            return F.when(cell.isNotNull() & ~known, F.struct(cell.alias("cell"), line["line_no"].alias("line_no")))

        return F.get(F.transform(F.array(cell), told), 0)

    return F.get(F.transform(F.array(head), lambda h: F.when(h.isNotNull(), near(h))), 0)


def with_sex(lines: Column, rescued: Column, sign: Column) -> Column:
    """lines with the sign in its cell: in place of what was read there, or as a line of its own after the others."""
    def changed(l: Column) -> Column:
        text = F.when(rescued["line_no"].eqNullSafe(l["line_no"]), sign).otherwise(l["text"])
        return l.withField("text", text)

    own = F.struct((F.array_max(F.transform(lines, lambda l: l["line_no"])) + 1).alias("line_no"), sign.alias("text"), rescued["cell"].alias("bbox"))
    more = F.when(rescued["line_no"].isNull(), F.concat(lines, F.array(own))).otherwise(F.transform(lines, changed))
    return F.when(sign.isNull() | rescued.isNull(), lines).otherwise(more)


