import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import imaging
from sheaf.sources import textlayer


def flood(grid):
    """The components by a plain search, each as a set of places."""
    left, out = {tuple(map(int, p)) for p in np.argwhere(grid)}, []
    while left:
        todo, found = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            found.add((y, x))
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in left:
                    left.discard(p)
                    todo.append(p)
        out.append(frozenset(found))
    return set(out)


@pytest.mark.parametrize("seed", range(6))
def test_components_equal_a_search(seed):
    grid = np.random.default_rng(seed).random((23, 31)) < 0.35 + 0.05 * seed
    label = imaging.components(grid)
    found = {frozenset(tuple(map(int, p)) for p in np.argwhere(label == k)) for k in np.unique(label) if k >= 0}
    assert found == flood(grid) and ((label >= 0) == grid).all()


def test_boxes():
    prob = np.zeros((60, 100))
    prob[10:20, 50:80], prob[12:22, 5:25], prob[40:50, 10:90] = 0.9, 0.8, 0.7
    prob[30:33, 0:5] = 0.9  # too small
    prob[55:60, 0:60] = 0.4  # too unsure
    got = imaging.boxes(prob)
    assert [round(b[4], 2) for b in got] == [0.8, 0.9, 0.7]  # one band from left to right, then the next
    grow = 300 * 1.6 / (2 * 40)
    assert got[1][:4] == pytest.approx((50 - grow, 10 - grow, 79 + grow, 19 + grow))
    assert imaging.boxes(np.zeros((3, 3))) == []


def test_boxes_of_many_maps_equal_those_of_each():
    rng = np.random.default_rng(5)
    maps = [np.where(np.kron(rng.random((h, 10)) < 0.4, np.ones((6, 6))) > 0, 0.9, 0.1) * rng.uniform(0.8, 1, (6 * h, 60)) for h in (5, 1, 9, 3, 7)] + [np.zeros((4, 60))]
    of, found = imaging.boxes_of(maps)
    for k, m in enumerate(maps):
        assert found[of == k].tolist() == [list(b) for b in imaging.boxes(m)]
    assert set(of) == {0, 1, 2, 3, 4}


def test_components_take_steps_by_runs_not_by_pixels():
    began = time.perf_counter()
    label = imaging.components(np.indices((1500, 1500)).sum(axis=0) % 7 > 0)
    assert len(np.unique(label)) > 400 and time.perf_counter() - began < 20
    spiral = np.ones((401, 401), bool)
    for k in range(1, 190, 2):  # rings that are open at one place: sweeps would need one turn for each
        spiral[k, k : 401 - k] = spiral[400 - k, k : 401 - k] = spiral[k : 401 - k, k] = spiral[k : 401 - k, 400 - k] = False
        spiral[k, k + 1 + k % 3] = True
    began = time.perf_counter()
    assert set(np.unique(imaging.components(spiral))) == {-1, 0} and time.perf_counter() - began < 1


def ring(size=40, thick=3):
    y, x = np.mgrid[:size, :size]
    d = np.hypot(y - 14, x - size / 2 + 0.5)
    return (d < 12) & (d > 12 - thick)


def picture(ink):
    out = np.full((*ink.shape, 4), 255, np.uint8)
    out[ink] = (0, 0, 0, 255)
    return out


def test_sex_signs(spark):
    female, male = ring(), np.flipud(ring())
    female[25:39, 18:22] = True
    female[31:34, 12:28] = True
    for k in range(12):
        male[9 - k // 2 + 4 : 13 - k // 2 + 4, 26 + k // 2 : 30 + k // 2] = True
    male[0:4, 28:40] = male[0:12, 36:40] = True
    letter = np.zeros((40, 40), bool)
    letter[2:38, 5:9] = letter[2:6, 5:30] = letter[18:22, 5:24] = True
    assert imaging.sex_sign(picture(female)) == "F" and imaging.sex_sign(picture(male)) == "M"
    assert imaging.sex_sign(picture(letter)) is None and imaging.sex_sign(picture(np.zeros((20, 20), bool))) is None
    rows = [(k, 40, 40, bytearray(picture(g).tobytes())) for k, g in enumerate((female, male, letter))] + [(3, 40, 40, None)]
    got = imaging.sex_signs(spark.createDataFrame(rows, "page int, width int, height int, rgba binary")).collect()
    assert sorted((r.page, r.sign) for r in got) == [(0, "F"), (1, "M"), (2, None), (3, None)]


def test_pictures():
    rgb = np.array([[[200, 100, 100], [120, 10, 10]], [[131, 90, 85], [131, 85, 85]]], np.uint8)
    assert imaging.without_seals(rgb).reshape(4, 3).tolist() == [[255] * 3, [120, 10, 10], [131, 90, 85], [255] * 3]
    assert (imaging.turned(imaging.turned(rgb)) == rgb).all() and imaging.turned(rgb)[0, 0].tolist() == [131, 85, 85]
    planes = imaging.to_planes(rgb)
    assert planes.shape == (3, 2, 2) and planes[0, 0, 0] == pytest.approx((200 / 255 - 0.485) / 0.229, rel=1e-6)


def test_decoding(spark):
    steps = [[0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.9, 0.1, 0.0], [0.0, 0.6, 0.4], [0.1, 0.1, 0.8]]
    rows = [(steps,), ([[0.9, 0.1, 0.0]],), ([],)]
    keys = F.array(*[F.lit(k) for k in ("blank", "A", "B")])
    got = [r.x for r in spark.createDataFrame(rows, "p array<array<double>>").select(imaging.ctc_decode(F.col("p"), keys).alias("x")).collect()]
    assert [(x.text, x.alts) for x in got] == [("AAB", ["ABB"]), ("", []), ("", [])]
    assert got[0].confidence == pytest.approx((0.8 + 0.8 + 0.6 + 0.8) / 4) and got[1].confidence == 0


def test_sex_cell(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    lines = [(0, "性别/Sex", (10.0, 10.0, 60.0, 30.0)), (1, "早", (80.0, 10.0, 95.0, 30.0))]
    df = spark.createDataFrame([(lines, [(80.0, 10.0, 95.0, 30.0), (200.0, 10.0, 220.0, 30.0)]), (lines[:1], [(100.0, 11.0, 120.0, 29.0)]), (lines[:1], [])], f"lines array<struct<line_no:int,text:string,bbox:{box}>>, rects array<{box}>")
    df = df.withColumn("cell", imaging.sex_cell(F.col("lines"), F.col("rects")))
    got = df.select("cell", imaging.with_sex(F.col("lines"), F.col("cell"), F.lit("F")).alias("lines")).collect()
    assert [(r.cell and (r.cell.cell.x0, r.cell.line_no)) for r in got] == [(80.0, 1), (100.0, None), None]
    assert [[x.text for x in r.lines] for r in got] == [["性别/Sex", "F"], ["性别/Sex", "F"], ["性别/Sex"]]


def test_text_layer(spark):
    rng = random.Random(3)
    rows = [(p, f"w{i} text", float(rng.randint(0, 400)), float(rng.choice([700, 702, 650, 600])), 40.0, float(rng.choice([10, 12])), 800.0) for p in range(5) for i in range(12)]
    rows += [(9, "short", 0.0, 1.0, 5.0, 10.0, 800.0), (8, "  ", 0.0, 1.0, 5.0, 10.0, 800.0)]
    schema = "page int, text string, x double, baseline double, width double, height double, page_height double"
    got = {r.page: [(x.text, tuple(x.bbox)) for x in r.lines] for r in textlayer.text_layer(spark.createDataFrame(rows, schema), ["page"]).collect()}
    for p in range(5):
        want = []
        for top, x, t, h, w in sorted((800 - b - h, x, t, h, w) for q, t, x, b, w, h, _ in rows if q == p):
            if want and abs(want[-1][1][1] - top) < h * 0.5 and x - want[-1][1][2] < h * 2:
                old, (a, b, c, d) = want[-1]
                want[-1] = (f"{old} {t}", (a, min(b, top), max(c, x + w), max(d, top + h)))
            else:
                want.append((t, (x, top, x + w, top + h)))
        assert got[p] == want
    assert set(got) == set(range(5))
