import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import pages, pagestore, roster, segments

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def page_of(spark, lines, height=1000.0):
    rows = [(i, t, box) for i, (t, box) in enumerate(lines)]
    return spark.createDataFrame([(rows, height)], f"lines array<struct<line_no:int,text:string,bbox:{BOX}>>, h double")


def test_title(spark):
    page = page_of(spark, [("实验动物装箱单", (200.0, 10.0, 500.0, 40.0)), ("A123456", (50.0, 100.0, 150.0, 118.0)), ("目的地 上海", (50.0, 140.0, 200.0, 158.0))])
    assert page.select(pages.title(F.col("lines"), F.col("h")).alias("t")).first().t == "实验动物装箱单"
    assert page_of(spark, [("lo", (0.0, 0.0, 9.0, 9.0))]).select(pages.title(F.col("lines"), F.col("h")).alias("t")).first().t is None
    two = page_of(spark, [("某某研究所", (10.0, 10.0, 90.0, 40.0)), ("动物健康档案", (10.0, 45.0, 90.0, 75.0)), ("编号：1", (10.0, 80.0, 90.0, 110.0))])
    assert two.select(pages.title(F.col("lines"), F.col("h")).alias("t")).first().t == "某某研究所动物健康档案"


def test_list_page(spark):
    texts = [str(8343501 + i) for i in range(37)]
    row = spark.createDataFrame([(texts,)], "t array<string>").select(
        pages.largest_cluster(pages.candidates(F.col("t"))).alias("c"), pages.repeated_skeletons(F.col("t")).alias("s")
    )
    row = row.select("*", pages.is_list(F.col("c"), F.col("s"), F.lit(False)).alias("listed")).first()
    assert (row.c, row.s, row.listed) == (37, 0, True)  # a skeleton of one # is too short to count


def test_roster_prefers_letters_and_corrects(spark):
    ids = [(0, i, str(1000 + 37 * i)) for i in range(32)] + [(0, 32 + i, f"B{265001 + i}") for i in range(18)]
    built = roster.build_roster(spark.createDataFrame([("f", p, s, v) for p, s, v in ids], "file string, page int, seq int, id string"))
    assert built.first().roster == [f"B{265001 + i}" for i in range(18)]
    found = [v for _, _, v in ids]
    kind = "file string, page int, title string, id string, source string, evidence int, alts array<string>, candidates array<string>"
    page = spark.createDataFrame([("f", 0, None, None, None, 0, [], found), ("f", 1, None, "B265003N", "pool", 1, [], [])], kind)
    got = {r.page: r for r in roster.correct(page, built).collect()}
    assert got[0].roster_page and got[0].id is None
    assert (got[1].id, got[1].corrected, got[1].roster_page) == ("B265003", True, False)


def test_dense_numbers_are_not_corrected(spark):
    rows = spark.createDataFrame([("8343597", ["8343512", "8343083"]), ("B26500X", ["B265003", "B265004"])], "v string, r array<string>")
    match = roster.fuzzy_match(F.col("v"), F.col("r"), roster.allowed_edits(F.col("v")))
    assert [r.m for r in rows.select(match.alias("m")).collect()] == [None, None]


def test_imputation_needs_three_anchors(spark):
    kind = "file string, page int, archive boolean, id string, labelled boolean, roster array<string>"
    full = ["r0", "r1", "r2", "r3"]
    rows = [("a", i, True, None if i == 1 else f"R{i}", False, [x.upper() for x in full]) for i in range(4)]
    rows += [("b", i, True, None if i == 1 else f"R{i}", False, [x.upper() for x in full]) for i in range(3)]
    got = {(r.file, r.page): r.imputed for r in roster.impute(spark.createDataFrame(rows, kind)).collect()}
    assert got[("a", 1)] == "R1" and got[("b", 1)] is None and got[("a", 0)] is None


def cut(spark, rows):
    kind = "file string, page int, id string, title string, listed boolean"
    found = segments.segment_pages(spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], kind))
    return [(r.begin, r.end, r.id) for r in found.orderBy("seg_no").collect()]


def test_segments(spark):
    assert cut(spark, [("A", None, False), (None, None, False), ("B", None, False), (None, "质量合格证", False)]) == [(0, 1, "A"), (2, 2, "B"), (3, 3, None)]
    assert cut(spark, [("A", None, False), (None, None, True), (None, None, False), ("B", None, False)]) == [(0, 0, "A"), (1, 2, None), (3, 3, "B")]
    assert cut(spark, [("A", "健康档案", False), (None, "健康档案", False)]) == [(0, 0, "A"), (1, 1, None)]


def test_segments_partition_the_pages(spark):
    rng = random.Random(3)
    for _ in range(5):
        n = rng.randint(1, 9)
        rows = [(rng.choice([None, "A", "B"]), rng.choice([None, "报告", "健康档案", "发票"]), rng.random() < 0.2) for _ in range(n)]
        found = cut(spark, rows)
        assert [p for b, e, _ in found for p in range(b, e + 1)] == list(range(n))


def test_names_and_merging(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate("XYXX")], "out_seq int, name string")
    assert [r.final_name for r in segments.dedupe_names(names).orderBy("out_seq").collect()] == ["X", "Y", "X_2", "X_3"]
    outs = spark.createDataFrame([(0, "007", "a", False), (1, None, "b", True), (2, "7", "c", True), (3, None, "d", False)], "out_seq int, id string, source string, suspect boolean")
    no = F.lit(False)
    outs = outs.withColumns({"new_name": F.col("source"), "page_range": F.lit("1-1"), "debug": F.lit(None).cast("array<string>"), "guessed": no, "corrected": no, "off_roster": no, "low_conf": no})
    got = [(r.id, r.n, r.suspect, r.source) for r in segments.merge_documents(outs).orderBy("out_seq").collect()]
    assert got == [("007", 2, True, "a + c"), (None, 1, True, "b"), (None, 1, False, "d")]


@pytest.mark.parametrize("n", [0, 1, 400])
def test_suspects_first(spark, n):
    rows = [(i * 7 % 401, None if i % 5 == 4 else i % 3 == 0) for i in range(n)]
    found = segments.suspects_first(spark.createDataFrame(rows, "out_seq long, suspect boolean"))
    want = sorted(rows, key=lambda r: (not r[1], r[0]))
    assert sorted((r.place, r.out_seq, r.suspect) for r in found.collect()) == [(k, *r) for k, r in enumerate(want, 1)]


def test_recent_files(spark):
    touched = spark.createDataFrame([(f"f{i}", i) for i in range(8)], "file string, updated_at int")
    assert sorted(r.file for r in pagestore.recent_files(touched).collect()) == [f"f{i}" for i in range(2, 8)]
