import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("7050004M12-12-258958", "7050004"), ("B265002SEX", "B265002"), ("230-258", None), ("1DAM", None), ("RHEA", None),
        ("HER2000-01-001", None), ("12-12-25", None), ("B265003", "B265003"), ("12F", None), ("123FEMALE", "123"),
    ],
)
def test_clean_token(spark, raw, expected):
    assert one(spark, T.clean_token, raw) == expected


@pytest.mark.parametrize(("raw", "expected"), [("aB12-C345", None), ("x B265003 7050001", "B265003"), ("号B26500", None), (None, None), ("", None)])
def test_first_token(spark, raw, expected):
    assert one(spark, lambda c: T.first_token(c, True), raw) == expected


@pytest.mark.parametrize(("raw", "expected"), [("B265003", "B#6"), ("7050001", "#7"), ("B26-5", None), (None, None)])
def test_shape_key(spark, raw, expected):
    assert one(spark, T.shape_key, raw) == expected


def test_skeleton(spark):
    assert one(spark, T.skeleton, "7050001 M 12-02-25") == "#A#-#-#"
    assert one(spark, T.skeleton, "编号　B1") == "中A#"


@pytest.mark.parametrize(("raw", "expected"), [("１２３", "123"), (" 00123 ", "123"), ("t 12", "T12"), ("000", "0"), ("", "")])
def test_merge_key(spark, raw, expected):
    assert one(spark, T.merge_key, raw) == expected
    assert one(spark, T.merge_key, expected) == expected


@pytest.mark.parametrize(("raw", "expected"), [("12-29-25", "251229"), ("2025-12-29", "251229"), ("none", "none")])
def test_normal_date(spark, raw, expected):
    assert one(spark, T.normal_date, raw) == expected


@pytest.mark.parametrize(("raw", "sure", "expected"), [("涵涵厅涵", 0.9, True), ("2291242", 0.4, False), ("ab", 0.4, True), ("plain text", 0.9, False)])
def test_garbage_line(spark, raw, sure, expected):
    assert one(spark, lambda c: T.garbage_line(c, F.lit(sure)), raw) is expected


def test_names(spark):
    name = lambda template, title: T.name_from_template(F.lit(template), F.lit("B1"), title, F.lit("s"))
    nothing = F.lit(None).cast("string")
    row = spark.range(1).select(name("{编号}_{标题}", nothing).alias("a"), name("{编号}_{标题}/{来源}", F.lit("t")).alias("b")).first()
    assert (row.a, row.b) == ("B1", "B1_ts")
    assert one(spark, T.clean_rename, " a:b.PDF") == "ab" and one(spark, T.clean_rename, ".pdf") is None
    assert one(spark, T.roster_text, "7050001, 7050002\n7050001；X1") == ["7050001", "7050002", "X1"]


@pytest.mark.parametrize(("a", "b", "expected"), [("质量合格证", "合格证编号", True), ("猴群健康档案", "健康档案", True), ("发货清单", "检疫报告", False), (None, "x", False)])
def test_same_title(spark, a, b, expected):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.same_title(F.col("a"), F.col("b")).alias("r")).first().r is expected
