import pytest
from pyspark.sql import functions as F

from sheaf.operators import archive, pageinfo

ROWS = {
    "a": ("动物编号：B265001\n性别/Gender\n体重/Bodyweight:（kg）\n8.9", "B265001", {"weight": "8.9", "sex": None}),
    "b": ("动物编号 027\n体重\nDateofBirth\nWeight(kg)\n2.30", "027", {"weight": "2.30"}),
    "c": ("动物编号：B265002\n性别/Sex F\n体重 8.5\n体检记录正常", "B265002", {"weight": "8.5", "sex": "F"}),
    "d": ("动物编号：B265005\n性别/Sex M\n体重 8.5", "B265005", {"sex": "M"}),
    "e": ("动物编号：B265003\n性别\n♀\n体重 7.2", "B265003", {"sex": "F", "weight": "7.2"}),
    "a2": ("体重/Bodyweight:（kg）\n8.9\n备注\n体重 9.4", "B265001", {"weight": "9.4"}),
    "a3": ("体重 9.4\n备注\n体重/Bodyweight:（kg）\n8.9", "B265001", {"weight": "8.9"}),
    "window": ("发货 8-17-26\n7050002\nM\n12-30-25\n2291242\n2230660", "7050002", {"birth": "12-30-25", "sire": "2291242", "dam": "2230660", "sex": "M"}),
    "joined": ("7050001 12-29-25578330001933169", "7050001", {"birth": "12-29-25", "sire": "5783300", "dam": "01933169"}),
    "labels": ("Date of Birth 2025-1-2\nFather No.\nthefather\nA12345\n母号 B77777\nSex of animal", "X1", {"birth": "2025-1-2", "sire": "A12345", "dam": "B77777", "sex": "F"}),
    "embedded": ("父号\n2230660thefather", "X1", {"sire": "2230660"}),
    "nothing": ("", "X1", {"birth": None, "sire": None, "dam": None, "sex": None, "weight": None}),
}


def test_fields(spark):
    rows = [(k, t.split("\f"), i) for k, (t, i, _) in ROWS.items()] + [("null", None, None)]
    df = spark.createDataFrame(rows, "k string, pages array<string>, id string")
    got = {r.k: r.f for r in df.select("k", archive.fields(F.col("pages"), F.col("id")).alias("f")).collect()}
    for k, (_, _, want) in ROWS.items():
        assert {f: got[k][f] for f in want} == want, k
    assert not any(got["null"])


def test_row_and_note(spark):
    df = spark.createDataFrame([(["性别/Sex F\n体重 8"], "B1", True, 2)], "pages array<string>, id string, guessed boolean, merged int")
    no = F.lit(False)
    row = archive.archive_row(
        F.col("pages"), F.col("id"), F.lit("a"), F.lit("1-2"), lambda f: archive.note(f, F.col("guessed"), no, no, F.col("merged"), F.lit(""))
    )
    got = df.select(row.alias("r")).first().r
    assert (got.animal_id, got.sex, got.weight, got.birth, got.source, got.pages) == ("B1", "F", "8", "", "a", "1-2")
    assert got.note == "编号为顺序推定；合并2个来源；出生日期未识别；父亲编号未识别；母亲编号未识别"


def test_languages_are_compared(spark):
    zh, en = ["性别/Sex F\n出生日期 12-29-25\n父号 A12345\n体重 8.50"], ["Sex M\nDate of Birth 2025-12-29\nFather No. B12345\nweight 8.5"]
    df = spark.createDataFrame([(zh, en)], "zh array<string>, en array<string>")
    check = archive.language_check(archive.fields(F.col("zh"), F.lit("Q")), archive.fields(F.col("en"), F.lit("Q")))
    assert df.select(check.alias("c")).first().c == "中英字段不一致：性别中F/英M"


def line(n, text, x0, y0, x1, y1):
    return n, text, (float(x0), float(y0), float(x1), float(y1))


PAGES = {
    "packing": ([("实验动物装箱单", 200, 10, 500, 40), ("A123456", 50, 100, 150, 118), ("目的地 上海", 50, 140, 200, 158)], 1000, (None, None)),
    "transport": ([("实验动物运输明细", 200, 10, 500, 40), ("A123456", 50, 100, 150, 118), ("目的地 上海", 50, 140, 200, 158)], 1000, ("A123456", "pool")),
    "list": ([("实验动物装箱单", 200, 10, 500, 40), *[(f"{8343501 + i}", 50, 100 + 20 * i, 150, 116 + 20 * i) for i in range(37)]], 900, (None, None)),
    "group": ([("猴群体健康档案", 200, 10, 500, 40), ("猴号 A190123", 50, 100, 250, 118), ("病毒检测", 50, 140, 150, 158), ("STLV-1（-）", 50, 180, 150, 198)], 1000, ("A190123", "label")),
    "certificate": ([("动物质量合格证", 200, 10, 500, 40), ("4600419780", 50, 50, 200, 66), ("4600419780", 50, 800, 200, 816), ("13912345678", 50, 60, 200, 70), ("13912345678", 50, 860, 200, 870)], 1000, ("No.4600419780", "fallback")),
    "report": ([("检测报告", 200, 10, 500, 40), ("报告编号：", 50, 100, 150, 118), ("A20260101", 160, 100, 300, 118)], 1000, ("No.A20260101", "fallback")),
    "named": ([("巴马猪健康档案", 200, 10, 500, 40), ("性别", 50, 100, 150, 118)], 1000, ("B265009", "filename")),
    "empty": ([], 1000, ("B265009", "filename")),
}


@pytest.fixture(scope="module")
def info(spark):
    schema = "k string, name string, lines array<struct<line_no:int,text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>, page_height double"
    rows = [(k, "B265009.pdf" if k in ("named", "empty") else None, [line(i, *x) for i, x in enumerate(ls)], float(h)) for k, (ls, h, _) in PAGES.items()]
    return {r.k: r for r in pageinfo.page_info(spark.createDataFrame(rows, schema), "name").collect()}


@pytest.mark.parametrize("k", PAGES)
def test_page_info(info, k):
    assert (info[k].animal_id, info[k].id_source) == PAGES[k][2]


def test_page_facts(info):
    assert info["list"].list_page and not info["packing"].list_page and info["group"].species == "monkey" and info["named"].species == "pig"
    assert not any("STLV" in v for v in info["group"].id_candidates) and info["group"].title == "猴群体健康档案"
    assert info["empty"].title is None and info["certificate"].id_evidence == 2
