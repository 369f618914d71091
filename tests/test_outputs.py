import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import pagestore, roster, segments
from sheaf.plans import documents
from sheaf.sinks import files
from sheaf.sources import intake

OUTPUTS = (
    "place int, out_seq int, file_name string, id string, new_name string, custom_name string, source string, page_range string, debug array<string>, "
    "guessed boolean, corrected boolean, off_roster boolean, low_conf boolean, suspect boolean, content binary, title string"
)


@pytest.fixture(scope="module")
def outs(spark):
    def row(k, i, name, custom, debug):
        return (k, k, None, i, name, custom, f"s{k}", "1-2", debug, False, False, False, False, False, bytearray(b"%PDF" + bytes([k])), None)

    rows = [row(1, "B1", "B1", None, ["性别/Sex F", "体重 8"]), row(2, "No.7", "x", None, ["t"]), row(3, None, "x", "", None), row(4, "B<2>", "y", "x", [])]
    return spark.createDataFrame(rows, OUTPUTS)


def test_zip(outs, tmp_path):
    named = files.display_names(outs.drop("file_name"))
    assert files.write_zip(named, f"{tmp_path}/a.zip") == 4
    with zipfile.ZipFile(f"{tmp_path}/a.zip") as z:
        assert z.namelist() == ["B1.pdf", "x.pdf", "x_2.pdf", "x_3.pdf", files.TEXTS]
        assert z.read("x.pdf") == b"%PDF\x02" and z.read(files.TEXTS).decode().startswith("===== B1 =====\n性别/Sex F\n体重 8\n\n===== x =====\nt")
    assert files.write_zip(named.limit(0), f"{tmp_path}/b.zip") == 0 and not (tmp_path / "b.zip").exists()


def test_workbook(outs, tmp_path):
    assert files.write_workbook(files.archive_table(outs), f"{tmp_path}/a.xlsx") == 2
    with zipfile.ZipFile(f"{tmp_path}/a.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert files.SHEET in z.read("xl/workbook.xml").decode()
    cells = re.findall(r'<c r="([A-Z]\d)"[^>]*><is><t[^>]*>([^<]*)</t>', sheet)
    assert [v for k, v in cells if k[1] == "1"] == list(files.HEADINGS)
    assert dict(cells)["A2"] == "B1" and dict(cells)["F2"] == "8" and dict(cells)["A3"] == "B&lt;2&gt;"
    assert files.write_workbook(files.archive_table(outs.limit(0)), f"{tmp_path}/b.xlsx") == 0


def test_pdf_files_and_intake(spark, outs, tmp_path):
    assert files.write_pdfs(files.display_names(outs.drop("file_name")), f"{tmp_path}/out") == 4
    (tmp_path / "out" / "note.txt").write_text("no")
    (tmp_path / "out" / "UP.PDF").write_bytes(b"%PDF")
    assert sorted(r["name"] for r in intake.pdf_files(spark, f"{tmp_path}/out").collect()) == ["B1", "UP", "x", "x_2", "x_3"]


def test_history(spark, tmp_path):
    schema = "time long, renamed string, debug array<string>"
    entries = spark.createDataFrame([(k, f"n{k}", [str(p) for p in range(12)]) for k in range(250)], schema)
    assert files.load_history(spark, f"{tmp_path}/none", schema).count() == 0
    files.save_history(entries, f"{tmp_path}/h")
    got = files.load_history(spark, f"{tmp_path}/h", schema).collect()
    assert sorted(r.time for r in got) == list(range(50, 250)) and all(len(r.debug) == files.HISTORY_PAGES for r in got)


def test_store(spark, tmp_path):
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "file string, page int, info string")
    pagestore.put(f"{tmp_path}/store", pages)
    pagestore.put(f"{tmp_path}/store", pages.filter("page = 1").withColumn("info", F.lit("new")))
    store = spark.read.parquet(f"{tmp_path}/store")
    wanted = spark.createDataFrame([("a", 1), ("b", 0), ("c", 5)], "file string, page int")
    got = pagestore.stored(wanted, store, ["file", "page"], ["info"]).collect()
    assert sorted((r.file, r.info) for r in got) == [("a", "new"), ("b", "z"), ("c", None)]
    assert pagestore.trimmed(store, 1).select("file").distinct().count() == 1


def test_merging_leaves_some_apart(spark, outs):
    rows = outs.unionByName(outs.filter("out_seq = 1").withColumns({"out_seq": F.lit(9), "id": F.lit("ｂ1"), "suspect": F.lit(True)}))
    got = {r.out_seq: r for r in segments.merge_documents(rows).collect()}
    assert set(got) == {1, 2, 3, 4} and (got[1].n, got[1].suspect, got[1].source, got[1].new_name) == (2, True, "s1 + s1", "B1")
    apart = spark.createDataFrame([(9,)], "out_seq int")
    assert set(r.out_seq for r in segments.merge_documents(rows, apart).collect()) == {1, 2, 3, 4, 9}


def test_split(spark, outs):
    cuts = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "out_seq int, before int")
    got = sorted((r.out_seq, r.part, r.page_range, r.new_name, r.id, r.suspect) for r in segments.split_output(outs, cuts).filter("out_seq < 3").collect())
    assert got == [(1, 0, "1-1", "B1", "B1", False), (1, 1, "2-2", "B1_第2页起", None, True), (2, 0, "1-2", "x", "No.7", False)]


def test_pasted_roster_and_texts(spark):
    files_ = spark.createDataFrame([("a",), ("b",)], "file string")
    own = spark.createDataFrame([("a", ["Q"])], "file string, roster array<string>")
    assert {r.file: r.roster for r in roster.external_roster(own, files_, " ,，").collect()} == {"a": ["Q"]}
    assert {r.file: r.roster for r in roster.external_roster(own, files_, "b1 B1;c").collect()} == {"a": ["B1", "C"], "b": ["B1", "C"]}
    sums = spark.createDataFrame([("",), ("a",), ("é中😀",), (None,)], "t string").select(T.fnv1a(F.col("t")).alias("s")).collect()
    assert [r.s for r in sums][:2] == ["811c9dc5:0", "e40c292c:1"] and sums[2].s.endswith(":4")


def test_every_document_query_has_sql():
    assert set(documents.QUERIES) == set(documents.SQL)
