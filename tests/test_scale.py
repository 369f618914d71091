"""What shows only at size: keys that look like dates, and files of one row group."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sheaf.operators import pages, roster
from sheaf.plans import registry
from sheaf.sources import tables


def both(spark, folder, name):
    """The rows of a query and of its SQL over the Parquet files of a folder."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=str), sorted(con.sql(f"SELECT {listed} FROM ({registry.oracle_sql()[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", ["pool_rescue", "cells_below", "page_info", "number_search", "label_search"])
def test_keys_that_look_like_dates(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT k AS p_partkey FROM range(200096, 200128) t(k) UNION ALL SELECT k + 1000000 FROM range(200096, 200128) t(k)) TO '{tmp_path}/part.parquet'")
    ours, theirs = both(spark, tmp_path, name)
    assert ours == theirs


def test_meant_equals_fuzzy_match(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("AB1") for _ in range(rng.randint(0, 5))) if rng.random() < 0.6 else "".join(rng.choice("12") for _ in range(rng.randint(1, 5)))
    lists = [(f, sorted({word() for _ in range(n)})) for f, n in enumerate((1, 2, 4, 12, 3, 2, 1, 5))]
    ids = sorted({(f, word()) for f, _ in lists for _ in range(60)})
    kind = "file int, id string"
    rows, rosters = spark.createDataFrame(ids, kind), spark.createDataFrame(lists, "file int, roster array<string>")
    plain = roster.fuzzy_match(F.col("id"), F.col("roster"), roster.allowed_edits(F.col("id")))
    want = {(r.file, r.id, r.m) for r in rows.join(rosters, "file").select("file", "id", plain.alias("m")).collect() if r.m is not None}
    got = {tuple(r) for r in roster.meant(rows, rosters.select("file", F.explode("roster").alias("entry"))).collect()}
    assert got == want and len(got) > 20


def test_pages_carry_no_roster(spark):
    built = spark.createDataFrame([("f", [f"B{k:06d}" for k in range(50)])], "file string, roster array<string>")
    kind = "file string, page int, title string, id string, source string, evidence int, alts array<string>, candidates array<string>"
    rows = [("f", k, "档案", None if k == 2 else f"B{k:06d}", "pool", 1, [], ["b000009"]) for k in range(5)] + [("g", 0, None, "X", "pool", 1, None, None)]
    fixed = roster.correct(spark.createDataFrame(rows, kind), built)
    assert sorted((r.file, r.page, r.id, r.guessed) for r in fixed.collect()) == [("f", k, f"B{k:06d}", k == 2) for k in range(5)] + [("g", 0, "X", False)]
    assert "fuzzy" not in fixed._jdf.queryExecution().toString() and "levenshtein" not in fixed._jdf.queryExecution().optimizedPlan().toString()


def test_best_lines_equal_those_of_whole_pages(spark):
    texts = ["Some heading of it", "12 34", "健康档案", "lower begins", "A: field", "Page 3", "A#1234", "Report 2024-05", "某某公章", ""]
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice(texts) for _ in range(rng.randint(1, 9)))) for k in range(80)]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("parts", F.split("text", "\n"))
    line = lambda t, i: F.struct(i.alias("line_no"), t.alias("text"), F.struct(F.lit(0.0).alias("x0"), (i * 20.0).alias("y0"), (F.length(t) * 8.0).alias("x1"), (i * 20.0 + 16).alias("y1")).alias("bbox"))
    df = df.select("k", F.transform("parts", line).alias("lines"), (F.size("parts") * 20.0).alias("page_height"))
    want = df.select("k", pages.title_line(F.col("lines"), F.col("page_height")).alias("t")).filter("t is not null").select("k", "t.score", "t.line_no")
    assert sorted(map(tuple, pages.title_lines(df, ["k"]).collect())) == sorted(map(tuple, want.collect()))


def test_one_row_group_is_dealt_to_many_tasks(spark):
    assert tables.lines(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 4
    assert tables.positioned(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 4
