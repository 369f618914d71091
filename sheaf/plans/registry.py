"""Queries over the driver's tables, by name, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import layout, pages, pagestore, roster, segments
from sheaf.plans import documents
from sheaf.plans.oracles import SQL
from sheaf.sources import tables

FLAGSHIP = "shape_clusters"


def lines_split(spark: SparkSession, d: str) -> DataFrame:
    return tables.lines(spark, d).select("doc_id", "line_no", F.length("line").alias("n_chars"), F.col("line").rlike("[0-9]").alias("has_digit"))


def token_candidates(spark: SparkSession, d: str) -> DataFrame:
    return tables.candidates(spark, d).select("doc_id", "line_no", "id")


def shape_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Distinct identifiers of each shape in each source."""
    shaped = tables.candidates(spark, d).select("source", "id", T.shape_key(F.col("id")).alias("shape")).filter("shape is not null")
    each = shaped.groupBy("source", "shape", "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("source", "shape").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("n").alias("n_lines"))


def _structure(lines: DataFrame) -> DataFrame:
    """lines with s: the structure of those with a digit or a #, the only ones whose structure has a #, if it is long enough."""
    found = lines.filter(F.col("line").rlike("[0-9#]")).withColumn("s", T.skeleton(F.col("line")))
    return found.withColumn("s", F.when((F.length("s") >= 4) & F.contains(F.col("s"), F.lit("#")), F.col("s")))


def skeleton_repeats(spark: SparkSession, d: str) -> DataFrame:
    """For each document the multiplicity of its most frequent line structure."""
    each = _structure(tables.lines(spark, d)).filter("s is not null").groupBy("doc_id", "s").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("doc_id").agg(F.max("n").alias("most_repeated"), F.count(F.lit(1)).alias("n_skeletons"))


def list_page_flag(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of one shape and lines of one structure in each document that has an identifier, both from one pass over its lines."""
    rows = _structure(tables.lines(spark, d)).withColumn("id", F.when(F.col("line").rlike("[0-9]"), F.upper(T.first_token(F.col("line"), True))))
    facts = F.array(F.struct(F.lit("").alias("shape"), F.col("s").alias("v")), F.struct(T.shape_key(F.col("id")).alias("shape"), F.col("id").alias("v")))
    facts = rows.select("doc_id", "s", "id").select("doc_id", F.explode(facts).alias("x")).select("doc_id", "x.shape", "x.v").filter("shape is not null and v is not null")
    each = facts.groupBy("doc_id", "shape", "v").agg(F.count(F.lit(1)).alias("n"))
    kinds = each.groupBy("doc_id", "shape").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most"))
    both = kinds.groupBy("doc_id").agg(
        F.max(F.when(F.col("shape") != "", F.col("n"))).alias("cluster"), F.coalesce(F.max(F.when(F.col("shape") == "", F.col("most"))), F.lit(0)).alias("repeats")
    ).filter("cluster is not null")
    return both.select("doc_id", "cluster", "repeats", pages.is_list(F.col("cluster"), F.col("repeats"), F.lit(False)).alias("list_page"))


def garbage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Noise among the lines, with a confidence derived from the line's number."""
    rows = tables.lines(spark, d).withColumn("confidence", (F.col("line_no") * 37 % 100) / 100.0)
    return rows.select("doc_id", "line_no", T.garbage_line(F.col("line"), F.col("confidence")).alias("garbage"))


def title_pick(spark: SparkSession, d: str) -> DataFrame:
    """The line that looks most like the title of each document, and its score."""
    best = pages.title_lines(tables.positioned(spark, d), ["doc_id"])
    return best.select("doc_id", "line_no", F.round("score", 6).alias("score"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as cells of a page, three in a row: a key on every second one, a priority on the others."""
    orders = tables.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    col, row = F.col("o_orderkey") % 3, F.floor(F.col("o_orderkey") / 3) % 40
    box = F.struct((col * 200.0).alias("x0"), (row * 30.0).alias("y0"), (col * 200.0 + 120).alias("x1"), (row * 30.0 + 16).alias("y1"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("K"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))).otherwise(F.col("o_orderpriority"))
    line = F.struct(F.col("o_orderkey").alias("line_no"), text.alias("text"), box.alias("bbox"))
    return orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def _near(spark: SparkSession, d: str, look: Callable) -> DataFrame:
    found = cells(spark, d).select("o_custkey", F.explode(F.transform("lines", lambda l: F.struct(l["line_no"].alias("k"), look(F.col("lines"), l).alias("v")))).alias("x"))
    return found.filter("x.v is not null").select("o_custkey", F.col("x.k").alias("label_key"), F.col("x.v").alias("value"))


def right_cell(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, layout.right_cell)


def below_cell(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, layout.below_cell)


def _rosters(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a register: a nation is a file, customers of one segment a page; an entry has six digits, which name no later customer."""
    rows = tables.read(spark, d, "customer").filter("c_custkey < 1000000").select(
        F.col("c_nationkey").alias("file"), F.ascii("c_mktsegment").cast("long").alias("page"), F.col("c_custkey").alias("seq"),
        F.concat(F.lit("B"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("id"),
    )
    return roster.build_roster(rows)


def roster_build(spark: SparkSession, d: str) -> DataFrame:
    return _rosters(spark, d).select("file", F.size("roster").alias("n"), F.array_join("roster", ",").alias("ids"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("file"), F.concat(F.lit("B"), F.lpad((F.col("s_suppkey") * 13 % 1500).cast("string"), 6, "0")).alias("id")
    )


def roster_fuzzy_unique(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' keys held against the roster of their nation; letters at the end are misread."""
    rows = _suppliers(spark, d).withColumn("id", F.when(F.col("s_suppkey") % 2 == 0, F.concat("id", F.lit("N"))).otherwise(F.col("id")))
    rosters = _rosters(spark, d)
    found = roster.meant(rows, rosters.select("file", F.explode("roster").alias("entry")))
    return rows.join(rosters.select("file"), "file").join(found, ["file", "id"], "left").select("s_suppkey", "match")


def roster_page_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which entries of its nation's roster each balance class of suppliers lists, and whether it is a roster page."""
    listed = tables.read(spark, d, "supplier").select("s_suppkey", F.floor(F.col("s_acctbal") / 2000).alias("page")).join(_suppliers(spark, d), "s_suppkey")
    each = listed.groupBy("file", "page").agg(F.collect_set("id").alias("candidates")).join(_rosters(spark, d), "file")
    found = each.withColumn("hits", roster.hits(F.col("roster"), F.col("candidates")))
    return found.select("file", "page", F.size("hits").alias("n_hits"), F.array_join(F.array_sort("hits"), ",").alias("hits"), (F.size("hits") >= 3).alias("roster_page"))


def roster_impute(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as archive pages: those of one role in three have lost their identifier."""
    turns = tables.read(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page"))
    name = F.concat(F.lit("T"), F.lpad(F.col("page").cast("string"), 4, "0"))
    whole = turns.groupBy("file").agg(F.array_sort(F.collect_set(name)).alias("roster"))
    rows = turns.join(whole, "file").withColumns({"archive": F.lit(True), "labelled": F.lit(False), "id": F.when(F.col("page") % 3 != 1, name)})
    return roster.impute(rows).select("file", "page", "imputed")


def dedupe_names(spark: SparkSession, d: str) -> DataFrame:
    parts = tables.read(spark, d, "part").select(F.col("p_partkey").alias("out_seq"), F.col("p_name").alias("name"))
    return segments.dedupe_names(parts).select("out_seq", "final_name")


def name_template(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    people = tables.read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    both = orders.join(people, orders["o_custkey"] == people["c_custkey"])
    title = F.when(F.col("o_orderkey") % 3 != 0, F.col("c_mktsegment"))
    name = T.make_name("template", title, F.col("c_name"), F.lit("none"), F.lit("{编号}__{标题}_{来源}"), F.col("o_orderpriority"))
    return both.select("o_orderkey", name.alias("name"))


def normal_dates(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.read(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M-d-yy")).otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    return orders.select("o_orderkey", T.normal_date(day).alias("day"))


def suspect_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each labelled document when those of low quality come first."""
    labels = tables.read(spark, d, "labels").select("doc_id", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("suspect"))
    return segments.suspects_first(labels, "doc_id")


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return pagestore.left_to_do(tables.read(spark, d, "documents").select("doc_id", "source"), tables.read(spark, d, "labels"), ["doc_id"])


def lru_files(spark: SparkSession, d: str) -> DataFrame:
    touched = tables.read(spark, d, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("updated_at"))
    return pagestore.recent_files(touched).select("file")


def history_top(spark: SparkSession, d: str) -> DataFrame:
    return pagestore.history(tables.read(spark, d, "events").select("event_id", "ts", "user_id"), "ts", "event_id").select("event_id", "user_id")


def retry_select(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose first line would be the title and which have no identifier."""
    docs = tables.read(spark, d, "documents")
    none = F.size(T.tokens(F.col("text"))) == 0
    title = F.when(F.col("n_chars") > 300, F.lit("健康档案")).otherwise(F.lit("报告"))
    rows = docs.select("doc_id", pagestore.to_retry(title, F.when(~none, F.lit("x")), F.lit("label")).alias("retry"))
    return rows.filter("retry").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        lines_split, token_candidates, shape_clusters, skeleton_repeats, list_page_flag, garbage_lines, title_pick, right_cell, below_cell,
        roster_build, roster_fuzzy_unique, roster_page_hits, roster_impute, dedupe_names, name_template, normal_dates, suspect_order,
        resume_antijoin, lru_files, history_top, retry_select,
    )
    return {f.__name__: f for f in every} | documents.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | documents.SQL
