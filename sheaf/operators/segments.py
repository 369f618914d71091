"""Cutting a file's pages into documents, and merging documents that name one subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import archive

_SEGMENT = "struct<begin:bigint,end:bigint,id:string>"
_STATE = f"struct<begin:bigint,last:bigint,id:string,titled:boolean,archive:boolean,out:array<{_SEGMENT}>>"


def _fold(state: Column, page: Column) -> Column:
    """One page more: whether it begins a document depends on the identifier and titles of the one that is open."""
    new_id = page["id"] != state["id"]
    kind = page["kind"] & (state["id"].isNotNull() | state["titled"])
    other = ~(state["titled"] & page["like_last"]) | (page["archive"] & state["archive"])
    turn = (
        F.when(page["listed"], F.lit(True))
        .when(page["id"].isNotNull(), state["id"].isNull() | new_id)
        .otherwise(kind & other)
    )
    cut = (page["page"] > state["begin"]) & state["last"].isNotNull() & turn

    def unless(old: Column, new: Column) -> Column:
        return F.when(cut, new).otherwise(old)

    done = F.struct(state["begin"].alias("begin"), state["last"].alias("end"), state["id"].alias("id"))
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.when(cut | state["last"].isNull(), page["page"]).otherwise(state["begin"]).alias("begin"),
        page["page"].alias("last"),
        F.coalesce(page["id"], unless(state["id"], nothing)).alias("id"),
        (page["title"].isNotNull() | unless(state["titled"], F.lit(False))).alias("titled"),
        (page["archive"] | unless(state["archive"], F.lit(False))).alias("archive"),
        F.when(cut, F.concat(state["out"], F.array(done))).otherwise(state["out"]).alias("out"),
    )


def segment_pages(pages: DataFrame) -> DataFrame:
    """file, seg_no, begin, end, id from pages (file, page, id, title, listed): documents within each file.

    A document ends where another identifier comes, at pages that list many subjects, and, among pages without an
    identifier, where a title names another kind of document or another archive begins.
    """
    order = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("title", ignorenulls=True).over(order)
    yes = F.coalesce(F.contains(F.col("title"), F.lit("档案")), F.lit(False))
    rows = pages.select(
        "file",
        F.struct(
            F.col("page").cast("long").alias("page"),
            T.missing(F.col("id")).alias("id"),
            "title",
            F.coalesce("listed", F.lit(False)).alias("listed"),
            F.coalesce(F.col("title").rlike(T.DOCUMENT_WORDS), F.lit(False)).alias("kind"),
            yes.alias("archive"),
            T.same_title(F.col("title"), last).alias("like_last"),
        ).alias("p"),
    )
    start = F.expr(f"cast(named_struct('begin', 0L, 'last', null, 'id', null, 'titled', false, 'archive', false, 'out', array()) as {_STATE})")
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("pages"))

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["last"].alias("end"), s["id"].alias("id"))))

    cut = whole.select("file", F.posexplode(F.aggregate("pages", start, _fold, finish)).alias("seg_no", "s"))
    return cut.select("file", "seg_no", "s.begin", "s.end", "s.id")


def one_page_each(pages: DataFrame) -> DataFrame:
    """file, seg_no, begin, end, id: every page by itself."""
    page = F.col("page").cast("long")
    return pages.select("file", F.col("page").cast("int").alias("seg_no"), page.alias("begin"), page.alias("end"), T.missing(F.col("id")).alias("id"))


def whole_files(pages: DataFrame) -> DataFrame:
    """file, seg_no, begin, end, id: each file is one document, with the identifier of its first page."""
    cut = pages.groupBy("file").agg(F.min("page").cast("long").alias("begin"), F.max("page").cast("long").alias("end"), F.min_by(T.missing(F.col("id")), "page").alias("id"))
    return cut.select("file", F.lit(0).alias("seg_no"), "begin", "end", "id")


SPLITS = {"group": segment_pages, "page": one_page_each, "whole": whole_files}


def assemble(pages: DataFrame, segs: DataFrame, mode: str = "id", template: str = "") -> DataFrame:
    """One output for each document: file, seg_no, title, id, new_name, page_range, flags, suspect, debug.

    pages: file, page (from 0), id, title, source, guessed, corrected, off_roster, text. The identifier is the document's,
    else that of the first page with identifier or title. A flag holds if it does for a page of this identifier; low_conf
    if that came from no label. An output without an identifier, with a flag or, if it is a subject's, with a field of its
    archive row missing is suspect. Archives without an identifier take the file's name and page, never the title.
    """
    facts = {k: F.col(k) for k in ("page", "source", "guessed", "corrected", "off_roster", "text")} | {k: T.missing(F.col(k)) for k in ("id", "title")}
    order = ("page", "id", "title", "source", "guessed", "corrected", "off_roster", "text")
    each = pages.select(F.col("file").alias("_file"), F.col("page").alias("_page"), F.struct(*[facts[k].alias(k) for k in order]).alias("p"))
    inside = F.col("file").eqNullSafe(F.col("_file")) & F.col("_page").between(F.col("begin"), F.col("end"))
    met = segs.withColumnRenamed("id", "own").join(each, inside).drop("_file", "_page")
    rows = met.groupBy("file", "seg_no", "begin", "end", "own").agg(F.array_sort(F.collect_list("p")).alias("pages"))  # the pages of one document
    rows = rows.join(segs.groupBy(F.col("file").alias("_file")).agg(F.count(F.lit(1)).alias("n_segs")), F.col("file").eqNullSafe(F.col("_file")))
    rows = rows.withColumn("first", F.get(F.filter("pages", lambda p: p["id"].isNotNull() | p["title"].isNotNull()), 0))
    rows = rows.withColumns({"id": F.coalesce("own", "first.id"), "title": F.col("first.title")})

    def any_page(test) -> Column:
        return F.coalesce(F.exists("pages", lambda p: p["id"].eqNullSafe(F.col("id")) & F.coalesce(test(p), F.lit(False))), F.lit(False))

    rows = rows.withColumns({
        **{k: any_page(lambda p, k=k: p[k]) for k in ("guessed", "corrected", "off_roster")},
        "low_conf": F.col("id").isNotNull() & any_page(lambda p: p["source"] == "pool"),
        "debug": F.transform("pages", lambda p: F.coalesce(p["text"], F.lit(""))),
    })
    fallback = F.when(F.col("n_segs") == 1, F.col("file")).otherwise(F.concat(F.col("file"), F.lit("_p"), (F.col("begin") + 1).cast("string")))
    nameless = F.col("id").isNull() & F.coalesce(F.col("title").rlike("档案|记录"), F.lit(False))
    name = F.when(nameless, fallback).otherwise(T.make_name(mode, F.col("title"), F.col("id"), fallback, F.lit(template), F.col("file")))
    doubtful = F.col("guessed") | F.col("corrected") | F.col("off_roster") | F.col("low_conf") | F.col("id").isNull()
    subject = F.col("id").isNotNull() & ~F.coalesce(F.col("id").rlike("^(?i:No[.])"), F.lit(False))
    blank = F.when(~doubtful & subject, archive.incomplete(archive.fields(F.col("debug"), F.col("id")))).otherwise(F.lit(False))
    rows = rows.withColumns({
        "new_name": name, "suspect": doubtful | blank,
        "page_range": F.concat_ws("-", (F.col("begin") + 1).cast("string"), (F.col("end") + 1).cast("string")),
    })
    return rows.select("file", "seg_no", "title", "id", "new_name", "page_range", "guessed", "corrected", "off_roster", "low_conf", "suspect", "debug")


def split_output(outputs: DataFrame, cuts: DataFrame) -> DataFrame:
    """outputs, of which those named in cuts (out_seq, before) become two: pages before the cut, from 0, and the rest.

    The front keeps its identifier. The back has none, is suspect, and is named after the page where it begins. A cut
    outside the document says nothing. `part` is 0 for a whole or front, 1 for a back.
    """
    n = F.size("debug")
    rows = outputs.join(cuts.select(F.col("out_seq").alias("_seq"), "before").dropDuplicates(["_seq"]), F.col("out_seq") == F.col("_seq"), "left").drop("_seq")
    cut = F.coalesce((F.col("before") >= 1) & (F.col("before") < n), F.lit(False))
    rows = rows.withColumn("before", F.when(cut, F.col("before"))).withColumn("part", F.explode(F.when(cut, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    back, begin = F.col("part") == 1, F.regexp_extract("page_range", "^([0-9]+)-([0-9]+)$", 1).try_cast("int")
    begin = F.coalesce(begin, F.lit(1))
    span = F.when(back, F.concat_ws("-", (begin + F.col("before")).cast("string"), (begin + n - 1).cast("string"))).otherwise(
        F.concat_ws("-", begin.cast("string"), (begin + F.col("before") - 1).cast("string"))
    )
    named = F.concat(shown_name(), F.lit("_第"), (F.col("before") + 1).cast("string"), F.lit("页起"))
    changed = {
        "page_range": F.when(F.col("before").isNotNull(), span).otherwise(F.col("page_range")),
        "debug": F.when(back, F.slice("debug", F.col("before") + 1, n)).when(F.col("before").isNotNull(), F.slice("debug", F.lit(1), F.col("before"))).otherwise(F.col("debug")),
        "new_name": F.when(back, named).otherwise(F.col("new_name")),
        **{k: F.when(~back, F.col(k)) for k in ("title", "id", "custom_name")},
        **{k: F.when(back, F.lit(k == "suspect")).otherwise(F.col(k)) for k in ("guessed", "corrected", "off_roster", "low_conf", "suspect")},
    }
    return rows.withColumns(changed).drop("before")


def shown_name(custom: str = "custom_name", automatic: str = "new_name") -> Column:
    """The name typed by hand, else the automatic one."""
    return F.coalesce(T.missing(F.col(custom)), F.col(automatic))


def dedupe_names(outputs: DataFrame, name: str = "name", order: str = "out_seq") -> DataFrame:
    """outputs with final_name: the second and later ones of a name are numbered, by order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return outputs.withColumn("final_name", F.when(k > 1, F.concat_ws("_", name, k.cast("string"))).otherwise(F.col(name)))


def merge_documents(outputs: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """One row for each identifier, by its merge key; outputs without any, and those of apart (out_seq), as they are.

    outputs: out_seq, id, new_name, source, page_range, debug, guessed, corrected, off_roster, low_conf, suspect. A merged
    row has the place and identifier of its first output, which is its name as well; sources and pages are joined by +,
    texts follow on each other and flags are or-ed. Where Chinese and English outputs of a subject say different things,
    extra_note tells what, and the row is suspect. n is the number of outputs, merged_from their places.
    """
    named = outputs.withColumn("_key", T.merge_key(F.coalesce("id", F.lit(""))))
    if apart is not None:
        named = named.join(apart.select(F.col("out_seq").alias("_apart")).distinct(), F.col("out_seq") == F.col("_apart"), "left")
        named = named.withColumn("_key", F.when(F.col("_apart").isNotNull(), "").otherwise(F.col("_key")))
    alone = F.when(F.col("_key") == "", F.col("out_seq"))
    flags = ("guessed", "corrected", "off_roster", "low_conf", "suspect")
    fact = F.struct("out_seq", "id", "new_name", "source", "page_range", F.coalesce("debug", F.array().cast("array<string>")).alias("debug"))
    merged = named.groupBy("_key", alone.alias("_alone")).agg(
        F.array_sort(F.collect_list(fact)).alias("x"), *[F.bool_or(F.coalesce(k, F.lit(False))).alias(k) for k in flags]
    )
    merged = merged.withColumns({"_first": F.get("x", F.lit(0)), "n": F.size("x")})

    def side(chinese: bool) -> Column:
        pages = F.filter("x", lambda o: T.is_chinese(F.array_join(o["debug"], "")) if chinese else ~T.is_chinese(F.array_join(o["debug"], "")))
        return archive.fields(F.flatten(F.transform(pages, lambda o: o["debug"])), F.col("_first.id"))

    merged = merged.withColumns({"_zh": F.when(F.col("n") > 1, side(True)), "_en": F.when(F.col("n") > 1, side(False))})
    merged = merged.withColumn("extra_note", archive.language_check(F.col("_zh"), F.col("_en")))
    return merged.select(
        F.col("_first.out_seq").alias("out_seq"), F.col("_first.id").alias("id"),
        F.when(F.col("n") > 1, F.col("_first.id")).otherwise(F.col("_first.new_name")).alias("new_name"),
        F.array_join(F.transform("x", lambda o: o["source"]), " + ").alias("source"),
        F.array_join(F.transform("x", lambda o: o["page_range"]), " + ").alias("page_range"),
        F.flatten(F.transform("x", lambda o: o["debug"])).alias("debug"), *flags[:-1],
        (F.col("suspect") | F.col("extra_note").isNotNull()).alias("suspect"), "extra_note", "n", F.transform("x", lambda o: o["out_seq"]).alias("merged_from"),
    )


def suspects_first(outputs: DataFrame, order: str = "out_seq") -> DataFrame:
    """outputs with place, from 1: suspect ones first, otherwise by order, a number. A null suspect is none; null order is last.

    The order is cut into ranges. Rows are numbered within their range, and what the ranges before it hold is added.
    """
    ranges = int(outputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = outputs.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<double>")
    before = F.size(F.filter(cuts, lambda b: b < F.col(order).cast("double")))
    late = ~F.coalesce("suspect", F.lit(False))
    rows = outputs.withColumns({"_late": late, "_range": F.when(F.col(order).isNull(), F.lit(ranges)).otherwise(before)})
    sizes = rows.groupBy("_late", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_late", "_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.withColumn("_begin", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    k = F.row_number().over(Window.partitionBy("_late", "_range").orderBy(order))
    numbered = rows.withColumn("_k", k).join(F.broadcast(sizes), ["_late", "_range"])
    return numbered.withColumn("place", F.col("_begin") + F.col("_k")).drop("_late", "_range", "_begin", "_k")


def only_suspects(outputs: DataFrame, wanted: bool = True) -> DataFrame:
    return outputs.filter(F.coalesce("suspect", F.lit(False))) if wanted else outputs


def summary(outputs: DataFrame) -> DataFrame:
    """One row: total, animals, unidentified, docs, suspects. outputs: id, suspect. An empty identifier is none."""
    identifier = T.missing(F.col("id"))
    document = F.coalesce(identifier.rlike("^(?i:No[.])"), F.lit(False))
    return outputs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(identifier.isNotNull() & ~document).alias("animals"),
        F.count_if(identifier.isNull()).alias("unidentified"),
        F.count_if(document).alias("docs"),
        F.count_if("suspect").alias("suspects"),
    )


def progress(items: DataFrame) -> DataFrame:
    """One row: pending, failed, roster_size (the largest). items: status, roster_size, error; one row a file."""
    return items.agg(
        F.count_if(~F.col("status").eqNullSafe("done")).alias("pending"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.max("roster_size"), F.lit(0)).alias("roster_size"),
    )
