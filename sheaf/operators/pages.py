"""Facts of a page from its positioned lines: title, candidates for identifiers, signs of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import layout

# Weights of a title's score.
_PLAIN = rf"0-9{T.SPACE}.,:;()#/&'\"_-"
TOP, LEFT, KEYWORD, ENGLISH, FIELD, DATED, LONG = 1.5, 0.3, 2.5, 0.45, 0.35, 0.6, 0.6


def title_score(line: Column, page_height: Column, top: Column, width: Column) -> Column:
    """How much a line looks like the title; NULL if it can't be one. top and width are those of the page's lines."""
    y = layout.middle(line) / page_height
    facts = F.struct(T.trimmed(line["text"]).alias("t"), y.alias("y"))

    def of(found: Column) -> Column:
        cjk = T.has_cjk(found["t"])
        kinds = F.struct((cjk & found["t"].rlike(T.TITLE_WORDS)).alias("keyword"), (~cjk).alias("english"))
        score = T.bound(kinds, lambda k: _score(line, found["t"], found["y"], k["keyword"], k["english"], top, width))
        return T.bound(score, lambda s: F.when(s > 0, s))

    return F.when((F.length(line["text"]) >= 2) & (y <= 0.6), T.bound(facts, of))


def _score(line: Column, t: Column, y: Column, keyword: Column, english: Column, top: Column, width: Column) -> Column:
    """The score of a line that is high enough on its page, from its trimmed text, place and kind."""
    text, box = line["text"], line["bbox"]
    fragment = english & (t.rlike("^[a-z]") | (t.rlike("[a-z]") & t.rlike(r"\.\z")))
    no_title = (
        F.contains(t, F.lit("#"))
        | (~keyword & ((F.length(t) < 4) | fragment))
        | (~english & text.rlike("专用章|公章|印章"))
        | t.rlike(rf"^(?i:Page[{T.SPACE}]+[0-9]+(?![A-Za-z0-9_])|第[{T.SPACE}]*[0-9]+[{T.SPACE}]*页)")
        | ~t.rlike(rf"[^{_PLAIN}][{_PLAIN}]*[^{_PLAIN}]")
    )

    def factor(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(1.0))

    score = (
        layout.height(line)
        * (1.5 - y)
        * factor(box["y0"] <= top + 20, TOP)
        * (1 + LEFT * (1 - (box["x0"] + box["x1"]) / 2 / width))
        * factor(keyword, KEYWORD)
        * factor(english, ENGLISH)
        * factor(text.rlike("[:：]"), FIELD)
        * factor(text.rlike("(?:19|20)[0-9]{2}[-年/.]") & ~keyword, DATED)
        * factor(F.length(text) > 40, LONG)
    )
    return F.when(~no_title, score)


def title_line(lines: Column, page_height: Column) -> Column:
    """Struct of score and line_no of the best line, the first of equal ones; NULL if no line can be a title."""
    extent = F.struct(F.array_min(F.transform(lines, lambda l: l["bbox"]["y0"])).alias("top"), F.array_max(F.transform(lines, lambda l: l["bbox"]["x1"])).alias("width"))

    def best_of(page: Column) -> Column:
        scored = F.transform(lines, lambda l: F.struct(title_score(l, page_height, page["top"], page["width"]).alias("score"), l["line_no"].alias("line_no")))
        return F.reduce(
            F.filter(scored, lambda s: s["score"].isNotNull()),
            F.lit(None).cast("struct<score:double,line_no:int>"),
            lambda a, s: F.when((s["score"] > a["score"]) | a.isNull(), F.struct(s["score"].cast("double").alias("score"), s["line_no"].cast("int").alias("line_no"))).otherwise(a),
        )

    return F.get(F.transform(F.array(extent), best_of), 0)  # bound by the lambda, so that it is found once a page


def title_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, line_no of each page's title_line, from rows (keys, lines, page_height) of any number of lines.

    Lines are rows here, so that their score is compiled; pages without a title have no row.
    """
    top, width = F.array_min(F.transform("lines", lambda l: l["bbox"]["y0"])), F.array_max(F.transform("lines", lambda l: l["bbox"]["x1"]))
    each = rows.select(*keys, "page_height", top.alias("top"), width.alias("width"), F.explode("lines").alias("l"))
    y = layout.middle(F.col("l")) / F.col("page_height")
    each = each.filter((F.length("l.text") >= 2) & (y <= 0.6)).withColumns({"y": y, "t": T.trimmed(F.col("l.text"))})
    each = each.withColumn("english", ~T.has_cjk(F.col("t"))).withColumn("keyword", ~F.col("english") & F.col("t").rlike(T.TITLE_WORDS))
    score = _score(F.col("l"), *[F.col(c) for c in ("t", "y", "keyword", "english", "top", "width")])
    scored = each.select(*keys, F.struct(score.cast("double").alias("score"), (-F.col("l.line_no")).alias("before")).alias("s"))
    best = scored.groupBy(*keys).agg(F.max(F.when(F.col("s.score") > 0, F.col("s"))).alias("s")).filter("s is not null")
    return best.select(*keys, "s.score", (-F.col("s.before")).cast("int").alias("line_no"))


def title(lines: Column, page_height: Column, best: Column | None = None) -> Column:
    """The title: the best line with Chinese lines of like size that follow on it below, then above. best: its title_line."""
    best = title_line(lines, page_height) if best is None else best
    chosen = F.get(F.filter(lines, lambda l: l["line_no"] == best["line_no"]), 0)
    size = layout.height(chosen)

    def grown(near: Column, edge: Column, gap, next_edge, joined) -> Column:
        start = F.struct(F.lit("").alias("text"), edge.cast("double").alias("edge"), F.lit(False).alias("over"))

        def step(state: Column, l: Column) -> Column:
            d = gap(l, state["edge"])
            fits = ~state["over"] & (layout.height(l) >= size * 0.7) & (d >= 0) & (d < size * 1.5) & ~T.is_field_or_english(l["text"])
            return F.struct(
                F.when(fits, joined(state["text"], l["text"])).otherwise(state["text"]).alias("text"),
                F.when(fits, next_edge(l).cast("double")).otherwise(state["edge"]).alias("edge"),
                (~fits).alias("over"),
            )

        return F.aggregate(near, start, step, lambda s: s["text"])

    def by(key) -> Column:
        return lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(a["line_no"] - b["line_no"]).cast("int")

    below = F.array_sort(F.filter(lines, lambda l: l["bbox"]["y0"] > chosen["bbox"]["y0"]), by(lambda l: l["bbox"]["y0"]))
    above = F.array_sort(F.filter(lines, lambda l: l["bbox"]["y1"] < chosen["bbox"]["y0"]), by(lambda l: -l["bbox"]["y1"]))
    after = grown(below, chosen["bbox"]["y1"], lambda l, e: l["bbox"]["y0"] - e, lambda l: l["bbox"]["y1"], lambda s, t: F.concat(s, t))
    before = grown(above, chosen["bbox"]["y0"], lambda l, e: e - l["bbox"]["y1"], lambda l: l["bbox"]["y0"], lambda s, t: F.concat(t, s))
    whole = T.clean_title(F.concat(before, chosen["text"], after))
    return F.when(best.isNotNull() & (whole.rlike(T.TITLE_WORDS) | (F.length(whole) >= 4)), whole)


def candidates(texts: Column) -> Column:
    """The first identifier of each text, distinct and in order."""
    found = F.transform(texts, lambda t: T.first_token(t, True))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull()))


def largest_cluster(ids: Column) -> Column:
    """Size of the largest set of distinct identifiers of one shape."""
    distinct = F.array_distinct(F.transform(ids, F.upper))
    shapes = F.filter(F.transform(distinct, T.shape_key), lambda s: s.isNotNull())
    return most_repeated(shapes)


def most_repeated(values: Column) -> Column:
    def counted(values: Column) -> Column:
        counts = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)))
        return F.coalesce(F.array_max(counts), F.lit(0))

    return T.bound(values, counted)


def repeated_skeletons(texts: Column) -> Column:
    numbered = F.filter(texts, lambda t: t.rlike("[0-9#]"))  # other lines have no # in their structure
    found = F.filter(F.transform(numbered, T.skeleton), lambda s: (F.length(s) >= 4) & F.contains(s, F.lit("#")))
    return most_repeated(found)


def evidence(texts: Column, identifier: Column) -> Column:
    """Lines that hold an identifier, without its prefix for certificates."""
    bare = T.missing(F.regexp_replace(identifier, r"^(?i)No\.", ""))
    return T.bound(bare, lambda v: F.when(v.isNull(), F.lit(0)).otherwise(F.size(F.filter(texts, lambda t: F.contains(t, v)))))


def is_list(cluster: Column, skeletons: Column, proved: Column) -> Column:
    """Whether a page lists many subjects: many identifiers of one shape, or some among lines of one structure."""
    return ~proved & ((cluster >= 5) | ((cluster >= 3) & (skeletons >= 5)))


def is_column_header(listed: Column, labelled: Column, cluster: Column, seen: Column) -> Column:
    """Whether a label heads a column, so that the value under it is one of many."""
    return ~listed & labelled & (cluster >= 4) & (seen <= 1)


def species(top_text: Column) -> Column:
    return (
        F.when(top_text.rlike("(?i)猴|Monkey|Cyno|Macaque"), "monkey")
        .when(top_text.rlike("(?i)猪|巴马|Pig|Swine"), "pig")
        .when(top_text.rlike("(?i)犬|比格|Beagle|Dog"), "dog")
    )
