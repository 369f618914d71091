"""Everything that a page says about its subject: title, kind, identifier and where that was found, further identifiers.

A page is one row with an array of lines, so all of this is a chain of projections; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import layout, pages

_S = f"[{T.SPACE}]"

# Labels of identifiers in the order in which they are believed, by species.
EAR, TATTOO, ANIMAL = rf"耳标?{_S}*号", rf"纹身{_S}*号?", rf"动物{_S}*编号"
FIRST_MONKEY, MONKEY, MONKEY_NO = rf"原猴{_S}*号?", rf"猴{_S}*号", rf"(?i)Monkey'?s?{_S}*(?:No|ID)\.?"
TATTOO_EN, EAR_EN, CHIP = "(?i)TATT[O0]{2}", rf"(?i)Ear{_S}?Tag", rf"芯片{_S}*号(?:码)?"
LABELS = {
    "pig": (EAR, TATTOO, ANIMAL),
    "monkey": (FIRST_MONKEY, MONKEY, MONKEY_NO, ANIMAL, EAR, TATTOO),
    "dog": (TATTOO_EN, EAR_EN, rf"(?i)Chip{_S}?(?:No|ID|Number)\.?", EAR, CHIP, rf"犬{_S}*号", ANIMAL),
    "generic": (ANIMAL, FIRST_MONKEY, MONKEY, MONKEY_NO, TATTOO_EN, EAR_EN, EAR, TATTOO, CHIP),
}
#: Labels of documents; a bare No. goes before the general word for number, which must not be that of another thing.
DOCUMENT_LABELS = (
    rf"合格证{_S}*编号", rf"(?i)Certificate{_S}*No\.?", rf"检疫{_S}*(?:合格{_S}*)?证?{_S}*编号", rf"报告{_S}*编号", rf"(?i)Report{_S}*No\.?",
    rf"流水{_S}*号", rf"发票{_S}*号(?:码)?", rf"(?i)Invoice{_S}*No\.?", rf"(?i)(?:^|[{T.SPACE}(（])(?:No|№){_S}*[:.：]?{_S}*(?=[A-Z0-9]{{5,}})",
    rf"(?i)^{_S}*(?:No|№){_S}*[.:：]?{_S}*\z", "(?<!合格证)(?<!母亲)(?<!父亲)(?<!动物)(?<!许可证)编号",
)
SERIAL = rf"序{_S}*号"
FORM_WORDS, CERTIFICATE_WORDS, ARCHIVE = "记录|单据|发货|接收|清单|凭证|发票|申购|订购|申请|装箱", "报告|证明|合格证|检疫", "档案"
LONG_NUMBER, MOBILE = rf"^(?:(?:N[oO]?|№){_S}*[:.：]?{_S}*)?([0-9]{{8,20}})\z", r"^1[3-9][0-9]{9}\z"

_NONE = "array<string>"


def _texts(lines: Column) -> Column:
    return F.transform(lines, lambda l: l["text"])


def _found(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def labels_of(species: Column, more: tuple[str, ...] = ()) -> tuple[tuple[str, ...], Column]:
    """All patterns of labels, and the places among them of those of a species, as an array."""
    every = tuple(dict.fromkeys((*[p for v in LABELS.values() for p in v], *more)))
    lists = {k: F.array(*[F.lit(every.index(p)) for p in (*v, *more)]) for k, v in LABELS.items()}
    return every, F.when(species == "pig", lists["pig"]).when(species == "monkey", lists["monkey"]).when(species == "dog", lists["dog"]).otherwise(lists["generic"])


def label_values(lines: Column, labels: tuple[tuple[str, ...], Column | None], looks: tuple[Callable[[Column, Column], Column], ...]) -> Column:
    """Identifiers beside labels, label by label, then line by line: on the line itself, else where `looks` find one.

    labels: patterns, and the places of those that count in their order, or None for all as they are. Patterns are constants,
    so each is compiled once; what `looks` find doesn't depend on the label, so they look once for a line that has any.
    """
    patterns, chosen = labels
    some = "|".join(f"(?:{p})" for p in patterns)
    named = F.transform(
        F.filter(lines, lambda l: l["text"].rlike(some)),
        lambda l: F.struct(l["text"].alias("text"), F.coalesce(*[look(lines, l) for look in looks]).alias("beside")),
    )

    def at(label: str) -> Callable[[Column], Column]:
        return lambda l: F.when(l["text"].rlike(label), F.coalesce(T.value_after(l["text"], label), l["beside"]))

    def of(named: Column) -> Column:
        each = F.array(*[F.transform(named, at(p)) for p in patterns])
        if chosen is not None:
            each = T.bound(each, lambda e: F.transform(chosen, lambda k: F.get(e, k)))
        return F.when(F.size(named) > 0, _found(F.flatten(each))).otherwise(F.array().cast(_NONE))

    return F.when(lines.isNotNull(), T.bound(named, of))


def pooled(lines: Column, page_height: Column) -> Column:
    """The likeliest identifier without a label in the upper half of a page, the first of equal ones."""

    def rated(line: Column) -> Column:
        t = line["text"]
        begun = F.when(t.rlike(f"^{T.TOKEN}"), F.regexp_extract(t, f"^{T.TOKEN}", 0))
        y = layout.middle(line) / page_height
        found = T.first_token(F.when(T.has_cjk(t), begun).otherwise(t))
        return F.when(y <= 0.5, T.bound(found, lambda v: likely(line, v, y)))

    def likely(line: Column, v: Column, y: Column) -> Column:
        n = F.length(v)
        letter = v.rlike("[A-Za-z]")
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        fits = (n <= 14) & F.when(letter, digits * 2 >= n).otherwise((n >= 5) & (n <= 8))
        score = (
            F.when(letter, 2).otherwise(0)
            + F.when(layout.has_left_label(lines, line), 2).otherwise(0)
            + F.when(y < 0.2, 1).otherwise(0)
            - F.when(v.rlike("20[0-9]{2}(?:0[1-9]|1[0-2])"), 2).otherwise(0)
        )
        return F.when(fits, F.struct(score.alias("score"), (-line["line_no"]).alias("before"), v.alias("v")))

    return F.array_max(_found(F.transform(lines, rated)))["v"]


def certificate_number(lines: Column, page_height: Column) -> Column:
    """The first long number that fills two lines or more, at least one at the very top, and isn't a telephone's."""

    def number(line: Column) -> Column:
        v = F.regexp_extract(T.trimmed(line["text"]), LONG_NUMBER, 1)
        return F.when((v != "") & ~v.rlike(MOBILE), F.struct(v.alias("v"), (layout.middle(line) / page_height < 0.08).alias("top")))

    def chosen(numbers: Column) -> Column:
        twice = F.filter(
            F.array_distinct(F.transform(numbers, lambda x: x["v"])),
            lambda v: (F.size(F.filter(numbers, lambda x: x["v"] == v)) >= 2) & F.exists(numbers, lambda x: (x["v"] == v) & x["top"]),
        )
        return F.get(twice, 0)

    return F.get(F.transform(F.array(_found(F.transform(lines, number))), chosen), 0)


def page_info(rows: DataFrame, file_name: str | None = None) -> DataFrame:
    """rows with title, species, animal_id, id_source, id_evidence, id_alts, id_candidates, list_page.

    rows: lines (line_no, text, bbox and, if there are, alts: other readings of the line) and page_height. An identifier is
    that beside a label; else that of the file's name, if the column is given; else the likeliest one without a label; else the
    number of a document, after No. Pages that list many subjects, or whose label heads a column, have no identifier of a
    subject. id_source is label, filename, pool or fallback. A page without lines has neither title nor identifier.
    """
    lines, height = F.col("lines"), F.col("page_height")
    has_alts = "alts" in rows.schema["lines"].dataType.elementType.fieldNames()
    alts = F.flatten(F.transform(lines, lambda l: F.coalesce(l["alts"], F.array().cast(_NONE)))) if has_alts else F.array().cast(_NONE)
    texts = _texts(lines)
    upper = F.array_join(_texts(F.filter(lines, lambda l: layout.middle(l) / height < 0.5)), "")
    beside = (layout.right_cell, layout.below_cell)

    df = rows.withColumns({"_best": pages.title_line(lines, height), "species": pages.species(upper), "id_candidates": pages.candidates(F.concat(texts, alts))})
    df = df.withColumns({
        "title": pages.title(lines, height, F.col("_best")),
        "_cluster": pages.largest_cluster(F.col("id_candidates")),
        "_repeats": pages.repeated_skeletons(texts),
        "_labelled": F.get(label_values(lines, labels_of(F.col("species")), beside), 0),
    })
    df = df.withColumns({"_seen": pages.evidence(texts, F.col("_labelled")), "_flat": F.regexp_replace("title", f"{_S}+", "")})
    labelled = F.col("_labelled").isNotNull()
    df = df.withColumn("list_page", pages.is_list(F.col("_cluster"), F.col("_repeats"), labelled & (F.col("_seen") >= 2)))
    heads = pages.is_column_header(F.col("list_page"), labelled, F.col("_cluster"), F.col("_seen"))
    archive = F.coalesce(F.contains(F.col("_flat"), F.lit(ARCHIVE)), F.lit(False))
    form, certificate = (F.coalesce(F.col("_flat").rlike(p), F.lit(False)) & ~archive for p in (FORM_WORDS, CERTIFICATE_WORDS))
    df = df.withColumns({
        "_none": F.col("list_page") | heads, "_form": form, "_certificate": certificate,
        "_archive": F.coalesce(F.col("_flat").rlike(f"{ARCHIVE}|记录"), F.lit(False)),
    })
    df = df.withColumn("_own", F.when(~F.col("_none"), F.coalesce("_labelled", T.id_from_file_name(F.col(file_name)) if file_name else F.lit(None).cast("string"))))
    df = df.withColumn("_pool", F.when(F.col("_own").isNull() & ~F.col("_none") & ~F.col("_form") & ~F.col("_certificate"), pooled(lines, height)))
    open_ = F.col("_own").isNull() & F.col("_pool").isNull()
    numbers = label_values(lines, (DOCUMENT_LABELS, None), (*beside, layout.below_lines))
    df = df.withColumn("_number", F.when(open_ & ~F.col("_archive") & ~F.col("_form"), F.get(numbers, 0)))
    bare = F.when(open_ & F.col("_number").isNull() & F.col("_certificate"), certificate_number(lines, height))
    df = df.withColumn("_number", F.coalesce("_number", bare))
    df = df.withColumns({
        "animal_id": F.coalesce("_own", "_pool", F.concat(F.lit("No."), F.col("_number"))),
        "id_source": F.when(F.col("_own").isNotNull(), F.when(labelled, "label").otherwise("filename"))
        .when(F.col("_pool").isNotNull(), "pool").when(F.col("_number").isNotNull(), "fallback"),
    })
    others = F.array_distinct(label_values(lines, labels_of(F.col("species"), (SERIAL,)), beside))
    others = F.filter(others, lambda v: ~v.eqNullSafe(F.col("animal_id")))
    df = df.withColumns({
        "id_evidence": pages.evidence(texts, F.col("animal_id")),
        "id_alts": F.when(F.col("list_page"), F.array().cast(_NONE)).otherwise(others),
    })
    added = ["title", "species", "animal_id", "id_source", "id_evidence", "id_alts", "id_candidates", "list_page"]
    return df.select(*[F.col(f"`{c}`") for c in rows.columns if c not in added], *added)
