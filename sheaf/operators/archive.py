"""The row of the archive table for one subject, mined from the texts of its pages.

A document's pages are an array of texts in one row. What stands near the subject's identifier goes before what a label
names. Empty matches count as missing; only the final row has empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import text as T

_S = f"[{T.SPACE}]"

# Patterns of fields and of the lines that a search passes over.
DATE = r"(?<![0-9-])([0-9]{1,2}-[0-9]{1,2}-[0-9]{2})"
SHIPPED = rf"(?i)发货|Ship{_S}*Date"
ANY_DATE = "([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4})"
DATE_LINE, SEX_LINE = rf"^{_S}*\[?{ANY_DATE}{_S}*\z", rf"(?i)^{_S}*([MF♂♀公母早]){_S}*\z"
TOKEN_LINE = rf"(?i)^{_S}*\[?((?=[A-Z0-9]*[0-9])[A-Z0-9]{{5,12}}){_S}*\z"
TOKEN = "((?=[A-Z0-9]*[0-9])[A-Z0-9]{5,12})"
BIRTH_LABEL = rf"(?i)Birth{_S}*Date|出生{_S}*日期|Date{_S}*of{_S}*Birth"
SIRE_LABEL = rf"(?i)Father{_S}*No|父{_S}*号|父亲{_S}*编号|ID{_S}*of{_S}*the{_S}*father"
DAM_LABEL = rf"(?i)Mother{_S}*No|母{_S}*号|母亲{_S}*编号|ID{_S}*of{_S}*the{_S}*Mother"
SEX_LABEL = rf"(?i)Sex{_S}*性别|性别{_S}*(?:/{_S}*(?:Sex|Gender))?|(?<![A-Za-z])Sex(?![A-Za-z])|(?<![A-Za-z])Gender(?![A-Za-z])"
WEIGHT_LABEL, WEIGHT_LINE = "(?i)体重|weight", rf"^{_S}*\[?([0-9]+(?:\.[0-9]+)?){_S}*\z"
WEIGHT_INLINE = rf"(?:体重|weight){_S}*[,，:：]?{_S}*(?:kg|公斤|公厅)?{_S}*\[?([0-9]+(?:\.[0-9]+)?)(?![0-9.-])"
WEIGHT_SKIP, FRAGMENT = "(?i)日期|Date|Birth|编号|ID|性别|Sex|Gender|体重|weight", rf"^[A-Za-z{T.SPACE}]{{1,20}}\z"
FIELDS = ("sex", "birth", "sire", "dam", "weight")
MISSING = {"sex": "性别未识别", "birth": "出生日期未识别", "sire": "父亲编号未识别", "dam": "母亲编号未识别", "weight": "体重未识别"}
NAMES = {"sex": "性别", "birth": "出生日期", "sire": "父亲编号", "dam": "母亲编号", "weight": "最新体重"}


def _match(c: Column, pattern: str, group: int = 1) -> Column:
    return T.missing(F.regexp_extract(c, pattern, group))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is found once however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def near_date(scope: Column, anchored: bool, identifier: Column) -> Column:
    """birth, sire, dam, score, scope around the first date of a text; NULL if there is none.

    Numbers of 6 to 8 digits after the date are sire and dam; one of 12 to 17 digits is both, halved after a misread
    first digit. The identifier itself is passed over.
    """
    at = F.regexp_instr(scope, F.lit(DATE))
    birth = _match(scope, DATE)
    after = F.substr(scope, at + F.length(birth), F.lit(160))

    def numbers(rest: Column) -> Column:
        first = F.regexp_extract(rest, "^[^0-9]*([0-9]+)", 1)
        again = F.regexp_replace(rest, "^[^0-9]*[0-9]+", "")
        own = (first != "") & first.eqNullSafe(identifier)
        run = F.when(own, F.regexp_extract(again, "^[^0-9]*([0-9]+)", 1)).otherwise(first)
        left = F.when(own, F.regexp_replace(again, "^[^0-9]*[0-9]+", "")).otherwise(again)
        return F.struct(run.alias("run"), F.length(run).alias("n"), _match(left, "^[^0-9]*([0-9]{6,8})(?![0-9])").alias("next"))

    def parents(x: Column) -> Column:
        single, double = x["n"].between(6, 8), x["n"].between(12, 17)
        drop = F.when(x["n"] == 17, 1).otherwise(0)
        half = F.floor((x["n"] - drop) / 2).cast("int")
        dam = F.when(~x["next"].eqNullSafe(identifier), x["next"])
        return F.struct(
            F.when(single, x["run"]).when(double, F.substr(x["run"], drop + 1, half)).alias("sire"),
            F.when(single, dam).when(double, F.substr(x["run"], drop + 1 + half)).alias("dam"),
            F.when(single, F.when(dam.isNotNull(), 4).otherwise(2)).when(double, 2 - drop).otherwise(0).alias("quality"),
        )

    def rated(p: Column) -> Column:
        score = 1 + F.when(p["sire"].isNotNull(), 2).otherwise(0) + F.when(p["dam"].isNotNull(), 2).otherwise(0) + p["quality"] + int(anchored)
        return F.struct(birth.alias("birth"), p["sire"].alias("sire"), p["dam"].alias("dam"), score.alias("score"), scope.alias("scope"))

    return F.when(at > 0, _bound(numbers(after), lambda x: _bound(parents(x), rated)))


def best_window(pages: Column, identifier: Column) -> Column:
    """The most complete near_date of all windows of eight lines that begin with the identifier, and of whole pages."""

    def of_page(page: Column) -> Column:
        def windows(lines: Column) -> Column:
            def window(line: Column, i: Column) -> Column:
                text = F.get(F.split(F.array_join(F.slice(lines, i + 1, 8), " "), SHIPPED, 2), 0)
                return F.when(F.contains(line, identifier), _bound(text, lambda t: near_date(t, True, identifier)))

            return F.concat(F.transform(lines, window), F.array(near_date(page, False, identifier)))

        return _bound(F.split(page, "\n"), windows)

    every = F.filter(F.flatten(F.transform(pages, of_page)), lambda x: x.isNotNull())
    kind = "struct<birth:string,sire:string,dam:string,score:int,scope:string>"
    return F.reduce(every, F.lit(None).cast(kind), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x.cast(kind)).otherwise(a))


def next_match(lines: Column, i: Column, pattern: str, skip: Callable[[Column], Column], of: Callable[[Column, int], Column]) -> Column:
    """of(value, distance) of the first of the three lines after line i that matches, unless another one with content comes first."""
    out = F.lit(None)
    for k in (3, 2, 1):
        line = F.get(lines, i + k)
        v = _match(line, pattern)
        t = T.trimmed(line)
        passed = (t == "") | t.rlike(FRAGMENT) | skip(t)
        out = F.when(v.isNotNull(), of(v, k)).when(passed, out)
    return out


def _never(t: Column) -> Column:
    return F.lit(False)


def by_label(lines: Column, label: str, inline: str, whole: str, embedded: bool) -> Column:
    """The first value that a label names: after it on its line, alone on one of the next lines, or within the next line."""

    def at(line: Column, i: Column) -> Column:
        after = F.regexp_extract(line, f"(?s)^.*?(?:{label})(.*)\\z", 1)
        ways = [_match(after, inline), next_match(lines, i, whole, _never, lambda v, _: v)]
        if embedded:
            ways.append(_match(F.get(lines, i + 1), TOKEN))
        return F.when(line.rlike(label), F.coalesce(*ways))

    return F.get(F.filter(F.transform(lines, at), lambda v: v.isNotNull()), 0)


def sex(scope: Column, text: Column) -> Column:
    """M or F by itself near the identifier, on a line, before a date, or after the label."""
    return F.coalesce(
        _match(scope, "(?<![A-Za-z0-9_])([MF])(?![A-Za-z0-9_])"),
        _match(text, rf"(?m)^{_S}*([MF]){_S}*$"),
        _match(text, "(?<![A-Za-z])([MF])(?=[0-9]{1,2}-[0-9]{1,2}-[0-9]{2})"),
        _match(text, "性别[^MF]{0,10}([MF])"),
    )


def labelled_sex(lines: Column) -> Column:
    raw = by_label(lines, SEX_LABEL, "(?i)([MF♂♀公母早])", SEX_LINE, False)
    return F.when(raw.isNotNull(), F.when(raw.rlike("^(?i:M|♂|公)$"), "M").otherwise("F"))


def weight(text: Column, lines: Column) -> Column:
    """The last weight in the order of the text: beside its label, or alone on one of the lines after it."""
    last = f"(?is)^(.*){WEIGHT_INLINE}"
    inline = F.when(text.rlike(last), F.struct(F.length(F.regexp_extract(text, last, 1)).alias("at"), F.regexp_extract(text, last, 2).alias("v")))

    def start(k: Column) -> Column:
        return F.length(F.array_join(F.slice(lines, 1, k), "\n")) + 1

    def below(line: Column, i: Column) -> Column:
        found = next_match(
            lines, i, WEIGHT_LINE, lambda t: t.rlike(WEIGHT_SKIP), lambda v, k: F.struct(start(i + k).alias("at"), v.alias("v"))
        )
        return F.when(line.rlike(WEIGHT_LABEL), found)

    every = F.filter(F.concat(F.array(inline), F.transform(lines, below)), lambda x: x.isNotNull())
    return F.array_max(every)["v"]


def fields(pages: Column, identifier: Column) -> Column:
    """Struct of sex, birth, sire, dam, weight from the texts of pages, NULL where nothing is found."""
    pages = F.coalesce(pages, F.array().cast("array<string>"))

    def of_text(text: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            def of_window(x: Column) -> Column:
                values = {
                    "sex": F.coalesce(sex(x["scope"], text), labelled_sex(lines)),
                    "birth": F.coalesce(x["birth"], by_label(lines, BIRTH_LABEL, ANY_DATE, DATE_LINE, False)),
                    "sire": F.coalesce(x["sire"], by_label(lines, SIRE_LABEL, TOKEN, TOKEN_LINE, True)),
                    "dam": F.coalesce(x["dam"], by_label(lines, DAM_LABEL, TOKEN, TOKEN_LINE, True)),
                    "weight": weight(text, lines),
                }
                return F.struct(*[v.alias(k) for k, v in values.items()])

            return _bound(best_window(pages, identifier), of_window)

        return _bound(F.split(text, "\n"), of_lines)

    return _bound(F.array_join(pages, "\n", ""), of_text)


def incomplete(found: Column) -> Column:
    """Whether one of the five fields is missing."""
    out = F.lit(False)
    for k in FIELDS:
        out = out | found[k].isNull()
    return out


def note(found: Column, guessed: Column, corrected: Column, off_roster: Column, merged: Column, extra: Column) -> Column:
    """Remarks for the row, joined by ；: how the identifier was come by, what was merged, what is missing."""
    return F.concat_ws(
        "；",
        F.when(guessed, "编号为顺序推定"), F.when(corrected, "编号经花名册纠错"), F.when(off_roster, "编号不在花名册（名册页可能漏读）"),
        F.when(merged > 0, F.concat(F.lit("合并"), merged.cast("string"), F.lit("个来源"))), T.missing(extra),
        *[F.when(found[k].isNull(), text) for k, text in MISSING.items()],
    )


def archive_row(pages: Column, identifier: Column, source: Column, page_range: Column, remarks: Callable[[Column], Column]) -> Column:
    """The row as a struct of nine texts; remarks makes the note of the fields that were found."""

    def row(found: Column) -> Column:
        values = [("animal_id", identifier), *[(k, found[k]) for k in FIELDS], ("source", source), ("pages", page_range), ("note", remarks(found))]
        return F.struct(*[F.coalesce(v, F.lit("")).alias(k) for k, v in values])

    return _bound(fields(pages, identifier), row)


def language_check(chinese: Column, english: Column) -> Column:
    """What the Chinese and the English pages of a subject say differently; NULL if nothing does. Both are `fields`."""
    same = {
        "sex": lambda v: v, "birth": T.normal_date, "sire": lambda v: F.regexp_replace(v, "[^0-9]", ""),
        "dam": lambda v: F.regexp_replace(v, "[^0-9]", ""), "weight": lambda v: v.try_cast("double"),
    }
    found = []
    for k, name in NAMES.items():
        a, b = chinese[k], english[k]
        told = F.concat(F.lit(f"{name}中"), a, F.lit("/英"), b)
        found.append(F.when(a.isNotNull() & b.isNotNull() & (same[k](a) != same[k](b)), told))
    joined = T.missing(F.concat_ws("；", *found))
    return F.concat(F.lit("中英字段不一致："), joined)
