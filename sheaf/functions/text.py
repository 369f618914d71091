"""Column functions on recognised text: titles, identifiers, names and dates.

Text is NULL where something is missing; an empty match of an expression counts as missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
CJK = "[一-鿿]"
DOCUMENT_WORDS = "档案|记录|合格证|报告|发票|证明|通知|登记|协议|合同|清单|收据|凭证|申购|订购|申请"
TITLE_WORDS = DOCUMENT_WORDS + "|发货"
TITLE_KINDS = "合格证|发票|收据|报告|证明"
TAG_WORDS = "SEX|GENDER|AGE|DATE|YEAR|MONTH|MALE|FEMALE|TAG"
LABEL_WORDS = r"Animal|Number|Ear|Tag|Tattoo|Certificate|Quality|No\.?|ID|Code|of|编号|号码"
TOKEN = "[A-Z0-9][-A-Z0-9]{2,29}"
ILLEGAL = r'[\\/:*?"<>|]'
SPACE = r"\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def missing(c: Column) -> Column:
    """NULL for an empty text."""
    return F.nullif(c, F.lit(""))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is found once, however often f names it: lambdas aren't compiled, so each mention counts."""
    return F.get(F.transform(F.array(c), f), 0)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def clean_title(c: Column) -> Column:
    """A title without characters that file names can't hold and without closing punctuation; 60 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(c, ILLEGAL, ""), r"[。．.，,;；:：!！?？~～\-—_]+\z", "")
    return F.substring(trimmed(plain), 1, 60)


def is_field_or_english(c: Column) -> Column:
    return c.rlike("[:：]") | ~has_cjk(c)


def strip_label(c: Column) -> Column:
    """What follows the English counterpart of a label."""
    rest = F.regexp_replace(c, rf"^[/:：{SPACE}]*", "")
    return F.regexp_replace(rest, rf"^(?i:(?:{LABEL_WORDS})[/:：{SPACE}]*)+", "")


def clean_token(raw: Column) -> Column:
    """An identifier without a date or sex mark that sticks to its end; NULL for dates, ranges, words and fragments."""
    date = "[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}"

    def cut(raw: Column) -> Column:
        before = F.regexp_extract(raw, f"^(.*?){date}", 1)
        v = F.when(raw.rlike(date), bound(before, lambda b: F.when(F.length(b) >= 2, b).otherwise(raw))).otherwise(raw)
        v = F.regexp_replace(v, "([0-9])[MFmf]$", "$1")
        return F.regexp_replace(v, f"(?i)({TAG_WORDS})+$", "")

    def whole(raw: Column, v: Column) -> Column:
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        bad = (
            raw.rlike(rf"^{date}$|^[0-9]{{4}}-[0-9]{{1,2}}|20[0-9]{{2}}[-年/.][0-9]{{1,2}}")
            | v.rlike("^[0-9]+-[0-9]+$")
            | (F.length(v) < 3)
            | bound(digits, lambda n: (n == 0) | (v.rlike("[A-Za-z]") & (n * 2 < F.length(v))))
        )
        return F.when(~bad, v)

    return bound(raw, lambda raw: bound(cut(raw), lambda v: whole(raw, v)))


def tokens(c: Column) -> Column:
    """All identifiers in a text, in order. A match that begins within a word is passed over as a whole."""
    beside = "[A-Za-z0-9一-鿿]"
    found = F.regexp_extract_all(c, F.lit(f"(?<={beside}){TOKEN}|(?<!{beside})({TOKEN})"), F.lit(1))
    return F.filter(F.transform(F.filter(found, lambda t: t != ""), clean_token), lambda t: t.isNotNull())


def first_token(c: Column, allow_cjk: bool = False) -> Column:
    found = F.get(tokens(c), 0)
    return found if allow_cjk else F.when(~has_cjk(c), found)


def has_label(c: Column, label: Column) -> Column:
    return F.regexp_like(c, label)


def value_after(c: Column, label: str | Column) -> Column:
    """The identifier that follows a label on its line; a colon among the first 20 characters ends the label."""
    label = F.lit(label) if isinstance(label, str) else label
    rest = F.regexp_extract_all(c, F.concat(F.lit("(?s)^.*?(?:"), label, F.lit(r")(.*)\z")), F.lit(1))
    rest = F.regexp_replace(F.get(rest, 0), "(?s)^[^:：]{0,19}[:：]", "")
    return F.when(has_label(c, label), clean_token(missing(F.regexp_extract(strip_label(rest), TOKEN, 0))))


def id_from_file_name(c: Column) -> Column:
    base = trimmed(F.regexp_replace(c, r"(?i)\.pdf\z", ""))
    return F.when(
        base.rlike(r"^[A-Za-z]?[0-9]{4,}[A-Za-z0-9-]*\z|^[A-Za-z][-A-Za-z0-9]{3,14}[0-9][-A-Za-z0-9]*\z"), F.upper(base)
    )


def shape_key(c: Column) -> Column:
    """Prefix and number of digits of an identifier, as in B#6; NULL for other forms."""
    letters = F.upper(F.regexp_extract(c, "^([A-Za-z]*)([0-9]+)$", 1))
    return F.when(c.rlike("^[A-Za-z]*[0-9]+$"), F.concat(letters, F.lit("#"), F.length(c) - F.length(letters)))


def skeleton(c: Column) -> Column:
    """A line's structure: one # for a run of digits, A for letters, 中 for CJK; without white space."""
    out = F.regexp_replace(c, f"[{SPACE}]+", "")
    for pattern, mark in (("[0-9]+", "#"), ("[A-Za-z]+", "A"), (f"{CJK}+", "中")):
        out = F.regexp_replace(out, pattern, mark)
    return out


def merge_key(c: Column) -> Column:
    """An identifier with wide letters narrowed, in upper case, without white space and leading zeros."""
    wide = "".join(chr(0xFEE0 + k) for k in (*range(48, 58), *range(65, 91), *range(97, 123)))
    narrow = "".join(chr(k) for k in (*range(48, 58), *range(65, 91), *range(97, 123)))
    plain = F.upper(F.regexp_replace(F.translate(c, wide, narrow), f"[{SPACE}]+", ""))
    return F.regexp_replace(plain, "^0+(?=[0-9])", "")


def plain_title(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^一-鿿A-Za-z0-9]", "")


def same_title(a: Column, b: Column, shared: int = 5) -> Column:
    """Whether two titles name one document: equal, one within the other, `shared` characters in a row, or of one kind."""
    x, y = plain_title(a), plain_title(b)
    starts = F.when(F.length(x) >= shared, F.sequence(F.lit(1), F.length(x) - shared + 1)).otherwise(F.array().cast("array<int>"))
    run = F.exists(starts, lambda i: F.contains(y, F.substr(x, i, F.lit(shared))))
    kind = missing(F.regexp_extract(x, TITLE_KINDS, 0)) == missing(F.regexp_extract(y, TITLE_KINDS, 0))
    like = (x == y) | F.contains(x, y) | F.contains(y, x) | run | F.coalesce(kind, F.lit(False))
    return (x != "") & (y != "") & like


def name_from_template(template: Column, identifier: Column, title: Column, source: Column) -> Column:
    """The template with its placeholders filled in; what is missing leaves no separators behind."""
    out = template
    for mark, value in (("{编号}", identifier), ("{标题}", title), ("{来源}", source)):
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, ILLEGAL, ""), "_{2,}", "_")
    return F.regexp_replace(out, rf"^[_{SPACE}-]+|[_{SPACE}-]+\z", "")


def make_name(mode: str, title: Column, identifier: Column, fallback: Column, template: Column, source: Column) -> Column:
    title, identifier = missing(title), missing(identifier)
    if mode == "id":
        return F.coalesce(identifier, title, fallback)
    if mode == "title_id":
        return F.coalesce(F.concat(title, F.lit("_"), identifier), title, identifier, fallback)
    if mode == "template":
        return F.coalesce(missing(name_from_template(template, identifier, title, source)), identifier, title, fallback)
    if mode == "title":
        return F.coalesce(title, fallback)
    raise ValueError(f"no naming mode {mode!r}")


def normal_date(c: Column) -> Column:
    """YYMMDD of the first a-b-c in a text, year first if it has four digits and last otherwise; other texts as they are."""
    pattern = "([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})"
    a, b, d = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    first = F.length(a) == 4
    year = F.when(first, a).otherwise(d).try_cast("int") % 100
    parts = (year.cast("string"), F.lpad(F.when(first, b).otherwise(a), 2, "0"), F.lpad(F.when(first, d).otherwise(b), 2, "0"))
    return F.when(c.rlike(pattern), F.concat(*parts)).otherwise(c)


def ratio_of(c: Column, characters: str) -> Column:
    """The share of characters of a class among those that aren't white space."""
    hit = F.length(F.regexp_replace(c, f"[^{characters}]", ""))
    every = F.length(F.regexp_replace(c, f"[{SPACE}]", ""))
    return hit / F.greatest(every, F.lit(1))


def is_chinese(c: Column) -> Column:
    return ratio_of(c, "一-鿿") >= 0.08


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 code units of a text, as hexadecimal digits, and its length in units: hash:length."""
    raw = F.hex(F.encode(c, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) / 4 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substr(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(raw) > 0, units).otherwise(F.array().cast("array<bigint>"))
    mixed = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat_ws(":", F.lower(F.hex(mixed)), F.size(units).cast("string"))


def garbage_line(c: Column, confidence: Column) -> Column:
    """Whether a recognised line is noise: unsure, one character over and over, or mostly signs."""
    n = F.length(c)
    most = F.array_max(F.transform(F.array_distinct(F.split(c, "")), lambda x: n - F.length(F.replace(c, x, F.lit("")))))
    unsure = ~(c.rlike("^(?i:[A-Z0-9][-A-Z0-9]{3,})$") & c.rlike("[0-9]"))
    same = (n >= 3) & ~c.rlike("[0-9]") & (most * 2 > n)
    signs = (n >= 6) & (F.length(F.regexp_replace(c, "[^0-9A-Za-z一-鿿]", "")) < n * 0.7)
    return F.when(confidence < 0.55, unsure).otherwise(same | signs)


def roster_text(c: Column) -> Column:
    """Identifiers of a pasted list, distinct and in order; NULL for none."""
    parts = F.array_distinct(F.filter(F.split(c, f"[{SPACE},，、;；]+"), lambda x: x != ""))
    return F.when(F.size(parts) > 0, parts)


def clean_rename(c: Column) -> Column:
    """A name typed by hand; NULL, for the automatic name, if nothing is left of it."""
    return missing(trimmed(F.regexp_replace(F.regexp_replace(c, r"(?i)\.pdf\z", ""), ILLEGAL, "")))
