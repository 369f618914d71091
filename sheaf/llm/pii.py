"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its first digit only: its other digits have the same continuation.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
#: Words within REACH characters before or after a span that make its kind likelier.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
REACH = 40
#: Score of a confirmed span without context; a context word adds BONUS; spans below LEAST are not reported.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
BONUS, LEAST = 0.3, 0.5

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 13616: the first four characters go to the end, letters become 10 to 35."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once; the run of local characters before it, if any, is where a leftmost match starts."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = end = m.end()
        at = text.find("@", max(end, at + 1))


def _byte(part: str) -> bool:
    return len(part := part.lstrip("0")) < 4 and int(part or 0) < 256


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield "phone", *m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that pass mod 97; words in capitals that follow may have been taken along, and are looked at again."""
    m = _IBAN.search(text)
    while m:
        a, b = m.span()
        last = b
        while b - a > 15 and not mod97(text[a:b].replace(" ", "")):
            b = text.rfind(" ", a, b)
        if b - a >= 15 and mod97(text[a:b].replace(" ", "")):
            yield a, b
            last = b
        else:
            last = min(last, a + 5)  # beyond the country and its digits, so that a later beginning isn't lost
        m = _IBAN.search(text, last)


def _added(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Kinds beyond the base; they give way to base spans that they overlap."""
    if not _DIGIT.search(text):
        return
    taken = sorted((a, b) for _, a, b in taken)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, spans in (("iban", _ibans(text)), ("ssn", (m.span() for m in _SSN.finditer(text)))):
        for a, b in spans:
            before = bisect_left(starts, b)  # spans that begin before the end; one of them may reach beyond the start
            if not before or reach[before - 1] <= a:
                yield kind, a, b


def find_spans(text: str | None) -> list[Span]:
    """Spans (kind, start, end, score) in code points, end exclusive, by start, then kind as listed in KINDS.

    Base spans always stay, with their score; added ones only from a score of LEAST.
    """
    text = text or ""
    base = list(_proposed(text))
    out = []
    for kind, a, b in [*base, *_added(text, base)]:
        near = f"{text[max(0, a - REACH) : a]} {text[b : b + REACH]}".lower()
        words = set(re.findall(r"\w+", near))
        score = min(1.0, PRIOR[kind] + BONUS * any(w in words for w in CONTEXT[kind]))
        if kind in BASE or score >= LEAST:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end, score).

    A null or empty text has no spans; identifiers may be null or repeat; other columns are ignored. An empty table gives
    an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>"
    )
