import random
import re
import zlib
from collections import Counter
from math import isclose, log10

import pyarrow as pa
import pytest

from sheaf.llm import ppm


def docs():
    rng = random.Random(5)
    parts = ["th", "er", "in", "ing", "ö", "tion", "qu", "A", "\x00"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    return [*enumerate([*texts, None, "", "x" * 300, "TH\x0bth\x85th"])]


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def symbols(word, before):
    """(context and symbol) of a word's first bytes after the word before, and of its rest."""
    tail, stop = (before or b"")[-ppm.TAIL :], b"\n" if word is None else b""
    seen, out = tail + b" ", []
    for b in ([10] if stop else [*word, 32][: ppm.HEAD]):
        out.append((seen, b))
        seen += bytes([b])
    rest = []
    if word is not None:
        whole = b" " + word + b" "
        rest = [(whole[max(0, i - ppm.ORDER) : i], whole[i]) for i in range(ppm.HEAD + 1, len(whole))]
    return out, rest


def learn(table, pairs, c):
    for context, b in pairs:
        for k in range(min(ppm.ORDER, len(context)) + 1):
            table.setdefault(context[len(context) - k :], Counter())[b] += c


def score(table, pairs):
    out = 0.0
    for context, b in pairs:
        gone = set()
        for k in range(min(ppm.ORDER, len(context)), -1, -1):
            seen = table.get(context[len(context) - k :])
            if not seen:
                continue
            left = {x: c for x, c in seen.items() if x not in gone}
            n, d = sum(left.values()), len(left)
            if b in left:
                out += log10(left[b] / (n + d))
                break
            if d:
                out += log10(d / (n + d))
            gone |= set(seen)
        else:
            out -= log10(256 - len(gone))
    return out


def test_scores_match_brute_force(spark):
    rows = docs()
    got = {r.doc_id: r for r in ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    counts, first, rest = Counter(), {}, {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ws = words_of(t)
            counts.update([*ws, b""])
            for w, before in zip([*ws, None], [None, *ws], strict=True):
                learn(first, symbols(w and w.replace(b"\0", b"\1"), before and before.replace(b"\0", b"\1"))[0], 1)
    for w in counts:
        if len(w) >= ppm.HEAD:
            learn(rest, symbols(w.replace(b"\0", b"\1"), None)[1], 1)
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        r, ws = got[i], words_of(t)
        every = [*ws, b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(i).encode()) % 5 == 1, len(every), sum(counts[w] > 0 for w in every), n)
        assert isclose(r.base_score, sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in every), rel_tol=1e-9)
        total = 0.0
        for w, before in zip([*ws, None], [None, *ws], strict=True):
            a, b = symbols(w and w.replace(b"\0", b"\1"), before and before.replace(b"\0", b"\1"))
            total += score(first, a)
            if w is not None and len(w) >= ppm.HEAD:
                begun = {x: c for x, c in counts.items() if x[: ppm.HEAD] == w[: ppm.HEAD] and len(x) >= ppm.HEAD}
                p = score(rest, b)
                if begun:
                    m, d = sum(begun.values()), len(begun)
                    total += log10((counts[w] + d * 10**p) / (m + d))
                else:
                    total += p
        assert isclose(r.score, total, rel_tol=1e-9), i


def test_tokens_and_beginnings():
    words, lengths = ppm.tokenised(pa.array(["Ab\x0bcdefg ", None, "", "é x"]))
    assert words.to_pylist() == [b"ab", b"cdefg", "é x".encode()] and lengths.tolist() == [2, 0, 0, 1]
    codes = [int(c).to_bytes(8, "big").strip(b"\0") for c in ppm.beginnings(words, lengths)]
    assert codes == [b" ab ", b"ab cdef", b"efg \n", b" \n", b" \n", b" " + "é ".encode(), " x".encode() + b" \n"]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(2, "a a")]])
def test_small_tables(spark, rows):
    got = ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.score <= 0 for r in got)


def test_sequences_met_once_count_in_a_large_table(spark):
    """More than 2^21 symbols: what was met once in them is still known, as it is in a small table."""
    seen, hidden = [next(i for i in range(99) if (zlib.crc32(str(i).encode()) % 5 == 1) == x) for x in (False, True)]
    rows = [(seen, "ab " * 800_000 + "zebra crossing"), (hidden, "zebra crossings ab")]
    got = {r.doc_id: r for r in ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ws = words_of(rows[0][1])
    counts, first, rest = Counter(ws), {}, {}
    for (w, before), c in Counter(zip([*ws, None], [None, *ws], strict=True)).items():
        learn(first, symbols(w, before)[0], c)
    for w in counts:
        learn(rest, symbols(w, None)[1], 1)
    total = score(first, symbols(None, b"ab")[0])
    for w, before in ((b"zebra", None), (b"crossings", b"zebra"), (b"ab", b"crossings")):
        total += score(first, symbols(w, before)[0])
        begun = [c for x, c in counts.items() if len(w) >= ppm.HEAD and x[: ppm.HEAD] == w[: ppm.HEAD]]
        p = score(rest, symbols(w, None)[1])
        total += log10((counts[w] + len(begun) * 10**p) / (sum(begun) + len(begun))) if begun else p
    assert isclose(got[hidden].score, total, rel_tol=1e-9)


def test_joined_scores_are_those_that_are_broadcast(spark, monkeypatch):
    table = spark.createDataFrame(docs(), "doc_id long, text string")
    before = {r.doc_id: r for r in ppm.score_documents(table).collect()}
    monkeypatch.setattr(ppm, "CODE_SHARE", 2.0)
    monkeypatch.setattr(ppm, "WORD_SHARE", 2.0)
    for r in ppm.score_documents(table).collect():
        old = before[r.doc_id]
        assert r[:5] == old[:5] and isclose(r.score, old.score, rel_tol=1e-9) and isclose(r.base_score, old.base_score, rel_tol=1e-9)
