"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for operators and stages; rules against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm import ann, bpe, line_dedup, minhash, pii, ppm, registry, shingles, toxicity, url_filter

LONG = "word " * 10_000 + "x" * 50_000
TEXTS = ["a b c d e f g", "a b c d e f g", None, "", " \t\n", LONG, "ÄÖ ñ 日本", "a b c d e f g"]
EXTRA = ("row", "gone", "_lines", "_gone", "n", "x.y", "slot", "score", "rank", "host", "component", "mix_slot")


def documents(spark, n=len(TEXTS)):
    rows = [(i if i != 3 else None, t, "en", None if i % 2 else "s", len(t or "")) for i, t in enumerate(TEXTS[:n])]
    rows = rows and [*rows, rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(EXTRA)})


@pytest.mark.parametrize("n", [0, len(TEXTS)])
def test_operators_on_awkward_tables(spark, n):
    docs = documents(spark, n)
    size = n + (n > 0)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), "row")
    scored = toxicity.score_documents(docs, labels).collect()
    assert len(scored) == size and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (0, 1, 7)}) == (n > 0)
    modelled = ppm.score_documents(docs).collect()
    assert len(modelled) == size and all(r.n_tokens >= 1 and r.score <= 0 for r in modelled)
    near = minhash.near_dedup(docs).collect()
    assert len(near) == size and {r.component_id for r in near if r.doc_id in (0, 1, 7)} == ({0} if n else set())
    assert toxicity.clean_documents(docs, labels).columns == docs.columns
    urls = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), "text").alias("url"), *[f"`{c}`" for c in EXTRA])
    assert url_filter.filter_urls(urls, registry.RULES).count() == url_filter.filter_urls(urls, registry.RULES, max_trie_rules=0).count() == size


def test_nearest_on_awkward_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [1.0, None]), (4, []), (5, None), (6, [float("inf"), 1.0]), (7, [1.0, 1.0, 1.0]), (8, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("rank", "score", "size", "x", "chunk")})
    got = ann.search(vectors, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 8)] and got[0].score == 1.0
    assert ann.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("n", [0, len(TEXTS)])
def test_stages_on_awkward_tables(spark, tmp_path, name, n):
    docs = documents(spark, n)
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    rows = got.collect()
    if name == "bpe":
        assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded", "mix_slot"] and len(rows) == n + (n > 0)
    elif name == "mixing":
        assert set(got.columns) == {*docs.columns, "mix_place"} and len(rows) == n + (n > 0)
    else:
        assert got.columns == docs.columns and len(rows) == {"toxicity": 9, "line_dedup": 7, "near_dedup": 7}[name] * (n > 0)


def test_bpe_on_all_kinds_of_characters():
    """Beside letters: code points of all categories, all that the library's Unicode tables have beyond Python's, and special ones."""
    lib, own = Tokenizer.from_file(registry.VOCABULARY), bpe.Bpe(open(registry.VOCABULARY, "rb").read())
    points = {*range(0, 0x110000, 37), *range(0x3100), *bpe._LOWER}
    for a, b, *_ in (*bpe.LETTERS_16, *bpe.NUMBERS_16, *bpe.LOWER_17):
        points |= {a - 1, b + 1, *range(a, b + 1, 7), b}
    texts = [f"a{chr(c)}b {chr(c)}" for c in sorted(points) if not 0xD800 <= c < 0xE000]
    rng = random.Random(4)
    texts += ["".join(rng.choice("abAB 'st<|>éΣ1 \x1c\ń") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["x<|endoftext|>y <|startoftext|>", "<|endoftext", "a" * 5000, LONG]
    ids, counts, decoded = own.encode(pa.array(texts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for k, found in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == found.ids, repr(texts[k])[:80]
        assert decoded[k].as_py() == lib.decode(found.ids, skip_special_tokens=False)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0


CHECKS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) < 256 for p in m.split(".")),
    "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
    "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
}


def base_spans(text):
    return [(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if CHECKS[kind](m[0])]


def test_pii_equals_the_expressions():
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "10.0.0.1", "1.2.3.4.5", "300.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+49 30 1234567", "+1", "@", ".", "-", " ", "é", "0", "12", "(", "abc", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        found = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE]
        assert sorted(found) == sorted(base_spans(text)), repr(text)


def test_ibans_that_follow_each_other():
    text = "DE89 3704 0044 0532 0130 00 FR14 2004 1010 0505 0001 3M02 606"
    assert [s[:3] for s in pii.find_spans(text)] == [("iban", 0, 27), ("iban", 28, 61)]


def test_words_with_equal_polynomials_differ():
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    for n in (1024, 2048, 4096):
        a, b = ("".join(x[k] for k in bits[:n]) for x in ("ab", "ba"))
        assert shingles.shingle_set(a, 3)[0] != shingles.shingle_set(b, 3)[0]


def test_one_edited_word_is_found_at_every_length(spark):
    """40 pairs of lines of each length, one of whose words is replaced, dropped or added: each pair is linked."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for n in (6, 10, 20, 55):
        for k in range(40):
            line = [rng.choice(vocabulary) for _ in range(n)]
            other, at = list(line), rng.randrange(n)
            other[at : at + (k % 3 < 2)] = [] if k % 3 == 1 else ["new" + rng.choice(vocabulary)]
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    gone = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("_removed = 1").select("doc_id").collect()
    assert sorted(r.doc_id for r in gone) == list(range(1, len(rows), 2))


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = toxicity.Network.new(5)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    ids = rng.integers(-1, 6, (4, toxicity.WINDOW))
    x, labels = rng.standard_normal((6, toxicity.SIZE)), np.array([0.0, 1.0, 1.0, 0.0])

    def loss():
        logit, saved = net.forward(net.project(x), ids, keep=True)
        return float((np.logaddexp(0, logit) - labels * logit).sum()), logit, saved

    _, logit, saved = loss()
    grad = net.backward(saved, 1 / (1 + np.exp(-logit)) - labels, 6)
    for name in ("out", "attend", "back", "shift"):
        p = net.params[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            kept = p[at]
            p[at] = kept + 1e-2
            up = loss()[0]
            p[at] = kept - 1e-2
            down = loss()[0]
            p[at] = kept
            assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=2e-3), name


def test_digests_are_of_ids_and_text(spark):
    df = spark.createDataFrame([(1, "Hello World")], "doc_id long, text string")
    row = bpe.encode_documents(df, registry.VOCABULARY, digests=True).first()
    found = Tokenizer.from_file(registry.VOCABULARY).encode("Hello World", add_special_tokens=False).ids
    assert row.n_tokens == len(found) and row.ids_sha256 == hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()


def test_score_of_a_text_does_not_depend_on_others():
    rng = np.random.default_rng(4)
    texts = [[b"w%d" % k for k in rng.integers(0, 4000, n)] for n in rng.integers(0, 40, 1500)]
    params = toxicity.Network.new().params
    params["in"] = params["in"] * 8

    def scores(some):
        return toxicity.Network(params).score(some)

    together, turned = scores(texts), scores(texts[::-1])[::-1]
    alone = np.concatenate([scores([t]) for t in texts])
    assert (together == alone).all() and (together == turned).all()


def test_features_by_slices():
    items = [b"word%d" % k for k in range(60_000)]
    tracemalloc.start()
    found = toxicity.features(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(x.nbytes for x in found)
    some = items[:101]
    for x, y in zip(toxicity.features(some, 7), toxicity.features(some), strict=True):
        assert (x == y).all()
