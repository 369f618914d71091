import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm import ann, bpe, exact_dedup, line_dedup, mixing, pii, registry, scratch, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, row string, gone int, _lines int, n long, source string"


def awkward(spark):
    rows = [(1, "A  b\n\nA  b", "r", 1, 2, 3, None), (1, "A  b\n\nA  b", "r", 1, 2, 3, None), (None, None, None, None, None, None, "s"), (2, "", None, None, None, None, "s"), (3, "a b", None, None, None, None, "s")]
    return spark.createDataFrame(rows, EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def test_exact_dedup(spark):
    rows = [(i, t) for i, t in enumerate(["x  y", "x\ty", None, "", "z", "x y "])] + [(0, "x y"), (None, "z")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_groups=1, least_hot=1).collect()
    groups = Counter(re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows)
    assert len(got) == len(rows)
    assert sorted(r.group_size for r in got) == sorted(groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")] for _, t in rows)
    assert sum(r.kept for r in got) == len(groups)
    assert {r.keep_id for r in got if r.doc_id in (0, 1)} == {0}
    assert all(r.text_sha256 == hashlib.sha256(b"x y").hexdigest() for r in got if r.doc_id in (0, 1))


def normal(line):
    return re.findall(r"[^\W_]+", re.sub("[0-9]+", "0", line.lower()))


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog while seven wizards quietly box many jolly quail on page"
    rows = [(1, f"Head 12\nfirst text here\n{long} 1"), (2, f"head 99!\n--\n{long.upper()} 2\nother words follow"), (3, "--\n\nnew line"), (4, "HEAD 7")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]._text == rows[0][1] and got[1]._removed == 0
    assert got[2]._text == "--\nother words follow" and (got[2]._lines, got[2]._removed) == (4, 2)
    assert got[3]._text == rows[2][1]
    numbers = spark.createDataFrame([(1, "12\n7"), (2, "1999"), (3, "12 ")], "doc_id long, text string")
    assert {r.doc_id: r._removed for r in line_dedup.dedup_lines(numbers).collect()} == {1: 0, 2: 0, 3: 1}
    assert (got[4]._text, got[4]._removed, got[4]._lines) == ("", 1, 1)


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("few", [line_dedup.FEW, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = np.random.default_rng(9)
    vocabulary = [chr(97 + i % 26) * (1 + i // 26) for i in range(300)]
    passage, lines = list(rng.choice(vocabulary, 8)), []
    for n in [4, 5, 6, 7, *range(8, 61, 2)]:
        one = list(rng.choice(vocabulary[:3] if n % 3 == 0 and n < 12 else vocabulary, n))
        if n > 12:
            one[n // 3 : n // 3 + 8] = passage
        for k in (0, 1, n // 10, n // 5, n // 5 + 1, n // 4):
            other = list(one)
            for at in rng.choice(n, k, replace=False):
                other[at] = rng.choice(vocabulary)
            if k % 2:
                other.insert(int(rng.integers(n)), other.pop(int(rng.integers(n))))
            if k % 3 == 1:
                other.insert(int(rng.integers(n)), "extra")
            lines.append(other)
    group = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if edits(x, lines[j]) * 100 <= 20 * max(len(x), len(lines[j])):
                group = [group[j] if g == group[i] else g for g in group]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    gone = sorted(r.doc_id for r in line_dedup.dedup_lines(docs).filter("_removed = 1").collect())
    assert gone == [i for i in range(len(lines)) if group.index(group[i]) < i] and len(gone) > 60


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a\na"), (1, "a\na")]])
def test_line_dedup_of_little(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r._text == ("a" if r.doc_id else None) for r in got)


@pytest.mark.parametrize("weights", [[0.70007, 0.2, 0.09988, 0.00005], [1.0], [0.3, 0.3, 0.4], [2**-k for k in range(1, 12)], [1e-6, 1.0, 3.3]])
def test_schedule_follows_the_weights(weights):
    """Less than one block from the target weights after each of 100,000 slots, with and without a source that ends."""
    for blocks in ([10**9] * len(weights), [10**9 if k else 40 for k in range(len(weights))]):
        plan, sent, last = mixing.Schedule.of(weights, blocks), [0] * len(weights), -1
        for k, j, t in plan.delivered():
            assert t > last and j == sent[k]
            for other in range(len(weights)) if t % 50 == 0 else (k,):
                if sent[other] < blocks[other]:
                    assert abs(sent[other] * plan.total - t * plan.weights[other]) < plan.total
            sent[k], last = sent[k] + 1, t
            if t >= 100_000:
                break


def test_mix_keeps_all_rows(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}") for i in range(500)] + [(None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("clash"))
    got = mixing.mix(docs, {"big": 0.5}, block=4).collect()
    assert sorted((r.row.doc_id is None, r.row.doc_id, str(r.source)) for r in got) == sorted((i is None, i, str(s)) for i, s in rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    shares = {s: n for s, n in Counter(r.source for r in got).items() if s != "big"}
    whole = sum(n**mixing.TEMPERATURE for n in shares.values())
    for r in got:  # a block's slot is between its release and its deadline
        w = 0.5 if r.source == "big" else 0.5 * shares[r.source] ** mixing.TEMPERATURE / whole
        assert r.block / w - 1.001 < r.slot < (r.block + 1) / w + 0.001
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r["index"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert mixing.in_order(mixing.mix(docs)).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pii_spans():
    text = "Mail a.b@c.de, card 4539 1488 0343 6467, +49 30 1234567, 10.0.0.1, 999.1.1.1, IBAN DE89 3704 0044 0532 0130 00."
    kinds = [k for k, *_ in pii.find_spans(text)]
    assert {"email", "card", "phone", "ip", "iban"} <= set(kinds) and kinds.count("ip") == 1
    assert pii.find_spans(None) == [] and not pii.luhn("4539148803436468") and pii.mod97("DE89370400440532013000")


def test_bpe_equals_library(spark):
    texts = ["Hello  WORLD", "", None, "naïve İstanbul ΟΔΟΣ", "don't 123 <|endoftext|> x", "a" * 5000, "é́\x1c　z", "日本語 text"]
    lib = Tokenizer.from_file(registry.VOCABULARY)
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), registry.VOCABULARY).collect()
    for r in got:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == lib.decode(ids, skip_special_tokens=False), r.doc_id


@pytest.mark.parametrize("most", [10, 0])
def test_url_rules(spark, most):
    urls = ["http://A.example.org/es/x", "https://example.org/en/12?q", "ftp://org/", "http://x.com/de/a#b", "http://x.com/fr", "none", None, "http://notorg/", "://example.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, registry.RULES, max_trie_rules=most).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("org", "/", "org/", "allow") and got[3] == ("x.com", "/de/a", "com/de/", "block")
    assert got[4][2] is None and got[5] == got[6] == ("", "", None, "allow") and got[7][2] is None and got[8] == ("example.org", "", None, "allow")


def test_nearest_recall(spark):
    x = np.random.default_rng(4).standard_normal((600, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (650, [0.0] * 16), (700, [float("nan")] * 16), (None, [1.0] * 16)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = sum(r.vec_id in set(np.argsort(-(unit @ unit[r.query_id]))[1:6]) for r in got)
    assert len(got) == 60 and hits >= 54
    assert ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 2


@pytest.mark.parametrize("n, copies", [(2000, 0), (8192, 0), (8192, 2731)])
def test_nearest_equals_brute_force(n, copies):
    x = np.random.default_rng(8).standard_normal((n, 64))
    x[n - copies :] = x[0]  # a third of copies
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, n, 200)
    got = ann.nearest(ann.fit(unit[:2000]), np.arange(n), x, asked, x[asked], 5)
    for i in asked:
        close = np.round(unit @ unit[i], 12)
        close[i] = -2
        best = np.lexsort((np.arange(n), -close))[:5]
        assert got[1][got[0] == i].tolist() == best.tolist()


def test_toxicity_learns(spark):
    rng = np.random.default_rng(6)
    plain = ["river", "stone", "green", "walk", "sing", "table", "cloud", "paper"]
    rows = [(i, " ".join(rng.choice(plain, 60)) + (" vilest scum " if i % 3 == 0 else " ")) for i in range(600)] + [(None, None), (601, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_tables(spark, make):
    docs = make(spark)
    n = docs.count()
    assert exact_dedup.exact_dedup(docs).count() == pii.find_pii(docs).count() == line_dedup.dedup_lines(docs).count() == n
    assert bpe.encode_documents(docs, registry.VOCABULARY).count() == mixing.mix(docs).count() == n


def test_pipeline_stages(spark, tmp_path):
    texts = ["one two three four five six seven\nshared footer line", "eight nine ten eleven twelve\nShared FOOTER line!", "one two three four five six seven\nshared footer line", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lines = corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    assert {r.doc_id: r.text for r in lines.collect()} == {0: texts[0], 1: "eight nine ten eleven twelve", 3: None, 4: ""}
    near = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == [0, 1, 3, 4]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 3, 4]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_pipeline_keeps_the_mix(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7), "en", f"s{i % 3}", 9) for i in range(300)], DOCS)
    want = [(r.row.doc_id, r.slot, r.place) for r in corpus_pipeline.mixing.mix(docs).orderBy("slot", "place").collect()]
    corpus_pipeline.mixing_stage(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.bpe_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    assert [(r.doc_id, r.mix_slot, r.mix_place) for r in got.orderBy("mix_slot", "mix_place").collect()] == want


def test_lines_that_only_share_a_phrase_do_not_meet(spark):
    rng = random.Random(8)
    phrase = "ashenwoodgroves birchwoodgroves cedarwoodgroves elderwoodgroves hazelwoodgroves maplewoodgroves"
    lines = [" ".join([*("".join(rng.choices("abcdefgh", k=12)) for _ in range(n)), phrase]) for n in (4, 14, 34, 74)]
    rows = [(i, t) for i, t in enumerate([*lines, lines[2] + " yew"])]
    nodes = line_dedup._nodes(line_dedup._lines(spark.createDataFrame(rows, "doc_id long, text string")))
    met = line_dedup._members(nodes, line_dedup.PERCENT).select("id").distinct().join(nodes, "id")
    assert {r.n for r in met.collect()} == {40, 41}


@pytest.mark.parametrize("percent", [70, 75, 80, 90, 100])
def test_lines_of_all_lengths_meet(spark, percent):
    rng = random.Random(percent)
    rows = []
    for n in [*range(2, 34), 60]:
        most = n * (100 - percent) // 100
        line = ["".join(rng.choices("abcdefgh", k=12)) for _ in range(n)]
        other = list(line)
        for k in rng.sample(range(n), most):
            other[k] = f"x{line[k]}"
        rows += [(n, " ".join(line)), (n, " ".join(other))]
        if most and (n + 1) * (100 - percent) // 100 >= 1:
            rows.append((n, " ".join([*line[: n // 2], "new", *line[n // 2 :]])))
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, n long")
    got = {r.n: r.kept for r in line_dedup.dedup_lines(docs, percent=percent).groupBy("n").agg(F.sum(1 - F.col("_removed")).alias("kept")).collect()}
    assert set(got.values()) == {1}


def test_saved_tables_leave_no_shuffle_files(spark):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().endswith(".data") for i in range(files.size()))

    before, table = kept(), spark.range(1000).repartition(3, "id")
    saved = scratch.save(table, "test")
    assert kept() == before and saved.count() == table.count() == 1000
    scratch.drop(saved)


def test_lines_alike_in_pairs_are_not_all_compared(spark, monkeypatch):
    """Lines like each other, but not like the shorter one that comes first in their keys: no more than some pairs a line."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [(0, " ".join([*words[:28], *("other" + w for w in words[:8])]))]
    for k in range(60):
        rows.append((k + 1, " ".join([*words[: k % 40], f"new{chr(97 + k // 26)}{chr(97 + k % 26)}", *words[k % 40 + 1 :]])))
    compared, verify = [], line_dedup._verify

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verify", counted)
    got = {r.doc_id: r._removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: int(k > 1) for k in range(61)}
    assert sum(compared) <= 6 * len(rows), compared


def test_lines_that_share_a_passage_are_not_all_compared(spark, monkeypatch):
    """Lines of 20 common words and 12 of their own: any two share keys, none are similar but the last one and its copy."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(20)]
    rows = [(k, " ".join([*words, *(f"own{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + j)}" for j in range(12))])) for k in range(60)]
    rows.append((60, rows[-1][1] + " more"))
    compared, verify = [], line_dedup._verify

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verify", counted)
    got = {r.doc_id: r._removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: int(k == 60) for k in range(61)}
    assert sum(compared) <= 3 * len(rows), compared
