import random
import re

from pyspark.sql import functions as F

from sheaf.llm import minhash
from sheaf.llm.components import components


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, groups=12, copies=14):
    """Chains of copies, each with a few words changed, beside unrelated texts and short ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                base = text
            rows.append(" ".join(text))
    rows += ["", None, " \t", "One", "one", "a b", "A  b", "a b c", "é É x", "É É x", "x\x1cy"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(spark):
    for percent, size in ((85, 3), (80, 5)):
        rows = family(percent)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = minhash.near_dedup(docs, minhash.Plan(size, percent)).collect()
        want = brute(rows, size, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_bucket_is_compared_in_blocks(spark):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(700):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5])):
            text[rng.randrange(60)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Plan(3, 85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_repeated_null_and_empty(spark):
    text = " ".join(f"k{i}" for i in range(40))
    rows = [(7, text, 1), (7, text, 2), (None, text, 3), (3, text + " more", 4), (None, "alone here now", 5), (9, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_dedup(docs, minhash.Plan(3, 85)).collect())
    assert got == [
        ("3", "3", True), ("7", "3", False), ("7", "3", False), ("9", "9", True), ("None", "3", False), ("None", "None", False)
    ]
    assert minhash.near_dedup(docs.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionAll(
        spark.createDataFrame([(100, 101), (101, 100), (5, 5), (None, 1)], "a long, b long"))
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 60)} | {101: 100}
