"""Near-duplicate documents: minima of universal hashes in bands, verified links, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.components import components
from sheaf.llm.scratch import drop, save
from sheaf.llm.shingles import common, mix, shingle_set

#: Members of a bucket, or partners of a document, that are compared in one piece.
BLOCK = 256


@dataclass(frozen=True)
class Plan:
    """Shingle size, threshold in hundredths, and bands by rows that miss a pair at it once in a few million times."""

    size: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 85 else 5 if self.percent >= 75 else 4

    @property
    def bands(self) -> int:
        return ceil(log(3e-7) / log(1 - (self.percent / 100) ** self.rows))

    @property
    def minima(self) -> int:
        return self.rows * self.bands

    @property
    def least_equal(self) -> int:
        """Minima that agree in nearly every pair at the threshold: five standard deviations below the mean."""
        j = self.percent / 100
        return int(self.minima * j - 5 * (self.minima * j * (1 - j)) ** 0.5)


class Hasher:
    def __init__(self, plan: Plan):
        self.plan = plan
        draws = np.random.default_rng(20240501).integers(0, 1 << 63, (2, plan.minima), np.uint64) * np.uint64(2) + np.uint64(1)
        self.factor, self.shift = draws[0][:, None], draws[1][:, None]
        self.band = mix(np.arange(1, plan.bands + 1, dtype=np.uint64))

    def signature(self, items: np.ndarray) -> np.ndarray:
        least = np.full(self.plan.minima, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(items), 512):  # stays in cache, and bounds the memory for long texts
            least = np.minimum(least, (items[None, at : at + 512] * self.factor + self.shift).min(axis=1))
        return least

    def bands(self, signature: np.ndarray) -> np.ndarray:
        out = self.band.copy()
        for column in signature.reshape(self.plan.bands, self.plan.rows).T:
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + column)
        return out.view(np.int64)


def _sketch(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n (set size), fp (128 bits of the whole set), bands, sig (the last byte of each minimum)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(plan)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, fp, bands, sig = [], [], [], []
                for k in range(batch.num_rows):
                    items = shingle_set(batch.column(1)[k].as_py(), plan.size)
                    n.append(len(items))
                    if not len(items):
                        fp.append(None)
                        bands.append(None)
                        sig.append(None)
                        continue
                    least = hasher.signature(items)
                    fp.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    bands.append(hasher.bands(least))
                    sig.append((mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
                arrays = [pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "fp", "bands", "sig"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, fp binary, bands array<long>, sig binary")


def _verify(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are similar enough. texts: node, text.

    Partners of one document are dealt in slices; its text goes once to each slice, theirs go along one by one.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    pairs = pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / BLOCK)).cast("int").alias("slice")
    )
    lead = pairs.select(F.col("a").alias("node"), "a", "slice").distinct().withColumn("partner", F.lit(False))
    rest = pairs.select(F.col("b").alias("node"), "a", "slice").withColumn("partner", F.lit(True))
    rows = lead.unionAll(rest).join(texts, "node").select("a", "slice", "partner", "node", "text")
    rows = rows.repartition("a", "slice").sortWithinPartitions("a", "slice", "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                a, part, partner, node = (batch.column(k).to_pylist() for k in range(4))
                found = []
                for k in range(batch.num_rows):
                    items = shingle_set(batch.column(4)[k].as_py(), plan.size)
                    if (a[k], part[k]) != key:
                        key, sets = (a[k], part[k]), []
                    if not partner[k]:
                        sets.append(items)  # one, unless the identifier repeats
                        continue
                    for s in sets:
                        both = common(s, items)
                        if 100 * both >= plan.percent * (len(s) + len(items) - both):
                            found.append((a[k], node[k]))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _across(members: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between members of one bucket, but of different components.

    members: key, node, n, bands, sig, component, text. A bucket is cut into blocks, and every two blocks meet in one
    slice. A pair is looked at in the smallest bucket key that it shares; where size and signature allow, full sets are
    compared, unless links that the slice has found before connect the two already. Only links leave it.
    """
    size = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = members.join(size, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = blocks.select("*", other.alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "sig", "component", "bands", "text"
    )
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(rows: list[tuple]) -> tuple[list[int], list[int]]:
        out: tuple[list[int], list[int]] = [], []
        key, i, j = rows[0][:3]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return out
        above = {r[7]: r[7] for r in rows}  # of a component, one that it has been linked with; roots are their own

        def root(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        sizes, nodes = (np.array([r[k] for r in right], np.int64) for k in (5, 4))
        sigs = np.frombuffer(b"".join([r[6] for r in right]), np.uint8).reshape(len(right), -1)
        bands = np.array([r[8] for r in right], np.int64)
        sets = {}
        for r in left:
            ok = 100 * np.minimum(sizes, r[5]) >= plan.percent * np.maximum(sizes, r[5])
            ok &= nodes > r[4] if i == j else nodes != r[4]
            at = np.flatnonzero(ok)
            at = at[(sigs[at] == np.frombuffer(r[6], np.uint8)).sum(axis=1) >= plan.least_equal] if len(at) else at
            if not len(at):
                continue
            own = np.array(r[8], np.int64)
            shared = np.where(bands[at] == own, own, np.iinfo(np.int64).max).min(axis=1)
            for k in at[shared == key]:
                other = right[k]
                if root(r[7]) == root(other[7]):
                    continue
                for x in (r, other):
                    if x[4] not in sets:
                        sets[x[4]] = shingle_set(x[9], plan.size)
                s, t = sets[r[4]], sets[other[4]]
                both = common(s, t)
                if 100 * both >= plan.percent * (len(s) + len(t) - both):
                    above[root(r[7])] = root(other[7])
                    out[0].append(r[4])
                    out[1].append(other[4])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if group:
                columns = compare(group)
                group.clear()
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield from flush()
                group.append(row)
        yield from flush()

    return rows.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, over links of at least plan.percent hundredths.

    Equal sets are one node, named by their smallest identifier. Nodes that share a band are in one bucket. First each
    node is verified against the smallest node of the bucket that it shares most bands with; components of these links
    leave few buckets with more than one component, and there all pairs of different components are compared. Two nodes
    of one bucket are thus in one component, or compared. Links are confirmed on full sets of 64-bit fingerprints.

    Null and empty texts and such without words have no shingles and no links. Identifiers are integers. Rows that
    repeat an identifier are one document; rows without one have the component of equal sets, null where there are
    none, and aren't kept. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = save(_sketch(docs, plan), "sketch")
    least = F.min(F.struct("doc_id", "n", "bands", "sig")).alias("x")
    nodes = sketch.filter("n > 0 and doc_id is not null").groupBy("fp").agg(least)
    nodes = save(nodes.select("fp", F.col("x.doc_id").alias("node"), "x.n", "x.bands", "x.sig"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot")).filter("c > 1")
    members = save(banded.join(shared.select("key", "pivot"), "key").distinct(), "members")
    involved = members.select("node").distinct()
    texts = save(docs.join(involved, docs.doc_id == involved.node).select("node", "text").distinct(), "texts")

    pivots = members.filter("node != pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c"))
    first = pivots.groupBy("node").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("x"))
    tested = save(first.select(F.col("node").alias("b"), (-F.col("x.p")).alias("a")), "pairs")
    links = save(_verify(tested, texts, plan), "links")
    found = components(links)

    def placed(df: DataFrame, node: str, component: str) -> DataFrame:
        """df with the component of a node; a node without links is its own."""
        named = found.select(F.col("node").alias(node), F.col("component").alias("_c"))
        return df.join(named, node, "left").withColumn(component, F.coalesce("_c", node)).drop("_c")

    split = placed(members.select("key", "node"), "node", "component")
    mixed = split.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    facts = nodes.select("node", "n", "bands", "sig").join(texts.groupBy("node").agg(F.min("text").alias("text")), "node")
    open_members = split.join(mixed.select("key"), "key").join(facts, "node")
    more = save(_across(open_members, plan), "links")
    if not more.isEmpty():
        found = components(links.unionAll(more))
    drop(tested, members, texts, links, more)

    named = placed(nodes.select("fp", "node"), "node", "component_id").select("fp", "component_id")
    full = sketch.filter("fp is not null").join(named, "fp", "left").select("doc_id", "n", "component_id")
    empty = sketch.filter("fp is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionAll(empty).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
