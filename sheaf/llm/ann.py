"""Nearest neighbours: score-aware anisotropic product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions of a subspace, which has 16 centroids.
WIDTH, CENTROIDS = 4, 16
#: The codebooks are fitted on so many vectors at most, those with the smallest hashes of their identifiers.
SAMPLE = 20_000
#: Vectors and queries that meet in one unit of work, and the candidates of a table scan that get exact scores first.
CHUNK, BLOCK, RERANK = 8192, 1024, 160
#: Bounds of the rounding of table scans in single precision, and of a product of matrices in double precision.
SLACK, ROUNDING = 1e-4, 1e-9
#: Scores below this cosine don't matter to a search, by which errors along a vector weigh more than errors across.
THRESHOLD = 0.2


@dataclass
class Codebook:
    centroids: np.ndarray  # subspace, centroid, WIDTH
    eta: float  # weight of the squared error along the vector, beyond that of any direction

    def _parts(self, unit: np.ndarray) -> np.ndarray:
        m, _, w = self.centroids.shape
        return np.pad(unit, ((0, 0), (0, m * w - unit.shape[1]))).reshape(len(unit), m, w)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors. The error along a vector sums over its subspaces, so they are chosen in turns."""
        parts = self._parts(unit)
        dots = np.einsum("nmw,mcw->nmc", parts, self.centroids)
        squares = (parts**2).sum(axis=2)
        error = squares[:, :, None] - 2 * dots + (self.centroids**2).sum(axis=2)[None]
        along = squares[:, :, None] - dots  # what each choice adds to the inner product of error and vector
        codes = error.argmin(axis=2)
        rows = np.arange(len(unit))[:, None]
        total = along[rows, np.arange(codes.shape[1])[None], codes].sum(axis=1)
        for _ in range(sweeps):
            for m in range(codes.shape[1]):
                others = total - along[rows[:, 0], m, codes[:, m]]
                codes[:, m] = (error[:, m] + self.eta * (others[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = others + along[rows[:, 0], m, codes[:, m]]
        return codes.astype(np.uint8)

    def errors(self, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of the errors: no score by unit queries is off by more."""
        chosen = self.centroids[np.arange(codes.shape[1])[None], codes]
        return np.sqrt(((self._parts(unit) - chosen) ** 2).sum(axis=(1, 2)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each centroid: query, subspace, centroid."""
        return np.einsum("nmw,mcw->nmc", self._parts(queries), self.centroids).astype(np.float32)


def fit(unit: np.ndarray, rounds: int = 8, seed: int = 11) -> Codebook:
    """Codebooks for unit vectors by alternating choices of codes and weighted least squares for the centroids."""
    rng = np.random.default_rng(seed)
    size = unit.shape[1]
    m = ceil(size / WIDTH)
    start = unit[rng.choice(len(unit), CENTROIDS, replace=len(unit) < CENTROIDS)]
    ratio = max(1.0, (size - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    book = Codebook(np.zeros((m, CENTROIDS, WIDTH)), ratio - 1)
    book.centroids = book._parts(start).transpose(1, 0, 2).copy()
    parts = book._parts(unit)
    for _ in range(rounds):
        codes = book.encode(unit, 1)
        chosen = book.centroids[np.arange(m)[None], codes]
        along = ((parts - chosen) * parts).sum(axis=2)
        total = along.sum(axis=1)
        for k in range(m):
            x, rest = parts[:, k], total - along[:, k]
            target = rest + (x**2).sum(axis=1)
            for c in range(CENTROIDS):
                mine = codes[:, k] == c
                if not mine.any():
                    book.centroids[k, c] = x[rng.integers(len(x))]
                    continue
                a = mine.sum() * np.eye(WIDTH) + book.eta * x[mine].T @ x[mine]
                b = ((1 + book.eta * target[mine])[:, None] * x[mine]).sum(axis=0)
                book.centroids[k, c] = np.linalg.solve(a, b)
    return book


def scan(book: Codebook, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Approximate scores, query by vector; two four-bit codes share a byte, and a table of 256 sums."""
    tables = book.tables(queries)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    packed = np.ascontiguousarray((codes[:, ::2] * CENTROIDS + codes[:, 1::2]).T)
    pairs = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CENTROIDS**2)
    out = np.zeros((len(queries), codes.shape[0]), np.float32)
    for q in range(len(queries)):
        for k in range(len(packed)):
            out[q] += pairs[q, k].take(packed[k])
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _scores(x: np.ndarray, lengths: np.ndarray, q: np.ndarray, query_length: float) -> np.ndarray:
    return (x * q).sum(axis=1) / (lengths * query_length)


def nearest(book: Codebook | None, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the k nearest of x, as (query id, id, cosine); ids rise, and of equal scores the smaller id is nearer.

    The RERANK best of the table scan set a score to be reached; whatever may reach it, by the errors of the codes, gets
    an exact score as well, so that the result is that of comparing all.
    """
    lengths, query_lengths = _norms(x), _norms(q)
    if book is not None and len(x) > RERANK:
        unit = x / lengths[:, None]
        codes = book.encode(unit)
        rough, error = scan(book, codes, q / query_lengths[:, None]), book.errors(unit, codes) + SLACK
    else:
        book = None
    out: list[np.ndarray] = [[], [], []]
    for i in range(len(q)):
        others = ids != query_ids[i]
        at = np.flatnonzero(others)
        if book is not None and len(at) > max(k, RERANK):
            s = rough[i, at]
            first = at[np.argpartition(s, len(s) - max(k, RERANK))[-max(k, RERANK) :]]
            reached = np.sort(_scores(x[first], lengths[first], q[i], query_lengths[i]))[-k]
            at = at[s + error[at] >= reached]
            close = unit[at] @ (q[i] / query_lengths[i])
            at = at[close >= reached - ROUNDING]
        exact = _scores(x[at], lengths[at], q[i], query_lengths[i])
        best = np.lexsort((ids[at], -exact))[:k]
        out[0].append(np.full(len(best), query_ids[i]))
        out[1].append(ids[at[best]])
        out[2].append(exact[best])
    return [np.concatenate(c) for c in out]


def _usable(vector: Column) -> Column:
    limit = 1.7976931348623157e308
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= limit))
    return vector.isNotNull() & sound & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by cosine for each row that `queries` selects, but itself.

    All rows are coded and scanned for all queries: chunks of rows meet blocks of queries, so that a unit of work is
    bounded however many rows are equal. In each unit the best RERANK rows by the table scan, and all others that the
    errors of the codes leave in question, get exact scores in double precision, and only its k best leave it. `queries` is a condition on vec_id.

    Rows without an identifier take no part, nor do vectors that are null, empty or zero, or hold a null or non-finite
    component. Vectors are compared with those of their own dimension; the most frequent one has codebooks, others
    are scanned exactly. Rows of a repeated identifier are candidates each. With fewer candidates than k, all are
    returned; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("x"))).withColumn("size", F.size("x"))
    common = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(queries.cast("long")).alias("q"))
    total = common.agg(F.sum("n"), F.sum("q"), F.max(F.struct("n", "size"))).first()
    chunks, blocks = max(1, ceil((total[0] or 0) / CHUNK)), max(1, ceil((total[1] or 0) / BLOCK))
    main = total[2].size if total[2] else 0
    sample = rows.filter(F.col("size") == main).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()
    book = None
    if len(sample) > RERANK:
        unit = sample["x"].combine_chunks().flatten().to_numpy().reshape(len(sample), main)
        book = fit(unit / _norms(unit)[:, None])
    shared = spark.sparkContext.broadcast(book)

    place = F.xxhash64("vec_id", F.lit(7))
    base = rows.withColumn("chunk", F.pmod(place, F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = rows.filter(queries).dropDuplicates(["vec_id"]).withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    both = base.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    units = both.select("size", "chunk", "block", "asks", "vec_id", "x").repartition("size", "chunk", "block")
    units = units.sortWithinPartitions("size", "chunk", "block", "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            asks, ids, x = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            if asks.any() and not asks.all():
                found = nearest(shared.value if key[0] == main else None, ids[~asks], x[~asks], ids[asks], x[asks], k)
                arrays = [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            asks, ids = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if a == b:
                    continue
                if held and tuple(marks[a]) != key:
                    yield from flush()
                key = tuple(marks[a])
                part = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, key[0])
                held.append((asks[a:b], ids[a:b], part))
        if held:
            yield from flush()

    found = units.mapInArrow(run, "query_id long, vec_id long, score double")
    nearness = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearness)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
