"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import batched
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.scratch import save

#: Documents in a block at least. Larger tables have larger blocks, so that one task can schedule them: no more than MAX_BLOCKS.
BLOCK, MAX_BLOCKS = 64, 1 << 21
#: Sources, whose weights every task holds, and blocks whose slots are broadcast; the slots of more are joined by a shuffle.
MAX_SOURCES, MAX_BROADCAST = 20_000, 200_000
#: The exponent of a source's size in its default weight: small sources are met more often than their share.
TEMPERATURE = 0.7


@dataclass(frozen=True)
class Schedule:
    """Exact weights as whole numbers, of which `total` is the sum, and the blocks that each source has."""

    weights: list[int]
    total: int
    blocks: list[int]

    @classmethod
    def of(cls, weights: list[float], blocks: list[int]) -> Schedule:
        if any(not 0 < w < float("inf") for w in weights):
            raise ValueError("a weight is a positive number")
        exact = [Fraction(w) for w in weights]
        scale = lcm(*[w.denominator for w in exact]) if exact else 1
        whole = [int(w * scale) for w in exact]
        return cls(whole, sum(whole), blocks)

    def delivered(self) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot) of all blocks, by slot.

        Block j of a source of weight w is released at floor(j / w) and due at ceil((j + 1) / w). Of the released blocks the
        one with the earliest deadline goes first. As the weights add up to one, every deadline is met: after any
        number of slots t, a source that still lasts has had more than w t - 1 and fewer than w t + 1 blocks. Slots in which
        nothing is released, as sources have ended, stay empty.
        """
        waiting = [(0, k, 0) for k, n in enumerate(self.blocks) if n]  # release, source, block
        ready: list[tuple[int, int, int]] = []  # deadline, source, block
        slot = 0
        while waiting or ready:
            if not ready:
                slot = max(slot, waiting[0][0])
            while waiting and waiting[0][0] <= slot:
                _, k, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * self.total // self.weights[k]), k, j))
            due, k, j = heapq.heappop(ready)
            assert due > slot, "a deadline was missed"
            yield k, j, slot
            if j + 1 < self.blocks[k]:
                heapq.heappush(waiting, ((j + 1) * self.total // self.weights[k], k, j + 1))
            slot += 1


def tempered(sizes: dict[str | None, int], temperature: float = TEMPERATURE) -> dict[str | None, float]:
    return {s: n**temperature for s, n in sizes.items()}


def _numbered(docs: DataFrame, order: list[Column]) -> DataFrame:
    """A saved table of docs with `index`: a row's place in its source, from 0, by `order`.

    A range sort cuts a large source into many partitions. Each partition counts its rows of each source, and what the
    partitions before it hold is added; there is one count for each source, and one more for each partition.
    """
    keyed = docs.select("*", *[c.alias(f"o{k}") for k, c in enumerate(order)])
    names = [f"o{k}" for k in range(len(order))]
    sort = [F.col("source").asc_nulls_last(), *[F.col(n).asc_nulls_last() for n in names]]
    rows = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).drop(*names)
    rows = save(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")
    runs = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    runs = runs.select(F.col("source").alias("s"), F.col("part").alias("p"), "begin", "before")
    joined = rows.join(runs, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("index", F.col("at") - F.col("begin") + F.col("before")).drop("part", "at", "s", "p", "begin", "before")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """All rows with all columns, as a struct `row`, and source, index, block, slot, place: the order of the mix.

    A source's rows, in an order by chance (a hash of the identifier), are cut into blocks; slot says when a block is
    delivered, place where a row is within it. Up to any slot, the blocks of each source that still lasts differ by
    less than one from its weight's share of the slots, however many there are. No row is dropped or repeated: the slots of a
    source that has ended stay empty, by which the others keep their proportions among each other.

    weights: for each source; others, and all by default, get their number of rows to the power TEMPERATURE, put so
    that given weights are shares of one. A null source is a source of its own. Null identifiers come last in their
    source; rows of one identifier stay together; equal rows are interchangeable. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.struct("*").alias("row"))
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of sources instead")
    sizes = {r.source: r.n for r in counted}
    given = {s: w for s, w in (weights or {}).items() if s in sizes}
    rest = tempered({s: n for s, n in sizes.items() if s not in given})
    left = 1 - sum(given.values())
    if rest and left <= 0:
        raise ValueError("the weights leave nothing for sources without one")
    whole = sum(rest.values())
    target = given | {s: w * left / whole for s, w in rest.items()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    block = max(block, -(-sum(sizes.values()) // MAX_BLOCKS))
    plan = Schedule.of([target[s] for s in names], [-(-sizes[s] // block) for s in names])
    table = _slots(docs.sparkSession, names, plan)
    if sum(plan.blocks) <= MAX_BROADCAST:
        table = F.broadcast(table)

    by = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))
    numbered = _numbered(rows, [F.col("doc_id").isNull(), by, F.col("doc_id")]).withColumn("block", F.floor(F.col("index") / block))
    placed = numbered.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("j")))
    return placed.select("row", "source", "index", "block", "slot", (F.col("index") % block).cast("int").alias("place"))


def _slots(spark: SparkSession, names: list[str | None], plan: Schedule) -> DataFrame:
    """s, j, slot for each block; one task schedules them, as each slot depends on the one before."""
    shared = spark.sparkContext.broadcast((names, plan))  # MAX_SOURCES names and numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plan = shared.value
        for _ in batches:
            for found in batched(plan.delivered(), 50_000):
                arrays = [pa.array([names[k] for k, _, _ in found], pa.string()), *[pa.array([x[i] for x in found], pa.int64()) for i in (1, 2)]]
                yield pa.RecordBatch.from_arrays(arrays, ["s", "j", "slot"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "s string, j long, slot long")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows themselves, sorted by their place in the mix: a file's rows follow on each other in it, as do the files."""
    dealt = mixed.select("row", "slot", "place").repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return dealt.select("row.*")
