"""Mixing sources to target weights by Pfair scheduling.

A slot of the mixture takes one block of documents from one source. With whole weights
``a`` of the sources that add up to ``total``, block k of a source is released at slot
``floor(k * total / a)`` and is due by slot ``ceil((k + 1) * total / a)``; in every slot the
released block with the earliest deadline runs. Every deadline is met, so at any slot of
the whole mixture a source has had its weight's share to less than one block.

A schedule repeats after ``total`` slots, when every source has had ``a`` blocks. So one
period is drawn up, on one row for each source, and block k runs in the slot of block
``k mod a``, ``k div a`` periods later. Weights are shares of ``FINE`` slots, or of
``SLOTS_EACH`` slots for each source where that is more, and every source has one slot of a
period at least. So the period depends on the sources alone, and a corpus of any size is
mixed in blocks of one size. Each document finds its slot from its rank in its source.

Only DataFrame operations touch the rows. Ranks within a source come from ranks within
(source, bucket) and the buckets' counts, so a source with a third of all rows is spread
over all buckets, whose number follows the rows.

Defined results: a null source is a source of its own; a null ``doc_id`` is ranked like
any other value; equal rows each take a place; texts of any length are only passed on; no
rows give no rows. A source that has run out leaves its slots empty; nothing is dropped or
repeated. ``in_mixed_order`` passes on all columns, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, materialize, packed, shuffle_partitions, unpacked

BLOCK = 16
FINE = 1 << 18
SLOTS_EACH = 4
SCALE = 1024  # of a power of the number of documents, before it is rounded
ROWS_PER_BUCKET = 1 << 18
POWER = 0.5
#: A period of up to so many slots is sent to every task; a longer one is joined by Spark's own choice.
MOST_BROADCAST = 1 << 20
#: The same for a table with a row for each source and bucket, and for one with their stretches.
MOST_GROUPS = 1 << 17
MOST_STRETCHES = 1 << 18


def shares(aims: list[int]) -> list[int]:
    """Blocks of each source in one period, 1 at least."""
    fine, whole = max(FINE, SLOTS_EACH * len(aims)), sum(aims)
    return [max(1, (a * fine + whole // 2) // whole) for a in aims]


def whole_weights(names: list, sizes: Mapping, weights: Mapping | None, power: float = POWER) -> list[int]:
    """Target weights as whole numbers, 1 at least, that add up to the slots of a period."""
    if weights is None:
        return shares([max(1, round(float(sizes[s]) ** power * SCALE)) for s in names])
    aims = [float(weights[s]) for s in names]
    if any(not 0 < a < float("inf") for a in aims):
        raise ValueError("every source needs a finite weight above 0")
    most = max(aims, default=1.0)
    return shares([max(1, round(a / most * 2**40)) for a in aims])


def slots_needed(weights: list[int], blocks: list[int]) -> int:
    """Slots until every source has had all its blocks."""
    total = sum(weights)
    return max((-(-b * total // a) for a, b in zip(weights, blocks)), default=0)


def earliest_deadline_first(weights: list[int], blocks: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks, those of the first period."""
    total, slots, taken = sum(weights), [[] for _ in weights], [0] * len(weights)
    waiting = [(0, i) for i in range(len(weights))]  # by release
    ready: list[tuple[int, int]] = []  # by deadline, then source
    for slot in range(min(total, slots_needed(weights, blocks))):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(taken[i] + 1) * total // weights[i]), i))
        deadline, i = heapq.heappop(ready)
        assert slot < deadline
        if taken[i] < blocks[i]:  # one that has run out keeps its turn
            slots[i].append(slot)
        taken[i] += 1
        heapq.heappush(waiting, (taken[i] * total // weights[i], i))
    return slots


class Schedule:
    """The schedule of one period for the sources of ``docs``, and ranks and slots by it.

    One row for each source is collected, and no more.
    """

    def __init__(self, docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, power: float = POWER):
        sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        names = sorted(sizes, key=lambda s: (s is not None, s or ""))
        aims = whole_weights(names, sizes, weights, power)
        plan = list(zip(names, aims, earliest_deadline_first(aims, [-(-sizes[s] // block) for s in names])))
        self.block, self.total = block, sum(aims)
        self.buckets = max(256, -(-sum(sizes.values()) // ROWS_PER_BUCKET))
        self.groups = len(names) * self.buckets  # at most
        self.plan = docs.sparkSession.createDataFrame(plan, "mix_source string, mix_aim long, mix_slots array<int>")

    def in_buckets(self, docs: DataFrame) -> DataFrame:
        """Adds ``mix_bucket``."""
        head = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8)
        return docs.withColumn("mix_bucket", F.conv(head, 16, 10).cast("long") % self.buckets)

    def ranked(self, docs: DataFrame) -> DataFrame:
        """Adds ``mix_bucket`` and ``mix_rank``, the rank in the source."""
        docs = self.in_buckets(docs)
        counts = docs.groupBy("source", "mix_bucket").agg(F.count(F.lit(1)).alias("mix_n"))
        before = F.sum("mix_n").over(Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
        bases = counts.select(F.col("source").alias("mix_s"), F.col("mix_bucket").alias("mix_b"), F.coalesce(before, F.lit(0)).alias("mix_before"))
        found = docs.withColumn("mix_own", nth("source", "mix_bucket"))
        found = found.join(sent(bases, self.groups, MOST_GROUPS), same_group())
        return found.withColumn("mix_rank", F.col("mix_before") + F.col("mix_own")).drop("mix_s", "mix_b", "mix_before", "mix_own")

    def placed(self, ranked: DataFrame, *columns: str) -> DataFrame:
        """``columns`` and the place of each rank."""
        ranked = ranked.withColumn("mix_block", F.floor(F.col("mix_rank") / self.block).cast("long"))
        # the plan has as many rows as there are sources and total slots in all
        found = ranked.join(sent(self.plan, self.total, MOST_BROADCAST), F.col("source").eqNullSafe(F.col("mix_source")))
        return found.select(
            *[F.col(f"`{c}`") for c in columns],
            "mix_block",
            (F.col("mix_rank") % self.block).alias("mix_offset"),
            F.expr(f"mix_block * {self.total} div mix_aim").alias("mix_release"),
            F.expr(f"((mix_block + 1) * {self.total} + mix_aim - 1) div mix_aim").alias("mix_deadline"),
            F.expr(f"mix_slots[int(mix_block % mix_aim)] + mix_block div mix_aim * {self.total}").cast("long").alias("mix_slot"),
        )


def sent(rows: DataFrame, size: int, most: int) -> DataFrame:
    """``rows`` sent to every task, so that what they are joined to is not shuffled for it; beyond ``most`` Spark chooses."""
    return F.broadcast(rows) if size <= most else rows


def same_group() -> Column:
    return F.col("source").eqNullSafe(F.col("mix_s")) & (F.col("mix_bucket") == F.col("mix_b"))


def nth(*group: str) -> Column:
    """The rank in a group, from 0."""
    return F.row_number().over(Window.partitionBy(*group).orderBy("doc_id")) - 1


def mixed(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, power: float = POWER
) -> DataFrame:
    """All columns of ``docs`` and ``mix_block, mix_offset, mix_release, mix_deadline, mix_slot``.

    ``weights``: target weight for each source, above 0; without it, the number of
    documents of each source to ``power``. Reading in order of ``mix_slot, mix_offset``
    gives the mixture.
    """
    schedule = Schedule(docs, weights, block, power)
    return schedule.placed(schedule.ranked(docs), *docs.columns)


def mixing_digest(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source`` and the place of each document in the mixture."""
    found = mixed(docs.select("doc_id", "source"), **options)
    renamed = [F.col(c).alias(c.removeprefix("mix_")) for c in found.columns]
    return found.select(*renamed)


def stretches_of(schedule: Schedule, keys: DataFrame, parts: int) -> DataFrame:
    """For each source and bucket, as ``mix_s, mix_b``, its ranks cut where a new range of slots begins.

    ``mix_stretches`` has for each stretch in turn its first rank, the number of its range
    of slots and its first and last ``doc_id``; ``mix_loose`` is true where rows of one
    ``doc_id`` lie in two stretches, so that it does not tell them apart.
    """
    places = schedule.placed(schedule.ranked(keys), "doc_id", "source", "mix_bucket", "mix_rank")
    places = places.repartitionByRange(parts, "mix_slot").withColumn("part", F.spark_partition_id())
    own = F.struct("doc_id")  # a null is below all others
    found = places.groupBy("source", "mix_bucket", "part").agg(F.min("mix_rank").alias("rank"), F.min(own).alias("low"), F.max(own).alias("high"))
    found = found.groupBy(F.col("source").alias("mix_s"), F.col("mix_bucket").alias("mix_b")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "part", "low", "high"))).alias("mix_stretches")
    )
    torn = F.filter("mix_stretches", lambda x, i: x.low.eqNullSafe(F.get("mix_stretches", i - 1).high))
    return found.withColumn("mix_loose", F.size(torn) > 0)


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mixture, with the columns they have, whatever their names.

    Places are worked out on ``doc_id`` and source alone. A table of the stretches of each
    source and bucket then sends every whole row straight to its range of slots, so rows are
    shuffled once; only the buckets with a ``doc_id`` in two stretches are ranked beforehand.
    Where sources are too many for such tables in every task, all rows are.
    """
    parts = shuffle_partitions(docs.sparkSession)
    keys = documents_of(docs, "doc_id", "source")
    schedule = Schedule(keys, **options)
    rows = packed(docs, "doc_id", "source")
    stretches = materialize(stretches_of(schedule, keys, parts))
    known = stretches.agg(F.sum(F.size("mix_stretches")).alias("n"), F.max("mix_loose").alias("loose")).first()
    if (known.n or 0) > MOST_STRETCHES or schedule.total > MOST_BROADCAST:  # a join that shuffles would undo the order
        found = schedule.placed(schedule.ranked(rows), "row").repartitionByRange("mix_slot")
        return unpacked(found.sortWithinPartitions("mix_slot", "mix_offset"), docs.columns)
    rows = schedule.in_buckets(rows).join(F.broadcast(stretches), same_group())

    def to_stretch(rows: DataFrame, begun) -> DataFrame:
        """With the last stretch that has begun there."""
        last = F.element_at(F.filter("mix_stretches", begun), -1)
        return rows.select("row", "doc_id", "source", "mix_bucket", last.part.alias("mix_part"), last.rank.alias("mix_first"))

    sorted_out = to_stretch(rows.where("not mix_loose"), lambda x: x.low <= F.struct("doc_id"))
    if known.loose:
        loose = rows.where("mix_loose").withColumn("mix_rank", F.get("mix_stretches", F.lit(0)).rank + nth("source", "mix_bucket"))
        sorted_out = sorted_out.unionByName(to_stretch(loose, lambda x: x.rank <= F.col("mix_rank")))
    moved = sorted_out.repartitionById(parts, "mix_part")
    ranked = moved.withColumn("mix_rank", F.col("mix_first") + nth("mix_part", "source", "mix_bucket"))
    return unpacked(schedule.placed(ranked, "row").sortWithinPartitions("mix_slot", "mix_offset"), docs.columns)


def oracle(block: int = BLOCK, power: float = POWER, buckets: int = 256) -> str:
    """The same in DuckDB's SQL: the schedule of a period by a recursion over its slots."""
    return f"""
WITH RECURSIVE counted AS (
  SELECT source, greatest(1, round(pow(count(*)::DOUBLE, {power}) * {SCALE})::BIGINT) AS aim, (count(*) + {block - 1}) // {block} AS blocks
  FROM documents GROUP BY source),
sized AS (
  SELECT source, blocks, greatest(1, (aim::HUGEINT * fine + whole // 2) // whole)::BIGINT AS a
  FROM (SELECT *, sum(aim) OVER () AS whole, greatest({FINE}, {SLOTS_EACH} * count(*) OVER ()) AS fine FROM counted)),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) AS i, sum(a) OVER ()::BIGINT AS total FROM sized),
parts AS (SELECT list(a ORDER BY i) AS a, any_value(total) AS total, least(any_value(total), max((blocks * total + a - 1) // a)) AS slots FROM named),
edf AS (
  SELECT -1::BIGINT AS slot, list_transform(a, lambda v: 0::BIGINT) AS done, NULL::BIGINT AS pick, 0::BIGINT AS k FROM parts
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(a) + 1), lambda j: done[j] + (j = chosen)::BIGINT), chosen, done[chosen]
  FROM (
    SELECT edf.slot, edf.done, parts.a,
      list_sort(list_transform(list_filter(range(1, len(parts.a) + 1), lambda j: edf.done[j] * parts.total // parts.a[j] <= edf.slot + 1),
        lambda j: [((edf.done[j] + 1) * parts.total + parts.a[j] - 1) // parts.a[j], j]))[1][2] AS chosen
    FROM edf, parts WHERE edf.slot + 1 < parts.slots)),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {buckets}, doc_id) - 1 AS r FROM documents)
SELECT r.doc_id, r.source, r.r // {block} AS block, r.r % {block} AS "offset", r.r // {block} * s.total // s.a AS "release",
  ((r.r // {block} + 1) * s.total + s.a - 1) // s.a AS deadline, e.slot + r.r // {block} // s.a * s.total AS slot
FROM ranked r JOIN named s ON r.source IS NOT DISTINCT FROM s.source
JOIN edf e ON e.pick = s.i AND e.k = r.r // {block} % s.a"""
