"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents with equal texts form one atomic group. The groups stand in the order of a
60-bit hash of their text, and a shard is a contiguous run of groups. The operator finds
the smallest capacity for which a greedy sweep needs no more than ``n_shards`` shards.

The sweep never sees the groups themselves. It works on *cells*: runs of groups given by
a range of hash values, with their total size. Where a cut would fall inside a cell, the
sweep counts as if it could cut there (so the capacity found is a lower bound), and Spark
then splits just these cells into finer ones. Once no cut falls inside a cell of several
groups, the capacity is exact. The driver holds ``2 ** cell_bits`` cells at first and no
more than ``3 * n_shards * 2 ** cell_bits`` new ones each round, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import materialize

HASH_BITS = 60


@dataclass(frozen=True)
class Cell:
    """Groups with hashes from ``low`` to below ``low + 2 ** bits``."""

    low: int
    bits: int
    size: int
    groups: int


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5 as a long; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(0))


def cells_of(groups: DataFrame, ranges: list[tuple[int, int]], cell_bits: int) -> list[Cell]:
    """Split each range (low, bits) into 2 ** cell_bits cells; empty ones are left out."""
    key, step, low = F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")
    wanted = F.lit(False)
    for start, bits in ranges:
        inside = (F.col("key") >= start) & (F.col("key") < start + (1 << bits))
        fine = max(0, bits - cell_bits)
        cell = F.lit(start) + F.shiftleft(F.shiftright(F.col("key") - start, fine), fine)
        key, step = F.when(inside, cell).otherwise(key), F.when(inside, fine).otherwise(step)
        wanted = wanted | inside
    found = (
        groups.filter(wanted)
        .groupBy(key.alias("low"), step.alias("bits"))
        .agg(F.sum("weight").alias("size"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return sorted((Cell(r.low, r.bits, r["size"], r.n) for r in found), key=lambda c: c.low)


class Sweep:
    """Greedy sweeps over cells in order; positions are sizes summed from the left."""

    def __init__(self, cells: list[Cell]):
        self.cells = cells
        self.starts = [0]
        for c in cells:
            self.starts.append(self.starts[-1] + c.size)
        self.total = self.starts.pop()

    def cut(self, at: int, touched: set[int], up: bool = False) -> int:
        """The boundary at or below ``at`` (``up``: at or above), inside a cell of several groups ``at`` itself."""
        if at >= self.total:
            return self.total
        if at <= 0:
            return 0
        i = bisect_right(self.starts, at) - 1
        if self.starts[i] == at:
            return at
        if self.cells[i].groups > 1:
            touched.add(i)
            return at
        return self.starts[i] + self.cells[i].size if up else self.starts[i]

    def fits(self, capacity: int, n: int, touched: set[int]) -> list[int] | None:
        """The furthest ends of the first 1..n shards, or None if n shards are too few."""
        at, ends = 0, []
        for _ in range(n):
            at = self.cut(at + capacity, touched)
            ends.append(at)
        return ends if at >= self.total else None

    def from_right(self, capacity: int, n: int, touched: set[int]) -> list[int]:
        """The nearest ends of the first 1..n shards from which the others still reach the end."""
        at, ends = self.total, []
        for _ in range(n):
            ends.append(at)
            at = self.cut(at - capacity, touched, up=True)
        return ends[::-1]

    def smallest(self, n: int) -> int:
        low, high = -(-self.total // n), self.total
        while low < high:
            mid = (low + high) // 2
            if self.fits(mid, n, set()):
                high = mid
            else:
                low = mid + 1
        return low


def plan_cuts(sweep: Sweep, n: int, touched: set[int]) -> tuple[int, list[int]]:
    """The smallest capacity and the end of each shard.

    Many partitions reach the capacity; of these, each shard in turn ends as near as the
    capacity allows to an even share of what is left.
    """
    capacity = sweep.smallest(n)
    last = sweep.fits(capacity, n, touched) or []
    first = sweep.from_right(capacity, n, touched)
    at, ends = 0, []
    for k in range(n):
        ideal = at + -(-(sweep.total - at) // (n - k))
        below, above = sweep.cut(ideal, touched), sweep.cut(ideal, touched, up=True)
        end = below if ideal - below <= above - ideal else above
        high = min(last[k], sweep.cut(at + capacity, touched))
        end = max(min(end, high), first[k])
        ends.append(end)
        at = end
    return capacity, ends


def minimax_cuts(groups: DataFrame, n_shards: int, cell_bits: int = 12) -> tuple[int, list[int]]:
    """The capacity and the lowest key of shards 1, 2, … for ``groups(key, weight)``.

    A shard without groups starts where the next one does.
    """
    cells = cells_of(groups, [(0, HASH_BITS)], cell_bits)
    while True:
        sweep, touched = Sweep(cells), set()
        if not cells:
            return 0, []
        capacity, ends = plan_cuts(sweep, n_shards, touched)
        if not touched:
            break
        finer = cells_of(groups, [(cells[i].low, cells[i].bits) for i in sorted(touched)], cell_bits)
        cells = sorted([c for i, c in enumerate(cells) if i not in touched] + finer, key=lambda c: c.low)
    at = {s: c.low for s, c in zip(sweep.starts, sweep.cells)}
    return capacity, [at.get(e, 1 << HASH_BITS) for e in ends[:-1]]


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    cell_bits: int = 12,
    slot_cells: int = 256,
) -> DataFrame:
    """Deal all documents to ``n_shards`` shards of near equal bytes, equal texts together.

    Returns id, size (UTF-8 bytes plus ``overhead``), text_crc32, law ("bytes"), shard,
    slot (0, 1, … in each shard), grown_shard (null: that belongs to the key law) and
    capacity (the smallest possible largest shard).

    Cases: a null text has no bytes, CRC 0 and forms one group with other null texts; an
    empty text is another group. Repeated rows all get slots. A group larger than an even
    share has the largest shard. An empty table gives no rows. Other columns are ignored.
    Slots are dealt in ``slot_cells`` parts of every shard by a hash of the id, so the copies
    of one text are numbered by many tasks.
    """
    text = F.col(text_col)
    digest = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
            text_key(text).alias("key"),
        ),
        "shard-digest",
    )
    groups = materialize(digest.groupBy("key").agg(F.sum("size").alias("weight")), "shard-groups")
    capacity, cuts = minimax_cuts(groups, n_shards, cell_bits)
    shard = F.lit(0)
    for low in cuts:
        shard = shard + F.when(F.col("key") >= low, 1).otherwise(0)
    cell = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(slot_cells)), F.lit(0)).cast("int")
    dealt = digest.withColumns({"shard": shard.cast("int"), "cell": cell})
    # n_shards * slot_cells rows at most
    counts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "key")
    return (
        dealt.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
            F.lit(capacity).cast("long").alias("capacity"),
        )
    )
