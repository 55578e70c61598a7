"""The k nearest of a table of places for every row of another, however crowded or sparse they are.

Space is cut at medians into leaves of about as many places each, so the work does not grow with the density. A row
is searched in its own leaf first; what lies farther than the k-th neighbour found there cannot count, so only leaves
whose box is nearer than that are asked besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import tables

#: Places in a leaf (about), rows that are searched in one group, rows of the sample that sets the cuts, levels of cuts.
LEAF, GROUP, SAMPLE, LEVELS = 2048, 20_000, 1 << 18, 13
AXES = ["x", "y", "z"]


def blocks(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of the rows of ``p`` in groups of ``size`` at most that lie together."""
    out, open_ = [], [np.arange(len(p))] if len(p) else []
    while open_:
        at = open_.pop()
        if len(at) <= size:
            out.append(at)
            continue
        values = p[at]
        axis = int(np.argmax(np.ptp(values, axis=0)))
        order = np.argpartition(values[:, axis], len(at) // 2)
        open_ += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def length(gaps: np.ndarray) -> np.ndarray:
    """Sizes of vectors (last axis); every step grows with the gaps, so a box's is never over that of a place in it."""
    return np.sqrt(sum(gaps[..., i] * gaps[..., i] for i in range(gaps.shape[-1])))


def box_gap(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The least distance from a box, or from many, to others."""
    return length(np.maximum(np.maximum(lows - high, low - highs), 0.0))


def nearest_rows(p: np.ndarray, q: np.ndarray, k: int, size: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of q, distance) of the k nearest of q for each of p, of equal ones the first rows of q."""
    held = blocks(q, size)
    if not held:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    lows, highs, sizes = np.stack([q[h].min(axis=0) for h in held]), np.stack([q[h].max(axis=0) for h in held]), np.array([len(h) for h in held])
    found = []
    for at in blocks(p, size):
        x = p[at]
        gap = box_gap(x.min(axis=0), x.max(axis=0), lows, highs)
        order = np.argsort(gap)
        few = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
        within = np.inf
        if few <= len(held):
            d = length(x[:, None] - q[np.concatenate([held[i] for i in order[:few]])][None])
            within = np.partition(d, k - 1, axis=1)[:, k - 1].max()
        near = np.sort(np.concatenate([held[i] for i in np.flatnonzero(gap <= within)]))
        d = length(x[:, None] - q[near][None])
        last = min(k, len(near))
        row, col = np.nonzero(d <= np.partition(d, last - 1, axis=1)[:, last - 1 : last])
        order = np.lexsort((col, d[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, np.arange(len(at)))
        taken = np.arange(len(row)) - first[row] < k
        row, col = row[taken], col[taken]
        found.append((at[row], near[col], d[row, col]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


class Cuts:
    """Halvings of space at medians of a sample, widest axis first: a complete tree whose leaves are numbered."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.at = np.zeros(2**levels - 1, int), np.zeros(2**levels - 1)
        held = [sample]
        for level in range(levels):
            below = []
            for i, x in enumerate(held):
                node = 2**level - 1 + i
                if len(x):
                    self.axis[node] = np.argmax(np.ptp(x, axis=0))
                    self.at[node] = np.median(x[:, self.axis[node]])
                right = x[:, self.axis[node]] > self.at[node]
                below += [x[~right], x[right]]
            held = below

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), int)
        for _ in range(self.levels):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (2**self.levels - 1)


def coordinates(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(t.column(c).to_numpy(**({} if isinstance(t, pa.Table) else {"zero_copy_only": False})), float) for c in AXES], axis=1)


def nearest_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, xyz: list[str], k: int, radius: float | None = None) -> DataFrame:
    """The k nearest of b for every a (a_id, b_id, distance, rank); ties go to the lesser id. The result is a table that was written.

    Of b's rows at one place only the k of least id can be among them, so copies cost nothing. The cuts come of a sample
    of ``SAMPLE`` places at most and only say where rows are dealt; boxes and sizes of the leaves (2^``LEVELS`` at
    most) reach the driver. A leaf that many rows ask is searched in groups of about ``GROUP`` rows.

    Cases: rows with a coordinate that is null or not finite have no row and are in none. With fewer than k of b, all of them.
    ``radius`` (where a search by rounds began) is no longer needed.
    """
    spark = a.sparkSession
    scope = tables(spark, "nearest")
    finite = " and ".join(f"abs({c}) < double('infinity')" for c in AXES)
    placed = lambda df, key: df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(xyz, AXES)]).filter(finite)
    alike = Window.partitionBy(*AXES).orderBy("id")
    places = scope.cut(placed(b, b_id).withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k).drop("_n"))
    n = places.count()
    levels = int(min(LEVELS, max(0, np.ceil(np.log2(max(n, 1) / max(LEAF, 4 * k))))))
    sample = coordinates(places.select(*AXES).sample(min(1.0, 0.9 * SAMPLE / max(n, 1)), 7).limit(SAMPLE).toArrow()) if levels else np.empty((0, 3))
    cuts = spark.sparkContext.broadcast(Cuts(sample, levels))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.value.leaf(coordinates(batch)), pa.int32())], names=[*batch.schema.names, "leaf"])

    dealt = lambda df: df.mapInArrow(deal, ", ".join([*[f"{c} {t}" for c, t in df.dtypes], "leaf int"]))
    held = scope.cut(dealt(places))
    asked = scope.cut(dealt(placed(a, a_id)))
    boxes = held.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{g}{c}") for g, f in (("low", F.min), ("high", F.max)) for c in AXES]).orderBy("leaf").toArrow().to_pandas()
    leaves, lows, highs = boxes["leaf"].to_numpy(), boxes[[f"low{c}" for c in AXES]].to_numpy(), boxes[[f"high{c}" for c in AXES]].to_numpy()
    sent = spark.sparkContext.broadcast((leaves, lows, highs, boxes["n"].to_numpy() >= k))
    kinds = {"a_id": asked.schema["id"].dataType.simpleString(), "b_id": held.schema["id"].dataType.simpleString()}
    schema = f"a_id {kinds['a_id']}, b_id {kinds['b_id']}, distance double, x double, y double, z double, leaf int"


    names = ["a_id", "b_id", "distance", *AXES, "leaf"]

    def answer(t: pa.Table, of: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        of = of.take(pc.sort_indices(of, [("id", "ascending")]))
        p = coordinates(t)
        row, col, d = nearest_rows(p, coordinates(of), k)
        within, found = np.zeros(len(p)), np.bincount(row, minlength=len(p))
        np.maximum.at(within, row, d)
        within[found < k] = np.inf
        return p, within, pa.table({"a_id": t.column("id").take(pa.array(row)), "b_id": of.column("id").take(pa.array(col)), "distance": d})

    def first(t: pa.Table, of: pa.Table) -> pa.Table:
        p, within, out = answer(t, of)
        boxes, lows, highs, full = sent.value
        who, where = [], []
        for at in blocks(p, 256):
            x = p[at]
            whole = box_gap(x.min(axis=0), x.max(axis=0), lows, highs)
            far = length(np.maximum(np.abs(x.max(axis=0) - lows), np.abs(highs - x.min(axis=0))))  # no row of the block is farther from a place there
            most = np.minimum(within[at], far[full].min() if full.any() else np.inf)
            near = np.flatnonzero(whole <= most.max())
            r, c = np.nonzero(box_gap(x[:, None], x[:, None], lows[near][None], highs[near][None]) <= most[:, None])
            who.append(at[r])
            where.append(boxes[near[c]])
        who, where = (np.concatenate(x) if x else np.empty(0, int) for x in (who, where))
        here = t.column("leaf")[0].as_py()
        who, where = who[where != here], where[where != here]
        asks = t.select(["id", *AXES]).take(pa.array(who)).rename_columns(["a_id", *AXES]).append_column("leaf", pa.array(where, pa.int32()))
        return pa.concat_tables([out, asks], promote_options="default").select(names)

    def second(t: pa.Table, of: pa.Table) -> pa.Table:
        return answer(t, of)[2]

    def grouped(rows: DataFrame, work, schema: str) -> DataFrame:
        parts = F.broadcast(rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("_parts")))
        left = rows.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
        right = held.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(work, schema)

    found = scope.cut(grouped(asked, first, schema))
    more = grouped(found.filter("leaf is not null").select(F.col("a_id").alias("id"), *AXES, "leaf"), second, ", ".join(schema.split(", ")[:3]))
    near = found.filter("leaf is null").select("a_id", "b_id", "distance").unionByName(more)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("distance", "b_id"))).filter(F.col("rank") <= k)
    out = scope.keep(ranked)
    scope.close()
    return out
