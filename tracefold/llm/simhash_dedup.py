"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their four 16-bit
quarters. Two fingerprints within the radius have counts that differ by no more than the
radius in all, so every tile meets only the tiles around it; the others are skipped. Inside a
tile numpy compares whole blocks by exclusive-or and bit counts. A tile with many
fingerprints is cut into parts, and what comes from other tiles streams past the part, so a
task holds a bounded number of fingerprints. A tile gives links of a spanning forest, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import by_shuffle, materialize, scratch
from .components import connected_components

QUARTERS, SHINGLE, SEED = 4, 3, 42
#: Fingerprints in a part of a tile (every other fingerprint of the tile and its neighbours passes each
#: part, so that few large parts shuffle least: half a MB at home), and hashes turned to bits at once.
PART, BLOCK = 1 << 16, 1 << 16


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the 3-word shingles of a text in lower case (A-Z); 0 without words."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return 0
    width = min(SHINGLE, len(tokens))
    shingles = map(b" ".join, zip(*[tokens[i:] for i in range(width)]))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64, len(tokens) - width + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fingerprint (as a signed long) of every document."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, text_hash long, fp long")


class Forest:
    """Union-find over the fingerprints of a tile's part: a second link between two trees is no news."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def links_between(home: np.ndarray, probes: np.ndarray, radius: int, forest: Forest, out: list) -> None:
    """Links between probes and the fingerprints at home, but those a forest can spare."""
    step = max(1, (1 << 21) // max(1, len(home)))
    for i in range(0, len(probes), step):
        part = probes[i : i + step]
        p, h = np.nonzero(np.bitwise_count(part[:, None] ^ home[None, :]) <= radius)
        for a, b in zip(part[p].tolist(), home[h].tolist()):
            if a != b and forest.join(a, b):
                out.append((a, b))


def compare_tiles(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (tile, part, away, fp) in this order: those at home first, then the probes."""
    at, home, alone, forest = None, [], None, Forest()
    for batch in batches:
        out: list[tuple[int, int]] = []
        tile, part, away, fp = (batch.column(c).to_numpy() for c in ("tile", "part", "away", "fp"))
        change = np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(away) != 0)) + 1
        for i, j in zip([0, *change.tolist()], [*change.tolist(), len(fp)]):
            if i == j:
                continue
            if (tile[i], part[i]) != at:
                at, home, alone, forest = (tile[i], part[i]), [], None, Forest()
            values = fp[i:j].view(np.uint64)
            if not away[i]:
                for known in home:
                    links_between(known, values, radius, forest, out)
                links_between(values, values, radius, forest, out)
                home.append(values)
            elif home:
                if alone is None or len(alone) != sum(map(len, home)):
                    alone = np.concatenate(home)
                links_between(alone, values, radius, forest, out)
        ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def steps_around(radius: int) -> list[int]:
    """Half of the steps between tiles whose counts differ by 1..radius in all, as differences of tile numbers."""
    span = range(-radius, radius + 1)
    return [
        sum(x * 32**i for i, x in enumerate(d))
        for d in product(span, repeat=QUARTERS)
        if 0 < sum(map(abs, d)) <= radius and next(x for x in d if x) > 0
    ]


def near_links(distinct: DataFrame, radius: int = 3, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within the radius of one another."""
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))
    tile = sum((quarter(i) + 4) * 32**i for i in range(QUARTERS)).cast("int")
    tiled = write(distinct.select("fp", tile.alias("tile")), "tiles")
    # at most 17 ** 4 tiles, whatever the input: safe to broadcast
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    sized = tiled.join(F.broadcast(sizes), "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    home = sized.select("tile", "part", F.lit(0).alias("away"), "fp")
    later = sized.filter("part + 1 < parts").select("tile", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), F.lit(1).alias("away"), "fp")
    steps = F.array(*[F.lit(s) for s in steps_around(radius)])
    around = tiled.select("tile", "fp", F.explode(steps).alias("step")).select((F.col("tile") + F.col("step")).alias("tile"), "fp")
    abroad = around.join(F.broadcast(sizes), "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("away"), "fp")
    dealt = home.union(later).union(abroad).repartition("tile", "part").sortWithinPartitions("tile", "part", "away")
    return dealt.mapInArrow(partial(compare_tiles, radius=radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", write: Callable[[DataFrame, str], DataFrame] = materialize
) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that names the group) and component_id (the least doc_id of the group) of every document.

    Documents are linked where their fingerprints differ in at most ``radius`` bits.

    Cases: null and empty texts and texts of white space have fingerprint 0, and are linked
    like any other. Copies share a fingerprint and so a group; they are compared once. A null
    doc_id takes part, but gives a group its id only if it has no other; so groups can share a
    component_id (null, or a doc_id repeated with other texts), but never a root. A very long text
    is hashed whole, in blocks. Repeated rows give a row each; an empty table gives no rows.
    Extra columns are ignored, whatever their names.
    """
    prints = write(fingerprints(docs, id_col, text_col), "fingerprints")
    with scratch(docs.sparkSession) as keep:
        first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
        components = connected_components(keep(near_links(prints.select("fp").distinct(), radius, keep), "near-links"), keep)
        rooted = first.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        groups = write(rooted.join(least, "root").select("fp", "root", "component_id"), "groups")
    return prints.join(groups, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of least id (then text hash).

    Cases are those of :func:`near_duplicates`. Groups are told apart by their root, so unlike texts
    stay though their ids are null or equal. Of a row that is repeated (id and text) one stays.
    All columns of ``docs`` stay, whatever their names.
    """
    with scratch(docs.sparkSession) as write:
        found = near_duplicates(docs, radius, id_col, text_col, write)
        rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        kept = materialize(rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("k")).select("k.*").toDF("_id", "_hash", "_n"), "kept")

    def chosen(which: DataFrame) -> DataFrame:
        d = docs.alias("d")
        same = F.col(f"d.{id_col}").eqNullSafe(which["_id"]) & (F.xxhash64(F.col(f"d.{text_col}")).eqNullSafe(which["_hash"]))
        return d.join(by_shuffle(which), same, "left_semi")

    repeated = kept.filter("_n > 1")
    once = chosen(kept.filter("_n = 1"))
    return once if repeated.isEmpty() else once.union(chosen(repeated).dropDuplicates([id_col, text_col]))
