"""Repeated byte strings by a depth-limited radix sort of suffixes inside anchored buckets.

All suffixes that agree in their first ``length`` bytes form an equal group, and the groups of
several suffixes are exactly the repeated windows. A radix sort from the first byte on would
shuffle a row for every byte of the corpus. So suffixes are first dealt to buckets by an anchor:
the least (by hash, leftmost) ``gram`` bytes anywhere in the window. Equal windows have the same
anchor at the same place, and neighbouring windows share theirs, so one row stands for a run of
about 80 suffixes. Runs that agree in the whole text under them are repeated as a body. Where a
bucket has several bodies, their suffixes are sorted by most-significant-digit passes through
``length`` bytes: after each pass suffixes alone with their digits leave, and what is left in the
end are the equal groups. A bucket with many bodies is dealt anew beforehand, by ever more of the
bytes around the anchor, in halves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import by_shuffle, materialize, scratch

#: Bytes of text handled at once in a task; a longer text is handled in overlapping blocks.
BLOCK_BYTES = 1 << 20
#: Bodies that a task remembers so as not to deal a frequent one again and again.
REMEMBERED = 1 << 17
#: Bytes of a digit of the radix passes (a power of two).
DIGIT = 32


@dataclass(frozen=True)
class RepeatRules:
    """Bytes of a repeated string and of its anchor; bodies of an anchor that are sorted in one
    place (beyond, they are dealt anew)."""

    length: int = 200
    gram: int = 32
    group: int = 500


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from every byte on."""
    h, base, width = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while width < gram:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def leftmost_least(values: np.ndarray, window: int) -> np.ndarray:
    """For every window of values, the place of its least value (the leftmost of several)."""
    least, place, width = values, np.arange(len(values), dtype=np.int32), 1

    def merged(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = least[shift:] < least[:-shift]
        return np.where(right, least[shift:], least[:-shift]), np.where(right, place[shift:], place[:-shift])

    while 2 * width <= window:
        least, place = merged(width)
        width *= 2
    return merged(window - width)[1] if window > width else place


def blocks(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, start, end) pieces, gathered to about BLOCK_BYTES; pieces of a text overlap by length - 1."""
    found, total = [], 0
    for i, n in enumerate(sizes):
        for start in range(0, max(1, n - length + 1), BLOCK_BYTES):
            end = min(n, start + BLOCK_BYTES + length - 1)
            if end - start >= length:
                found.append((i, start, end))
                total += end - start
            if total >= BLOCK_BYTES:
                yield found
                found, total = [], 0
    if found:
        yield found


def runs(batches: Iterator[pa.RecordBatch], rules: RepeatRules) -> Iterator[pa.RecordBatch]:
    """Rows (gram, body, known, doc_id, text_hash, start, stop): suffixes start..stop-1 share their anchor.

    ``known``: two runs of this task with the same body went before, which are enough to find it
    repeated; so a body that very many texts have is not dealt to one task as often.
    """
    from xxhash import xxh3_64_intdigest

    length = rules.length
    seen: dict[int, int] = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for pieces in blocks([len(t) for t in texts], length):
            data = b"".join(texts[i][s:e] for i, s, e in pieces)
            hashes = gram_hashes(np.frombuffer(data, np.uint8), rules.gram)
            place = leftmost_least(hashes, length - rules.gram + 1)
            sizes = np.array([e - s for _, s, e in pieces], np.int64)
            offsets = np.cumsum(sizes) - sizes
            counts = sizes - length + 1
            suffixes = np.repeat(offsets - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            digit = place[suffixes]
            new = np.flatnonzero(np.append(True, (np.diff(digit) != 0) | (np.diff(suffixes) != 1)))
            first = suffixes[new]
            stop = suffixes[np.append(new[1:], len(suffixes)) - 1] + 1
            bodies = np.fromiter((xxh3_64_intdigest(data[a : b + length - 1]) for a, b in zip(first.tolist(), stop.tolist())), np.uint64, len(first))
            known = np.zeros(len(first), bool)
            for i, body in enumerate(bodies.tolist()):
                n = seen.get(body, 0)
                if n == 2:
                    known[i] = True
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[body] = n + 1
            piece = np.searchsorted(offsets, first, "right") - 1
            shift = np.array([s for _, s, _ in pieces])[piece] - offsets[piece]
            rows = pa.array(np.array([i for i, _, _ in pieces])[piece])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[digit[new]].view(np.int64)), pa.array(bodies.view(np.int64)), pa.array(known),
                    batch.column("doc_id").take(rows), batch.column("text_hash").take(rows),
                    pa.array((first + shift).astype(np.int32)), pa.array((stop + shift).astype(np.int32)),
                ],
                names=["gram", "body", "known", "doc_id", "text_hash", "start", "stop"],
            )


def repeats(batches: Iterator[pa.RecordBatch], keys: int, alone: bool = False, sure: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first ``keys`` columns: those not alone with the first of them (``alone``:
    all), with two more columns: whether another row agrees in all, and whether it is the first that does.
    Rows whose ``sure`` column is true are known to be repeated, and never the first.

    Rows stream by; one is held back until the next is seen, so no group is gathered.
    """
    held, before = None, None  # the last row, and the row before it

    def judged(batch: pa.RecordBatch, before, after) -> pa.RecordBatch:
        own = [batch.column(i).to_numpy() for i in range(keys)]
        padded = [np.concatenate([[b if b is not None else 0], o, [a if a is not None else 0]]) for o, b, a in zip(own, before or [None] * keys, after or [None] * keys)]
        as_last = np.logical_and.reduce([p[1:-1] == p[:-2] for p in padded])
        as_next = np.logical_and.reduce([p[1:-1] == p[2:] for p in padded])
        first_last, first_next = padded[0][1:-1] == padded[0][:-2], padded[0][1:-1] == padded[0][2:]
        if before is None:
            as_last[0] = first_last[0] = False
        if after is None:
            as_next[-1] = first_next[-1] = False
        told = np.zeros(batch.num_rows, bool) if sure is None else batch.column(sure).to_numpy(zero_copy_only=False)
        arrays = [*batch.columns, pa.array(as_last | as_next | told), pa.array(~as_last & ~told)]
        return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "repeated", "first"]).filter(pa.array(first_last | first_next | told | alone))

    for batch in batches:
        if not batch.num_rows:
            continue
        after = tuple(batch.column(i)[0].as_py() for i in range(keys))
        if held is not None:
            yield judged(held, before, after)
            before = tuple(held.column(i)[held.num_rows - 1].as_py() for i in range(keys))
        head, held_next = batch.slice(0, batch.num_rows - 1), batch.slice(batch.num_rows - 1)
        if head.num_rows:
            yield judged(head, before, tuple(held_next.column(i)[0].as_py() for i in range(keys)))
            before = tuple(head.column(i)[head.num_rows - 1].as_py() for i in range(keys))
        held = held_next
    if held is not None:
        yield judged(held, before, None)


def halves(batches: Iterator[pa.RecordBatch], rules: RepeatRules) -> Iterator[pa.RecordBatch]:
    """Rows (gram, left, right, at, doc_id, text_hash, start, known, body): each body under its next two digits.

    ``gram`` stands for all bytes taken so far: the first digit at ``at`` (-1: not yet found) in
    the body, ``left`` bytes before it and ``right`` bytes after it. Every window that holds these
    holds half of the bytes still free before them, or half of them after: one row for each, with
    the body cut to the windows that do, its digest, and no row where there is no window.
    """
    from xxhash import xxh3_64_intdigest

    signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
    span = rules.length - rules.gram
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            rows, keys, digests, out, bodies = [], [], [], [], []
            for i, (key, left, right, at, start, body) in enumerate(zip(*[part.column(c).to_pylist() for c in ("gram", "left", "right", "at", "start", "body")])):
                if at < 0:
                    at = int(np.argmin(gram_hashes(np.frombuffer(body[: rules.length], np.uint8), rules.gram)))
                half = -(-(span - left - right) // 2)
                for before, after in ((left + half, right), (left, right + half)):
                    lo, hi = max(0, at - span + after), min(len(body), at + rules.length - before)
                    if hi - lo < rules.length:
                        continue
                    digit = b"%d.%d." % (before, after) + body[at - before : at + rules.gram + after]
                    rows.append(i)
                    keys.append(xxh3_64_intdigest(digit, key & (1 << 64) - 1))
                    digests.append(xxh3_64_intdigest(body[lo:hi]))
                    out.append((before, after, at - lo, start + lo))
                    bodies.append(body[lo:hi])
            row = pa.array(rows, pa.int64())
            before, after, place, begin = (pa.array(list(c), pa.int32()) for c in (zip(*out) if out else [[]] * 4))
            yield pa.RecordBatch.from_arrays(
                [signed(keys), signed(digests), before, after, place, part.column("doc_id").take(row), part.column("text_hash").take(row), begin, part.column("known").take(row), pa.array(bodies, pa.binary())],
                names=["gram", "digest", "left", "right", "at", "doc_id", "text_hash", "start", "known", "body"],
            )


def spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, doc_id, text_hash, start, known, body): the text under every run asked for."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            rows, grams, firsts, known, bodies = [], [], [], [], []
            for i, (text, asked) in enumerate(zip(part.column("text"), part.column("asked"))):
                data = text.as_py()
                for r in asked.as_py():
                    rows.append(i)
                    grams.append(r["gram"])
                    firsts.append(r["start"])
                    known.append(r["repeated"])
                    bodies.append(data[r["start"] : r["stop"] + length - 1])
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.int64()), part.column("doc_id").take(row), part.column("text_hash").take(row), pa.array(firsts, pa.int32()), pa.array(known, pa.bool_()), pa.array(bodies, pa.binary())],
                names=["gram", "doc_id", "text_hash", "start", "known", "body"],
            )


def equal_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes that start ``at`` agree with another of their group in ``length`` bytes.

    Most-significant-digit passes: a digit is DIGIT bytes (the last one overlaps the one before), and
    after every pass suffixes that no other agrees with leave. Digits are told apart by 64-bit
    hashes, several to a window.
    """
    width = DIGIT
    while width > length:
        width //= 2
    digits = gram_hashes(data, width)
    for depth in range(0, length, width):
        digit = digits[at + min(depth, length - width)]
        key = (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ digit
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        ids = np.cumsum(new) - 1
        several = np.bincount(ids, minlength=1)[ids] > 1 if len(ids) else new
        at, group = at[order][several], ids[several]
    return at


def shared_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of runs (gram, doc_id, text_hash, start, known, body) sorted by gram, few for each: intervals
    (doc_id, text_hash, lo, hi) of the windows that two have."""

    def sort(grams: np.ndarray, known: np.ndarray, bodies: list[bytes]) -> list[tuple[int, int, int]]:
        sizes = np.array([len(b) for b in bodies], np.int64)
        offsets = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        at = np.repeat(offsets - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        data = np.frombuffer(b"".join(bodies), np.uint8)
        held = np.sort(equal_groups(data, at, np.repeat(grams, counts), length))
        row = np.searchsorted(offsets, held, "right") - 1
        held, row = held[~known[row]], row[~known[row]]
        place = held - offsets[row]
        new = np.append(True, (np.diff(row) != 0) | (np.diff(place) > length))[: len(row)]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
        return list(zip(row[new].tolist(), place[new].tolist(), (place[last] + length).tolist())) if len(row) else []

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in rows.combine_chunks().to_batches():
            found = sort(part.column("gram").to_numpy(), part.column("known").to_numpy(zero_copy_only=False), part.column("body").to_pylist())
            row, lo, hi = (np.array(c, np.int64) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
            start = part.column("start").to_numpy()[row]
            columns = [part.column("doc_id").take(pa.array(row)), part.column("text_hash").take(pa.array(row)), pa.array((start + lo).astype(np.int32)), pa.array((start + hi).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    total = 0
    for whole in batches:
        for first in range(0, whole.num_rows, 1024):
            batch = whole.slice(first, 1024)
            grams = batch.column("gram").to_numpy()
            if total >= BLOCK_BYTES:  # work off all but the last gram, which may go on
                before = held[-1].column("gram")[held[-1].num_rows - 1].as_py()
                change = np.flatnonzero(grams != before)
                if len(change):
                    head, batch = batch.slice(0, int(change[0])), batch.slice(int(change[0]))
                    yield from work(pa.Table.from_batches([*held, head]))
                    held, total = [], 0
            held.append(batch)
            total += batch.column("body").nbytes
    if held:
        yield from work(pa.Table.from_batches(held))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the intervals to remove from each text: adds removed (maximal runs) and kept (bytes)."""
    for batch in batches:
        removed, kept = [], []
        for text, found in zip(batch.column("text"), batch.column("intervals")):
            spans: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in found.as_py() or []):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            data, at, parts = text.as_py(), 0, []
            for lo, hi in spans:
                parts.append(data[at:lo])
                at = hi
            parts.append(data[at:])
            removed.append([{"start": lo, "stop": hi} for lo, hi in spans])
            kept.append(b"".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*[c for c, n in zip(batch.columns, batch.schema.names) if n not in ("text", "intervals")], pa.array(removed, kind), pa.array(kept, pa.binary())],
            names=[*[n for n in batch.schema.names if n not in ("text", "intervals")], "removed", "kept"],
        )


def repeated_intervals(texts: DataFrame, rules: RepeatRules, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(doc_id, text_hash, lo, hi) of bytes that repeated windows cover."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    interval = f"doc_id {kind}, text_hash long, lo int, hi int"
    schema = f"gram long, body long, known boolean, doc_id {kind}, text_hash long, start int, stop int"
    rows = texts.mapInArrow(partial(runs, rules=rules), schema)
    deal = F.when(F.col("known"), F.xxhash64("doc_id", "text_hash", "start")).otherwise(F.col("gram"))
    dealt = rows.repartition(deal).sortWithinPartitions("gram", "body", "known")
    found = write(dealt.mapInArrow(partial(repeats, keys=2, sure="known"), f"{schema}, repeated boolean, first boolean").drop("known"), "runs")
    out = found.filter("repeated").select("doc_id", "text_hash", F.col("start").alias("lo"), (F.col("stop") + rules.length - 1).alias("hi"))
    # one run of every body, where a gram has several bodies
    bodies = found.filter("first").drop("first")
    several = write(bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "grams")
    runs_of = F.collect_list(F.struct("gram", "start", "stop", "repeated")).alias("asked")
    wanted = write(bodies.join(several, "gram").groupBy("doc_id", "text_hash").agg(runs_of), "runs-asked")
    t = texts.alias("t")
    same = F.col("t.doc_id").eqNullSafe(wanted["doc_id"]) & (F.col("t.text_hash") == wanted["text_hash"])
    asked = t.join(by_shuffle(wanted), same).select("t.doc_id", "t.text_hash", "t.text", "asked")
    under = asked.mapInArrow(partial(spans, length=rules.length), f"gram long, doc_id {kind}, text_hash long, start int, known boolean, body binary")
    under = write(under, "bodies")

    def windows(rows: DataFrame) -> DataFrame:
        dealt = rows.select("gram", "doc_id", "text_hash", "start", "known", "body").repartition("gram").sortWithinPartitions("gram")
        return dealt.mapInArrow(partial(shared_windows, length=rules.length), interval)

    few, many = several.filter(F.col("n") <= rules.group).select("gram"), several.filter(F.col("n") > rules.group).select("gram")
    out = out.union(windows(under.join(few, "gram")))
    under = under.join(many, "gram").withColumns({"left": F.lit(0), "right": F.lit(0), "at": F.lit(-1)})
    schema = f"gram long, digest long, left int, right int, at int, doc_id {kind}, text_hash long, start int, known boolean, body binary"
    while not many.isEmpty():  # ends at the latest when all bytes of a window are taken: such bodies are equal
        dealt = under.mapInArrow(partial(halves, rules=rules), schema).repartition("gram", "digest").sortWithinPartitions("gram", "digest")
        found = write(dealt.mapInArrow(partial(repeats, keys=2, alone=True), f"{schema}, repeated boolean, first boolean"), "halves")
        whole = found.filter("repeated and not known")
        out = out.union(whole.select("doc_id", "text_hash", F.col("start").alias("lo"), (F.col("start") + F.octet_length("body")).alias("hi")))
        bodies = found.filter("first").withColumn("known", F.col("known") | F.col("repeated")).drop("repeated", "first")
        several = write(bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "halves-shared")
        out = out.union(windows(bodies.join(several.filter(F.col("n") <= rules.group).select("gram"), "gram")))
        many = several.filter(F.col("n") > rules.group).select("gram")
        under = bodies.join(many, "gram")
    return out


def remove_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (start and stop of maximal runs of bytes) and kept (the bytes left).

    A byte goes if any ``length``-byte string over it also starts elsewhere in the table, the
    same document included. Kept bytes may cut a character in two, so they are binary.

    Cases: a null text is empty. Texts shorter than ``length`` stay whole. Repeated rows repeat
    one another's bytes. A null doc_id is an id like any other. Very long texts are worked
    through in overlapping blocks. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with scratch(docs.sparkSession) as write:
        every = repeated_intervals(texts, rules, write)
        found = materialize(every.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("intervals")), "intervals")
    t = texts.alias("t")
    same = F.col("t.doc_id").eqNullSafe(found["doc_id"]) & (F.col("t.text_hash") == found["text_hash"])
    rows = t.join(by_shuffle(found), same, "left").select("t.doc_id", F.octet_length("t.text").cast("long").alias("n_bytes"), "t.text", "intervals")
    schema = T.StructType([
        *rows.schema.fields[:2],
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("kept", T.BinaryType()),
    ])
    return rows.mapInArrow(cut, schema)
