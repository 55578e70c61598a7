"""Line dedup by a segment-partition edit join.

A line is dropped where an equal line, or one within a few word edits, stands earlier in the
corpus (by doc_id, then line). An edit inserts, deletes or replaces a word, so a changed number,
date or name is one edit whatever its length; how many are allowed grows with the line. Of two
lines within ``k`` edits, the shorter one split into k + 1 segments keeps a segment whole in the
other, near its place. So every distinct line is indexed under its segments and probes with the
runs of words where a segment of a line of its own or a little smaller length can lie. Lines that
meet under a key are verified by banded bit-parallel edit distance.

Lines under a key are compared pair by pair only while they are few. Beyond that the matched
segment is taken out and what is left is split into segments once more, which deals the lines
to finer keys; this repeats until no key holds many.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_shuffle, let, materialize, scratch

#: Words; in scripts that are written without spaces (Thai, kana, Han) every character is one.
ALONE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
UNIT = re.compile(f"[{ALONE}]|[^\\x20\\x09-\\x0D{ALONE}]+")
SPACELESS = re.compile(f"[{ALONE}]")
#: Line hashes, and word hashes, that a task remembers so as not to send the keys of a frequent line again.
REMEMBERED = 1 << 17


def units(text: str) -> list[bytes]:
    """The words of a line. Splitting bytes splits at space and the controls from tab to carriage return only."""
    return [u.encode() for u in UNIT.findall(text)] if SPACELESS.search(text) else text.encode().split()


class Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64: what hashes of runs are made of."""

    base = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def runs(self, values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of starts and ends: the polynomials of the values between, all from one running sum."""
        if len(self.up) <= len(values):
            n = 2 * len(values) + 1
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(self.base))), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(pow(self.base, -1, 1 << 64)))), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(values * self.down[: len(values)], dtype=np.uint64))
        return lambda start, end: (sums[end] - sums[start]) * self.up[start]


WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class LineRules:
    """An edit is allowed for every ``words_per_edit`` words of the shorter line, ``most_edits`` at most
    (a larger number multiplies the keys: 4, 12, 26, 49 a line for 1, 2, 3, 4). A shorter line is
    dropped only where it is equal. ``bucket``: lines under a key that are compared with one another,
    if they have no more than 64 times as many words.
    """

    words_per_edit: int = 10
    most_edits: int = 2
    bucket: int = 3000

    def edits(self, length: int) -> int:
        return min(self.most_edits, length // self.words_per_edit)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and width of ``parts`` segments of near equal width; the last are the longer ones."""
    width, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        own = width + (i >= parts - longer)
        out.append((at, own))
        at += own
    return out


def index_places(length: int, distance: int) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, width) under which a text of this length is indexed.

    A text of no more words than edits has no segment to match: all such texts meet under
    one key (segment -1).
    """
    if length <= distance:
        return [(length, -1, 0, 0)]
    return [(length, i, at, width) for i, (at, width) in enumerate(segments(length, distance + 1))]


def probe_places(length: int, distance: int, short: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, width) of the runs that can match a segment of a text of ``short`` words."""
    if short <= distance:
        return [(short, -1, 0, 0)]
    out, gap = [], length - short
    for i, (at, width) in enumerate(segments(short, distance + 1)):
        low = max(0, at - i, at + gap - (distance - i))
        high = min(length - width, at + i, at + gap + (distance - i))
        out += [(short, i, start, width) for start in range(low, high + 1)]
    return out


def edits_within(a: Sequence, b: Sequence, limit: int) -> bool:
    """Whether two sequences are within ``limit`` edits: bit-parallel over a diagonal band.

    Common ends are taken off first. Each state set holds one bit per diagonal that can still
    be reached; a step over a character moves all diagonals at once.
    """
    if abs(len(a) - len(b)) > limit:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # length of the common start, by halves
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return max(len(a), len(b)) <= limit
    # bit d of states[k]: a[:i] and b[:i + d - limit] are within k edits
    band = (1 << (2 * limit + 1)) - 1
    states = [((1 << (k + 1)) - 1) << limit & band for k in range(limit + 1)]
    for i, c in enumerate(a):
        equal = 0
        for d in range(2 * limit + 1):
            j = i + d - limit
            equal |= (0 <= j < len(b) and b[j] == c) << d
        before, new = states, []
        for k in range(limit + 1):
            now = before[k] & equal
            if k:
                now |= before[k - 1] | before[k - 1] >> 1 | new[k - 1] << 1
            new.append(now & band)
        states = new
        if not states[limit]:
            return False
    end = len(b) - len(a) + limit
    return bool(states[limit] >> end & 1)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of all lines that hold a word."""
    lines = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode_outer(F.split(text_col, "\n")).alias("line_no", "line")
    )
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


#: What a line is under a key: a line's own segment, a probe, or both; raised by LAST where nothing is left to split.
OWN, PROBE, BOTH, LAST = 0, 1, 2, 4
#: Bits of the number of edits; above them stands the number of words of the line.
EDIT_BITS = 8


@lru_cache(4096)
def first_places(length: int, rules: LineRules) -> tuple[np.ndarray, ...]:
    """Salt, start, width, role, edits and what is left of the indexed line, of all keys of a line."""
    own = rules.edits(length)
    mine = index_places(length, own) if own else []
    rows = [(*p, BOTH, own) for p in mine]  # an own segment is also the probe for lines of the same length
    for short in range(max(0, length - rules.most_edits), length + 1):
        k = rules.edits(short)
        if k and length - short <= k:
            rows += [(*p, PROBE, k) for p in probe_places(length, k, short) if p not in mine]
    short, segment, start, width, role, edits = np.array(rows, np.int64).reshape(-1, 6).T
    return (short * 64 + segment).astype(np.uint64), start, width, role.astype(np.int32), (edits | length << EDIT_BITS).astype(np.int32), (short - width).astype(np.int32)


def mixed(key: np.ndarray) -> np.ndarray:
    key = (key ^ key >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ key >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return key ^ key >> np.uint64(31)


def first_keys(batches: Iterator[pa.RecordBatch], rules: LineRules, rest: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, line_hash, role, edits) of lines.

    With ``rest`` also the words that the key leaves of the line, and how many it leaves of the
    indexed line. A run of words is hashed as a polynomial of its words' hashes, so that all runs
    of a batch come from one running sum.
    """
    seen: set[int] = set()
    powers, word_powers = Powers(), Powers()
    for whole in batches:
        for first in range(0, whole.num_rows, 4096):
            batch = whole.slice(first, 4096)
            lines, hashes = [], []
            for line, text in zip(batch.column("line_hash").to_pylist(), batch.column("line").to_pylist()):
                if line in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(line)
                lines.append(b" ".join(units(text)) if SPACELESS.search(text) else text.encode())
                hashes.append(line)
            if not lines:
                continue
            raw = np.frombuffer(b"\n".join(lines), np.uint8)
            edges = np.flatnonzero(np.diff(np.concatenate([[True], WHITE[raw], [True]]).astype(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            begins = np.cumsum([0, *[len(x) + 1 for x in lines[:-1]]])
            sizes = np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=len(lines))
            offsets = np.cumsum(sizes) - sizes
            words = mixed(powers.runs(raw.astype(np.uint64) + np.uint64(1))(starts, ends))
            run_of = word_powers.runs(words)
            hashes, out, left = np.array(hashes, np.int64), [], []
            for n in np.unique(sizes[sizes >= rules.words_per_edit]):
                at = np.flatnonzero(sizes == n)
                salt, start, width, role, edits, length = first_places(int(n), rules)
                begin = offsets[at][:, None] + start
                run = run_of(begin, begin + width)
                key = mixed(run ^ mixed(np.broadcast_to(salt * np.uint64(Powers.base), run.shape)))
                out.append((key.ravel().view(np.int64), np.repeat(hashes[at], len(salt)), np.tile(role, len(at)), np.tile(edits, len(at)), np.tile(length, len(at))))
                if rest:
                    places = list(zip(start.tolist(), (start + width).tolist()))
                    left += [b" ".join(w[:b] + w[e:]).decode() for w in (lines[i].split() for i in at.tolist()) for b, e in places]
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
            columns = [pa.array(np.concatenate(c)) for c in zip(*out)] if out else [pa.array(np.zeros(0, t)) for t in kinds]
            names = ["key", "line_hash", "role", "edits", "length", "text"]
            columns = [*columns, pa.array(left, pa.string())] if rest else columns[:4]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])


def split_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seed, line_hash, role, edits, length, text): the keys of what is left of lines, and what each leaves."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        keys, rows, roles, texts = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("seed", "role", "edits", "length", "text")]
        for i, (seed, role, edits, length, text) in enumerate(zip(*columns)):
            words = text.split(" ") if text else []
            n, k = len(words), edits & (1 << EDIT_BITS) - 1
            mine = index_places(n, k) if role != PROBE else []
            places = [(p, role) for p in mine]
            if role != OWN:
                places += [(p, PROBE) for p in probe_places(n, k, length) if p not in mine]
            for (short, part, at, width), own in places:
                keys.append(xxh64_intdigest(f"{short}.{part}.{' '.join(words[at:at + width])}", seed & (1 << 64) - 1))
                rows.append(i)
                roles.append(own if part >= 0 else own + LAST)
                texts.append((short - width, " ".join(words[:at] + words[at + width :])))
        row = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column("line_hash").take(row), pa.array(roles, pa.int32()),
                batch.column("edits").take(row), pa.array([n for n, _ in texts], pa.int32()), pa.array([t for _, t in texts], pa.string()),
            ],
            names=["key", "line_hash", "role", "edits", "length", "text"],
        )


def shared_keys(batches: Iterator[pa.RecordBatch], roles: bool = True) -> Iterator[pa.RecordBatch]:
    """Of rows (key, line_hash, role, …; ``roles`` False: key, line_hash) in this order, those whose key several lines have; repeats go."""
    held: pa.RecordBatch | None = None  # rows of the last key, of one line so far
    shared = None  # the last key, once several lines had it
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        key, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        starts = np.flatnonzero(np.append(True, np.diff(key) != 0))
        several = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
        several |= key[starts] == shared if shared is not None else False
        new = np.append(True, (np.diff(key) != 0) | (np.diff(line) != 0))
        if roles:
            new[1:] |= np.diff(batch.column(2).to_numpy()) != 0
        keep = np.repeat(several, np.diff(np.append(starts, len(key)))) & new
        last = starts[-1]
        shared = key[last] if several[-1] else None
        held = None if several[-1] else batch.slice(last).take(pa.array(np.flatnonzero(new[last:])))
        yield batch.filter(pa.array(keep))


#: Lines that are compared at once, without matrices; and words whose columns are multiplied at once.
FEW, WORDS = 16, 2048


def later_ones(lines: list[list[bytes]], rules: LineRules) -> list[int]:
    """Of lines (as words) in their order, those that have an earlier one within the distance.

    Two lines within k edits have all but k of the longer one's words in common. How many any two have
    is a product of matrices of what each holds (a word's second occurrence is another word), added up over some
    words at a time, so memory is bounded by the lines alone; only pairs that have enough are compared word by word, until one fits.
    """
    n = len(lines)
    if n <= FEW:
        fits = lambda a, b: edits_within(a, b, rules.edits(min(len(a), len(b))))
        return [i for i in range(1, n) if any(fits(lines[i], lines[j]) for j in range(i))]
    sizes = np.array([len(x) for x in lines], np.int64)
    allowed = np.minimum(rules.most_edits, sizes // rules.words_per_edit)
    ids: dict[tuple[bytes, int], int] = {}
    rows, columns = [], []
    for i, words in enumerate(lines):
        times: dict[bytes, int] = {}
        for w in words:
            times[w] = times.get(w, 0) + 1
            columns.append(ids.setdefault((w, times[w]), len(ids)))
        rows += [i] * len(words)
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    in_lines = np.bincount(columns, minlength=1)
    everywhere = int((in_lines == n).sum())
    telling = (in_lines > 1) & (in_lines < n)
    place = np.cumsum(telling) - 1
    keep = telling[columns]
    rows, columns = rows[keep], place[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    found = []
    common = np.full((n, n), everywhere, np.float32)
    for word in range(0, int(telling.sum()), WORDS):
        some = slice(*np.searchsorted(columns, (word, word + WORDS)))
        held = np.zeros((n, WORDS), np.float32)
        held[rows[some], columns[some] - word] = 1
        for first in range(0, n, 256):
            last = min(n, first + 256)
            common[first:last, :last] += held[first:last] @ held[:last].T
    for first in range(0, n, 256):
        last = min(n, first + 256)
        most = np.minimum(allowed[first:last, None], allowed[None, :last])
        near = (common[first:last, :last] + 0.5 >= np.maximum(sizes[first:last, None], sizes[None, :last]) - most) & (np.abs(sizes[first:last, None] - sizes[None, :last]) <= most)
        near &= np.arange(last)[None] < np.arange(first, last)[:, None]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            if any(edits_within(lines[first + i], lines[j], int(most[i, j])) for j in np.flatnonzero(near[i]).tolist()):
                found.append(first + i)
    return found


def verify(batches: Iterator[pa.RecordBatch], rules: LineRules) -> Iterator[pa.RecordBatch]:
    """Rows (key, line_hash, doc_id, text_hash, line_no, line) by key: line_hash of the lines with an earlier one within the distance."""

    def bucket(rows: list) -> list[int]:
        place = lambda r: (() if r[2] is None else (r[2],), *r[3:5])  # noqa: E731  a null id is earliest
        told = sorted({r[1]: (place(r), r[1], r[5]) for r in rows}.values(), key=lambda t: t[0])
        return [told[i][1] for i in later_ones([units(t[2]) for t in told], rules)] if len(told) > 1 else []

    at, rows = None, []
    for batch in batches:
        out: list[int] = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != at:
                out += bucket(rows)
                at, rows = row[0], []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["line_hash"])
    yield pa.RecordBatch.from_arrays([pa.array(bucket(rows), pa.int64())], names=["line_hash"])


KEYED = "key long, line_hash long, role int, edits int"
PLACE = ("doc_id", "text_hash", "line_no")


def with_shared_keys(rows: DataFrame, schema: str) -> DataFrame:
    """The rows whose key several lines have; they stream by, sorted, and none are gathered."""
    return rows.repartition("key").sortWithinPartitions("key", "line_hash", "role").mapInArrow(shared_keys, schema)


def later_of_last(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """Under a key with nothing left to split all lines are within the distance: all but the earliest go."""
    probe, own = (F.col("role").isin(LAST + r, LAST + BOTH) for r in (PROBE, OWN))
    rows = keyed.filter(F.col("role") >= LAST).join(firsts, "line_hash").select("key", "role", "line_hash", F.struct(*PLACE).alias("place"))
    least = rows.groupBy("key").agg(F.min(F.when(probe, F.col("place"))).alias("probe"), F.min(F.when(own, F.col("place"))).alias("own"))
    later = (probe & (F.col("place") > F.col("own"))) | (own & (F.col("place") > F.col("probe")))
    return rows.join(least, "key").filter(later).select("line_hash")


def near_lines(lines: DataFrame, firsts: DataFrame, rules: LineRules, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """line_hash of every line of ``lines(line_hash, line)`` that has an earlier one within the distance."""
    keyed = write(with_shared_keys(lines.mapInArrow(partial(first_keys, rules=rules), KEYED), KEYED), "line-keys")
    wanted = write(keyed.select("line_hash").distinct().join(firsts, "line_hash"), "lines-wanted")
    texts = write(lines.join(by_shuffle(wanted), "line_hash").groupBy("line_hash", *PLACE).agg(F.first("line").alias("line")), "line-texts")
    rest, found = None, []
    while True:
        words = F.sum(F.shiftright("edits", EDIT_BITS))
        small = (F.count(F.lit(1)) <= rules.bucket) & (words <= 64 * rules.bucket)
        told = keyed.groupBy("key").agg((F.max("role") >= LAST).alias("last"), small.alias("small"))
        few = told.filter("small and not last").select("key")
        pairs = keyed.join(few, "key").join(texts, "line_hash").select("key", "line_hash", *PLACE, "line")
        later = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(partial(verify, rules=rules), "line_hash long")
        if rest is not None:
            later = later.union(later_of_last(keyed, firsts))
        found.append(write(later.distinct(), "later-lines"))
        many = write(told.filter("not small and not last").select("key"), "hot-keys")
        if many.isEmpty():
            return reduce(DataFrame.union, found).distinct()
        if rest is None:  # what the first keys leave of the lines
            hot = keyed.join(many, "key").select("line_hash").distinct().join(texts, "line_hash").select("line_hash", "line")
            rest = hot.mapInArrow(partial(first_keys, rules=rules, rest=True), f"{KEYED}, length int, text string")
        split = rest.join(many, "key").select(F.col("key").alias("seed"), "line_hash", "role", "edits", "length", "text")
        rest = write(split.mapInArrow(split_again, f"{KEYED}, length int, text string").distinct(), "hot-lines")
        keyed = write(with_shared_keys(rest.select("key", "line_hash", "role", "edits"), KEYED), "line-keys")


def dropped_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, equal, near): per document the numbers of the lines that go."""
    lines = lines_of(docs, id_col, text_col).withColumn("line_hash", F.xxhash64("line"))
    with scratch(docs.sparkSession) as write:
        seen = write(lines.drop("line"), "lines")
        firsts = write(seen.groupBy("line_hash").agg(F.min(F.struct(*PLACE)).alias("p")).select("line_hash", "p.*"), "first-lines")
        near = near_lines(lines.select("line_hash", "line"), firsts, rules, write).withColumn("near", F.lit(True))
        first = firsts.select("line_hash", F.struct(*PLACE).alias("first")).join(near, "line_hash", "left")
        judged = seen.join(first, "line_hash").withColumn("equal", F.struct(*PLACE) != F.col("first"))
        gone = judged.filter(F.col("equal") | F.col("near"))
        which = lambda c: F.collect_set(F.when(c, F.col("line_no")))
        by_doc = gone.groupBy("doc_id", "text_hash").agg(which(F.col("equal")).alias("equal"), which(~F.col("equal")).alias("near"))
        return materialize(by_doc, "dropped-lines")


def dedup_lines(
    docs: DataFrame,
    rules: LineRules = LineRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str, str] | None = ("n_lines", "n_equal", "n_near"),
) -> DataFrame:
    """``docs`` with the text that is left and, under the names in ``counts``, the numbers of lines
    before, of equal lines dropped and of near lines dropped.

    Lines end at \\n. Lines without a word always stay; lines of few words go only where they are
    equal. What is left keeps its order; a document may be left with an empty text.

    Cases: a null text stays null and has no lines; an empty text has one empty line. Repeated
    rows (same doc_id and text) count as one document and are cut alike. Of equal doc_ids the text
    hash decides which line is earlier; null doc_ids are earliest. Lines are told apart by a 64-bit
    hash. A very long line is compared whole. An empty table gives no rows. Extra columns stay as
    they are, whatever their names; one that has a name of ``counts`` is an error (ValueError): give
    other names.
    """
    if clash := set(counts or ()) & set(docs.columns):
        raise ValueError(f"the table has columns {sorted(clash)}; give other names for the counts")
    gone = dropped_lines(docs, rules, id_col, text_col).toDF("_id", "_hash", "_equal", "_near")
    d = docs.alias("d")
    text = F.col(f"d.{text_col}")
    same = F.col(f"d.{id_col}").eqNullSafe(gone["_id"]) & (F.xxhash64(text) == gone["_hash"])

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.array_union(gone["_equal"], gone["_near"]))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    kept = F.when(gone["_equal"].isNull(), text).otherwise(let(F.split(text, "\n"), left))
    number = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long")
    told = [F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long"), number(gone["_equal"]), number(gone["_near"])]
    return d.join(by_shuffle(gone), same, "left").select(
        *[kept.alias(text_col) if c == text_col else F.col(f"d.{c}") for c in docs.columns],
        *[c.alias(n) for c, n in zip(told, counts or ())],
    )
