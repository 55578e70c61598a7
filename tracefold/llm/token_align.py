"""Alignment of two tokenizers over the same bytes.

Space and text are encoded by a byte-level BPE (A) and by a SentencePiece model (B, which adds
the space). A label stands at every byte: nothing, A ends, B ends, or both end. A regular expression takes spans
up to each label of both; the labels inside a span count the tokens of its group, and every
label is one link, an A token and a B token that overlap.

No token of either reaches from a character that is not white space over a following space, so
texts are worked through in chunks cut there. Chunks repeat: each worker keeps the alignment of those
it has seen in a bounded cache. What links count in the whole corpus comes from the distinct
pairs of each document, written once: pairs are summed in the tasks and then by Spark, the most
frequent ones (at most ``hot_pairs``) go back to the tasks by broadcast, all others meet their
documents by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import discard, materialize
from .sentencepiece_codec import SPACE, Codec, ragged

#: How the byte-level tokenizer cuts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks open at a space after what is not white space.
CHUNKS = re.compile(r"(?: *+[^ ]++(?<=[^\S ])(?= ))*+ *+[^ ]++| ++")
OPENING = re.compile(r"(?<=\S)(?= )")
SPAN = re.compile(rb"[^\x03]*\x03")
#: Characters of text handled at once in a task; chunks, their characters and links that a worker remembers.
PART, CACHED_CHUNKS, CACHED_CHARS, CACHED_LINKS = 1 << 18, 1 << 19, 1 << 24, 1 << 22
#: Bits of a B id in a pair of ids packed in one long.
ID_BITS = 24


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the chunks seen. Made once per Python worker."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import tiktoken

        spec = json.loads(a_json)
        vocabulary, letters = spec["model"]["vocab"], byte_of_letter()
        ranks = {bytes(map(letters.__getitem__, word)): i for word, i in vocabulary.items()}
        merged = [vocabulary[("".join(m) if isinstance(m, list) else m.replace(" ", ""))] for m in spec["model"]["merges"]]
        if spec["normalizer"] or merged != sorted(merged):
            raise ValueError("tokenizer A must be byte-level BPE without a normaliser, its merges in the order of their ids")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.a_lengths[i] = len(word)
        self.b = Codec(b_model)
        if not self.b.opening:
            raise ValueError("model B must leave texts as they are but for spaces, which may only open a piece")
        if len(self.b.lengths) >= 1 << ID_BITS:
            raise ValueError("model B has too many pieces")
        # how an id is told inside and at the end of its side of a group, A ids first
        sides = ((len(self.a_lengths), b"|"), (len(self.b.lengths), b";"))
        self.numerals = [b"%d%s" % (i, end) for n, closing in sides for i in range(n) for end in (b",", closing)]
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.chars = self.n_links = 0
        self.texts: list[bytes] = []
        self.links = np.zeros(CACHED_LINKS, np.int64)
        # per chunk: A tokens, B tokens, groups, links, whether its bytes differ, where its links start
        self.sizes = np.zeros((CACHED_CHUNKS, 6), np.int64)

    def align(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The group texts of chunks, their sizes (a row each, as in the cache), and all their links."""
        a_ids = [self.a.encode_ordinary(c) for c in chunks]
        b_ids = self.b.plain.encode([c.replace(" ", SPACE) for c in chunks], num_threads=1)
        told = [c.encode() for c in chunks]
        a_counts, b_counts = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        n_bytes = np.fromiter(map(len, told), np.int64, len(told))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
        wide = self.b.surface_lengths[b]
        b_bytes = np.concatenate([[0], np.cumsum(wide)])[np.cumsum(b_counts)]
        said = self.b.surface_bytes[ragged(self.b.surface_ends[b] - wide, wide)].tobytes()
        differs = np.diff(b_bytes, prepend=0) != n_bytes
        if differs.any() or said != b"".join(told):
            starts = np.concatenate([[0], b_bytes])
            differs = np.array([said[i:j] != t for i, j, t in zip(starts.tolist(), b_bytes.tolist(), told)], bool)
            keep_a, keep_b = ~np.repeat(differs, a_counts), ~np.repeat(differs, b_counts)
            a, b, wide = a[keep_a], b[keep_b], wide[keep_b]
            a_counts, b_counts, n_bytes = (np.where(differs, 0, x) for x in (a_counts, b_counts, n_bytes))
        labels = np.zeros(int(n_bytes.sum()), np.uint8)
        labels[np.cumsum(self.a_lengths[a]) - 1] = 1
        labels[np.cumsum(wide) - 1] |= 2
        ends = np.flatnonzero(labels)
        of_a, of_b = (labels[ends] & 1).astype(np.int64), (labels[ends] >> 1).astype(np.int64)
        links = (a[np.cumsum(of_a) - of_a] << ID_BITS) | b[np.cumsum(of_b) - of_b]
        bounds = np.cumsum(n_bytes)
        upto = np.searchsorted(ends, bounds)  # links and groups that end within each chunk
        n_links = np.diff(upto, prepend=0)
        both = np.cumsum(np.append(0, of_a & of_b))[upto]
        n_groups = np.diff(both, prepend=0)
        spans = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64)) - 1
        # tokens in the order in which they are told: group after group, the A tokens of each before its B tokens
        group_a, group_b = (np.searchsorted(spans, np.flatnonzero(labels & k)) for k in (1, 2))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        codes = np.concatenate([2 * a + last_a, 2 * (b + len(self.a_lengths)) + last_b])[order]
        said = list(map(self.numerals.__getitem__, codes.tolist()))
        last = np.cumsum(a_counts + b_counts)
        texts = [b"".join(said[s:e])[:-1] for s, e in zip((last - a_counts - b_counts).tolist(), last.tolist())]
        return texts, np.stack([a_counts, b_counts, n_groups, n_links, differs, upto - n_links], 1), links

    def known(self, flat: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Group texts, sizes and links of known chunks, and which of them each chunk of a list is."""
        new = list(set(flat).difference(self.cache))
        if new:
            chars = sum(map(len, new))
            texts, sizes, links = self.align(new)
            if len(self.cache) + len(new) > CACHED_CHUNKS or self.chars + chars > CACHED_CHARS or self.n_links + len(links) > CACHED_LINKS:
                self.forget()
                new = list(set(flat))
                chars = sum(map(len, new))
                texts, sizes, links = self.align(new)
                if len(new) > CACHED_CHUNKS or chars > CACHED_CHARS or len(links) > CACHED_LINKS:  # more than can be remembered
                    own = dict(zip(new, range(len(new))))
                    return texts, sizes, links, np.fromiter(map(own.__getitem__, flat), np.int64, len(flat))
            n = len(self.cache)
            self.cache.update(zip(new, range(n, n + len(new))))
            self.texts += texts
            sizes[:, 5] += self.n_links
            self.sizes[n : n + len(new)] = sizes
            self.links[self.n_links : self.n_links + len(links)] = links
            self.n_links += len(links)
            self.chars += chars
        return self.texts, self.sizes, self.links, np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))


def parts(text: str) -> Iterator[str]:
    """Space and text in parts of about PART characters that end where chunks do."""
    text, at = " " + text, 0
    while len(text) - at > PART and (m := OPENING.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first)


NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def aligned(aligner: Aligner, texts: list[str]) -> Iterator[tuple]:
    """For each text: tokens of A and of B, groups, links, the digest of the groups, distinct pairs and their times."""
    held: list[list[str]] = []
    size = 0

    def work() -> Iterator[tuple]:
        told, sizes, links, at = aligner.known(list(chain.from_iterable(held)))
        start = 0
        for chunks in held:
            own = at[start : start + len(chunks)]
            start += len(chunks)
            which, times = np.unique(own, return_counts=True)
            rows = sizes[which]
            places = ragged(rows[:, 5], rows[:, 3])
            pairs, n = summed(links[places], np.repeat(times, rows[:, 3]))
            yield times @ rows[:, :5], b";".join(map(told.__getitem__, own.tolist())), pairs, n

    for text in texts:
        if len(text) >= PART:
            yield from finish(work()) if held else ()
            held, size = [], 0
            sums, digest, pairs, times = np.zeros(5, np.int64), hashlib.sha256(), NOTHING[5], NOTHING[6]
            for k, part in enumerate(parts(text)):
                held = [CHUNKS.findall(part)]
                for n, told, p, t in work():
                    sums += n
                    digest.update(b";" * (k > 0) + told)
                    pairs, times = summed(np.concatenate([pairs, p]), np.concatenate([times, t]))
            held = []
            yield NOTHING if sums[4] else (*sums[:4].tolist(), digest.hexdigest(), pairs, times)
        else:
            held.append(CHUNKS.findall(" " + text) if text else [])
            size += len(text)
            if size >= PART:
                yield from finish(work())
                held, size = [], 0
    if held:
        yield from finish(work())


def finish(found: Iterator[tuple]) -> Iterator[tuple]:
    for sums, told, pairs, times in found:
        yield (*sums[:4].tolist(), hashlib.sha256(told).hexdigest(), pairs, times) if sums[0] and not sums[4] else NOTHING


@lru_cache(1)
def aligner_of(a_json: bytes, b_model: bytes) -> Aligner:
    return Aligner(a_json, b_model)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts or lists are of PART bytes or a little more; a longer one stands alone, whole."""
    values = batch.column(column)
    begin = total = 0
    for i in range(batch.num_rows):
        total += len(values[i].as_buffer())
        if total >= PART << 2 or i + 1 == batch.num_rows:
            yield batch.slice(begin, i + 1 - begin)
            begin, total = i + 1, 0


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else NOTHING[5], pa.int64()))


LONGS = T.ArrayType(T.LongType(), False)
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def document_pairs(docs: DataFrame, a_json: bytes, b_model: bytes, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns (as k0, …) with a row number, the counts, the digest, and the distinct pairs with their times."""
    sent = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    names = [*[f"k{i}" for i in range(len(keep))], "row"]
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names)], F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    made = [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", LONGS), T.StructField("times", LONGS)]
    schema = T.StructType([*rows.schema.fields[:-1], *made])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(*sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                *counts, digests, pairs, times = zip(*aligned(aligner, part.column("text").to_pylist()))
                columns = [*[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), lists(list(pairs)), lists(list(times))]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *columns], names=schema.names)

    return rows.mapInArrow(work, schema)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a batch, their times, and the row each belongs to."""
    pairs, times = batch.column("pairs"), batch.column("times")
    of = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
    return pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False), of


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each pair of ids in the corpus, and whether none of its B id has more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = NOTHING[5], NOTHING[6]
        for batch in batches:
            p, t, _ = flat(batch)
            keys, n = summed(np.concatenate([keys, p]), np.concatenate([n, t]))
            if len(keys) >= CACHED_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                keys, n = NOTHING[5], NOTHING[6]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    total = found.select("pairs", "times").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    most = total.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return total.withColumn("b", b_id).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def hottest(counts: DataFrame, limit: int) -> tuple[float, int]:
    """The least count from which on at most ``limit`` pairs are, found from a histogram of eighths of octaves; and how many pairs there are."""
    step = F.floor(8 * F.log2("n"))
    told = sorted(((r.k, r.c) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    kept, least = 0, float("inf")
    for k, c in told:
        kept += c
        if kept > limit:
            break
        least = k
    return least, sum(c for _, c in told)


def align_documents(
    docs: DataFrame,
    a_json: bytes,
    b_model: bytes,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    hot_pairs: int = 1 << 19,
) -> DataFrame:
    """The kept columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``n_best``: links whose pair is among the most frequent of its B id; ``count_sum``: the corpus counts of
    the pairs of all links, added up. ``groups_sha256``: digest of ``a1,a2|b1;a3|b2`` (ids of the groups in order).
    ``hot_pairs`` bounds what is broadcast (17 bytes each); it changes no result. Both vocabularies go to the
    workers by broadcast (bounded).

    Cases: a text that is null, empty or not spelled alike by both has no tokens: zeros and "".
    Very long texts are worked through whole, in parts; a run without spaces is one chunk. Rows and their
    copies are aligned, and counted, each. An empty table gives no rows. A kept column may not have the name of a
    result (ValueError); other columns do not matter.
    """
    results = [*COUNTS, "n_best", "count_sum", "groups_sha256"]
    if clash := set(keep) & set(results):
        raise ValueError(f"both kept and made: {sorted(clash)}")
    spark, written = docs.sparkSession, []
    found = materialize(document_pairs(docs, a_json, b_model, text_col, keep), "token-links", written)
    counts = materialize(pair_counts(found), "token-pairs", written)
    least, total = hottest(counts, hot_pairs)
    is_hot = F.floor(8 * F.log2("n")) >= F.lit(least)
    hot = counts.filter(is_hot).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast([hot.column(c).to_numpy() for c in ("pair", "n", "best")])
    names = [*[f"k{i}" for i in range(len(keep))], "row", *COUNTS, "groups_sha256"]
    kinds = [f for f in found.schema.fields if f.name in names]
    schema = T.StructType([*kinds, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("pairs", LONGS), T.StructField("times", LONGS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                pairs, times, of = flat(batch)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                hits = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                for out, worth in zip(sums, (best, n)):
                    np.add.at(out, of[hits], times[hits] * worth[at[hits]])
                ends = pa.array(np.append(0, np.cumsum(np.bincount(of[~hits], minlength=batch.num_rows))), pa.int32())
                rest = [pa.ListArray.from_arrays(ends, pa.array(x[~hits])) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, sums), *rest], names=schema.names)

    done = found.mapInArrow(work, schema)
    if total > hot.num_rows:  # what is not broadcast meets its documents by pair; no pair among these is frequent
        done = materialize(done, "token-rest", written)
        one = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
        more = (
            one.join(counts.filter(~is_hot), F.col("pairs") == F.col("pair"))
            .groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
        )
        done = done.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0)),
        })
    out = materialize(done.select(*names[: len(keep)], *results), "aligned").toDF(*keep, *results)
    discard(spark, written)
    return out
