"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a piece of five words or more, about eight as a rule, that ends where the words
around say so: at the least of the words some places to either side, where the last words of
sentences are less than all others. Line ends do not count. So a passage pasted into another
text, even in the middle of a sentence or in short lines, has the same paragraphs inside as
anywhere else. Paragraphs whose MinHashes collide in a band are joined and verified by exact
Jaccard similarity of their five-word shingles; equal paragraphs need no check. Components of the
verified links are clusters. Of a cluster the earliest paragraph stays and the others go, where
repeated paragraphs in a row, or a small gap apart, make up enough words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import by_shuffle, materialize, scratch
from .components import connected_components
from .line_dedup import shared_keys
from .suffix_dedup import repeats

CHUNK_BYTES = 1 << 20
#: Paragraph hashes that a task remembers so as not to send the keys of a frequent paragraph again.
REMEMBERED = 1 << 18
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ENDING = np.isin(np.arange(256), list(b".!?"))


@dataclass(frozen=True)
class ParagraphRules:
    """Shingle width and similarity, bands and rows, and sizes in words.

    ``reach``: words to either side that a paragraph's last word is less than. ``longest``: where no
    word is the least (the same words over and over), a paragraph ends after so many.
    ``gap_words``: a run goes on over so many words that are not repeated, such as a paragraph
    with an edit.

    Five bands of two rows find a pair of similarity 0.8 with probability 0.994, and one of 0.9
    with 0.9998. ``part``: paragraphs of a band's bucket that are compared at once.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 5
    rows: int = 2
    reach: int = 4
    longest: int = 32
    gap_words: int = 16
    min_run_words: int = 16
    part: int = 1000


class Paragraphs:
    """The paragraphs of some texts: joined by line ends, they are cut all at once."""

    def __init__(self, texts: list[bytes], rules: ParagraphRules):
        from xxhash import xxh3_64_intdigest

        data = b"\n".join(texts).lower()
        self.words = data.split()
        raw = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], WHITE[raw], [True]]).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        n = len(self.words)
        self.offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        text_of = np.searchsorted(self.offsets, self.starts, "right") - 1
        last = np.flatnonzero(np.append(text_of[1:] != text_of[:-1], True)[:n]) + 1
        ending = ENDING[raw[self.ends - 1]] if n else np.zeros(0, bool)
        self.word_hashes = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, n)
        stop = self.stops(self.word_hashes >> np.uint64(1) | ~ending * np.uint64(1 << 63), text_of, last, rules)
        start = np.append(0, stop[:-1])[: len(stop)]
        keep = stop - start >= rules.shingle
        self.start, self.stop = start[keep], stop[keep]
        self.text_of = text_of[self.start]

    @staticmethod
    def stops(rank: np.ndarray, text_of: np.ndarray, last: np.ndarray, rules: ParagraphRules) -> np.ndarray:
        """Where paragraphs stop: after the words of least rank around, and at the ends of texts."""
        n = len(rank)
        least = np.ones(n, bool)
        for k in range(1, rules.reach + 1):
            same = text_of[k:] == text_of[:-k]
            least[k:] &= ~same | (rank[k:] < rank[:-k])
            least[:-k] &= ~same | (rank[:-k] <= rank[k:])
        found = np.flatnonzero(least) + 1
        begin, end = np.append(0, last[:-1])[text_index := np.searchsorted(last, found)], last[text_index]
        found = found[(found - begin >= rules.shingle) & (end - found >= rules.shingle)]
        stop = np.union1d(found, last)
        wide = np.diff(stop, prepend=0)
        more = [np.arange(b - w + rules.longest, b - rules.shingle + 1, rules.longest) for b, w in zip(stop[wide > rules.longest].tolist(), wide[wide > rules.longest].tolist())]
        return np.union1d(stop, np.concatenate(more)) if more else stop

    def texts(self) -> list[bytes]:
        return [b" ".join(self.words[a:b]) for a, b in zip(self.start.tolist(), self.stop.tolist())]

    def minhashes(self, rules: ParagraphRules) -> np.ndarray:
        """A row of bands * rows minima per paragraph."""
        word = self.word_hashes
        shingle = np.zeros(max(0, len(word) - rules.shingle + 1), np.uint64)
        for i in range(rules.shingle):
            shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + word[i : i + len(shingle)]
        bounds = np.stack([self.start, self.stop - rules.shingle + 1], axis=1).ravel()
        random = np.random.default_rng(1)
        out = np.empty((len(self.start), rules.bands * rules.rows), np.uint64)
        for k in range(out.shape[1]):
            own = (shingle ^ random.integers(0, 1 << 63, dtype=np.uint64)) * (random.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            own ^= own >> np.uint64(32)
            if len(self.start):
                out[:, k] = np.minimum.reduceat(np.append(own, np.uint64(0)), bounds)[::2]
        return out


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with about CHUNK_BYTES of text; a longer text stands alone, whole."""
    for batch in batches:
        start, total = 0, 0
        for i, text in enumerate(batch.column("text")):
            total += len(text.as_buffer())
            if total >= CHUNK_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0


def hashes(texts: list[bytes]) -> pa.Array:
    from xxhash import xxh3_64_intdigest

    return pa.array(np.fromiter(map(xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64))


def band_keys(batches: Iterator[pa.RecordBatch], rules: ParagraphRules) -> Iterator[pa.RecordBatch]:
    """Rows (key, paragraph), a key for every band; paragraphs that a task has just sent are left out."""
    seen: set[int] = set()
    for batch in chunked(batches):
        found = Paragraphs(batch.column("text").to_pylist(), rules)
        own, at = np.unique(hashes(found.texts()).to_numpy(), return_index=True)
        new = np.fromiter((x not in seen for x in own.tolist()), bool, len(own))
        own, minima = own[new], found.minhashes(rules)[at[new]]
        if len(seen) + len(own) > REMEMBERED:
            seen.clear()
        seen.update(own.tolist())
        keys = []
        for b in range(rules.bands):
            key = np.full(len(own), b + 1, np.uint64)
            for r in range(rules.rows):
                key = (key ^ minima[:, b * rules.rows + r]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            keys.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.tile(own, rules.bands))], names=["key", "paragraph"]
        )


def paragraph_texts(batches: Iterator[pa.RecordBatch], rules: ParagraphRules) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches):
        texts = Paragraphs(batch.column("text").to_pylist(), rules).texts()
        yield pa.RecordBatch.from_arrays([hashes(texts), pa.array(texts, pa.binary())], names=["paragraph", "words"])


def places(batches: Iterator[pa.RecordBatch], rules: ParagraphRules) -> Iterator[pa.RecordBatch]:
    """Rows (paragraph, doc_id, text_hash, number, start, stop, n_words); start and stop are bytes of the text."""
    for batch in chunked(batches):
        p = Paragraphs(batch.column("text").to_pylist(), rules)
        number = p.start - p.start[np.searchsorted(p.text_of, p.text_of)] if len(p.start) else p.start
        shift = p.offsets[p.text_of]
        rows = pa.array(p.text_of)
        yield pa.RecordBatch.from_arrays(
            [
                hashes(p.texts()), batch.column("doc_id").take(rows), batch.column("text_hash").take(rows),
                pa.array(number.astype(np.int32)), pa.array((p.starts[p.start] - shift).astype(np.int32)) if len(p.start) else pa.array([], pa.int32()),
                pa.array((p.ends[p.stop - 1] - shift).astype(np.int32)) if len(p.start) else pa.array([], pa.int32()),
                pa.array((p.stop - p.start).astype(np.int32)),
            ],
            names=["paragraph", "doc_id", "text_hash", "number", "start", "stop", "n_words"],
        )


def verify(batches: Iterator[pa.RecordBatch], rules: ParagraphRules) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, away, paragraph, words): links of a spanning forest of each part and what passes it."""

    def shingles(words: bytes) -> set:
        w = words.split(b" ")
        return set(zip(*[w[i:] for i in range(rules.shingle)]))

    def similar(a: set, b: set) -> bool:
        if min(len(a), len(b)) < rules.similarity * max(len(a), len(b)):
            return False
        both = len(a & b)
        return both >= rules.similarity * (len(a) + len(b) - both)

    # trees of linked paragraphs: in a family of near copies the first of a tree mostly decides
    at, trees = None, []
    for batch in batches:
        out: list[tuple[int, int]] = []
        for key, part, away, paragraph, words in zip(*[c.to_pylist() for c in batch.columns]):
            if (key, part) != at:
                at, trees = (key, part), []
            own = shingles(words)
            met = [(t, other) for t in trees if (other := next((p for p, theirs in t if similar(own, theirs)), None)) is not None]
            out += [(paragraph, other) for _, other in met]
            if met:
                whole = max((t for t, _ in met), key=len)
                for t, _ in met:
                    if t is not whole:
                        whole += t
                        trees = [x for x in trees if x is not t]
                if not away:
                    whole.append((paragraph, own))
            elif not away:
                trees.append([(paragraph, own)])
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def near_links(texts: DataFrame, rules: ParagraphRules, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links (a, b) between the hashes of different paragraphs that are similar enough."""
    kind = "key long, paragraph long"
    keyed = texts.select("text").mapInArrow(partial(band_keys, rules=rules), kind)
    dealt = keyed.repartition("key").sortWithinPartitions("key", "paragraph")
    shared = write(dealt.mapInArrow(partial(shared_keys, roles=False), kind), "band-keys")
    wanted = write(shared.select("paragraph").distinct(), "paragraphs-wanted")
    every = texts.select("text").mapInArrow(partial(paragraph_texts, rules=rules), "paragraph long, words binary")
    words = write(every.join(by_shuffle(wanted), "paragraph").groupBy("paragraph").agg(F.first("words").alias("words")), "paragraph-words")
    sizes = shared.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / rules.part).cast("int").alias("parts"))
    dealt = shared.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("paragraph"), "parts").cast("int")).join(words, "paragraph")
    home = dealt.select("key", "part", F.lit(0).alias("away"), "paragraph", "words")
    later = dealt.filter("part + 1 < parts").select("key", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), F.lit(1).alias("away"), "paragraph", "words")
    met = home.union(later).repartition("key", "part").sortWithinPartitions("key", "part", "away")
    return met.mapInArrow(partial(verify, rules=rules), "a long, b long")


def repeated_paragraphs(docs: DataFrame, rules: ParagraphRules = ParagraphRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each repeated paragraph: doc_id, text_hash, number (its first word's place,
    counted from the text's first paragraph), start and stop (bytes), n_words, run_words (of repeated paragraphs in
    a row, or ``gap_words`` apart at most), cluster_id (doc_id of the paragraph that stays), members and kept.

    Rows are given only where the run has ``min_run_words`` words or more, so a short
    line that many documents share is left alone.

    Cases: null and empty texts have no paragraphs; neither have those of fewer words than a
    shingle. Words are compared in lower case (A-Z). A document that is repeated whole, id
    and all, counts once. Of equal doc_ids the text hash decides which is earlier; null doc_ids
    are earliest. A very long text is cut whole. Paragraphs are told apart by a 64-bit hash. Empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"paragraph long, doc_id {kind}, text_hash long, number int, start int, stop int, n_words int"
    with scratch(docs.sparkSession) as write:
        components = write(connected_components(write(near_links(texts, rules, write), "paragraph-links"), write), "paragraph-components")
        found = texts.mapInArrow(partial(places, rules=rules), schema)
        # a row for every linked paragraph keeps its places from being alone
        marks = components.select(F.col("node").alias("paragraph"), *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes[1:]])
        sorted_rows = found.union(marks).repartition("paragraph").sortWithinPartitions("paragraph")
        several = sorted_rows.mapInArrow(partial(repeats, keys=1), f"{schema}, repeated boolean, first boolean")
        several = write(several.filter("n_words is not null").drop("repeated", "first").distinct(), "paragraph-places")
        place = F.struct("doc_id", "text_hash", "number")
        # places are counted by paragraph and then by cluster before they meet their cluster
        by_paragraph = several.groupBy("paragraph").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("members"))
        rooted = by_paragraph.join(components.withColumnRenamed("node", "paragraph"), "paragraph", "left").withColumn("root", F.coalesce("root", "paragraph"))
        clusters = rooted.groupBy("root").agg(F.min("earliest").alias("earliest"), F.sum("members").alias("members")).filter("members > 1")
        told = write(rooted.select("paragraph", "root").join(clusters, "root").drop("root"), "paragraph-clusters")
        member = several.join(told, "paragraph")
        by_doc = Window.partitionBy("doc_id", "text_hash")
        new_run = F.coalesce(F.col("number") - F.lag(F.col("number") + F.col("n_words")).over(by_doc.orderBy("number")) > rules.gap_words, F.lit(True))
        runs = member.withColumn("new_run", new_run).withColumn("run", F.sum(F.col("new_run").cast("int")).over(by_doc.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)))
        rows = (
            runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "text_hash", "run")))
            .filter(F.col("run_words") >= rules.min_run_words)
            .select(
                "doc_id", "text_hash", "number", "start", "stop", "n_words", "run_words",
                F.col("earliest.doc_id").alias("cluster_id"), "members", (place == F.col("earliest")).alias("kept"),
            )
        )
        return materialize(rows, "paragraphs")


def remove_paragraphs(docs: DataFrame, rules: ParagraphRules = ParagraphRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the bytes of repeated paragraphs that go (paragraphs end between characters).

    Cases are those of :func:`repeated_paragraphs`. Every row stays, and all columns, whatever their
    names; a null text stays null, and copies of a row are cut alike.
    """
    gone = repeated_paragraphs(docs, rules, id_col, text_col).filter("not kept")
    spans = F.array_sort(F.collect_list(F.struct("start", "stop")))
    by_doc = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(spans.alias("_spans"))
    d = docs.alias("d")
    text = F.col(f"d.{text_col}")
    raw = F.encode(text, "UTF-8")
    same = F.col(f"d.{id_col}").eqNullSafe(by_doc["_id"]) & (F.xxhash64(text) == by_doc["_hash"])
    cuts = by_doc["_spans"]
    ends = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.octet_length(text)))
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["stop"]))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")), "")
    return d.join(by_shuffle(by_doc), same, "left").select(*[F.when(cuts.isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"d.{c}") for c in docs.columns])
