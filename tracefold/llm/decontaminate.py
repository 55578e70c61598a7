"""Benchmark decontamination by SimHash windows of item size.

A window with a shingle similarity of at least ``similarity`` to an item holds at least that
share of benchmark shingles, so only windows that do are fingerprinted (nothing is lost by
this). Every fingerprint within ``radius`` bits of an item's agrees with it, in at least one
of four 16-bit blocks, up to a quarter of the radius: items are indexed under all such block
values, windows look up their own. The pairs found are verified exactly: shingles weigh as
often as they occur, and similarity is the weight of the intersection over that of the union.
Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_shuffle, let, materialize, scratch, words

BLOCKS, BLOCK_BITS = 4, 16


@dataclass(frozen=True)
class LeakRules:
    """Words in a shingle, least similarity, and the radius of fingerprints.

    An item of fewer words than a shingle is one shingle of its own size, and is found where its words
    stand in a row. A one-word item stands in very many documents: ``least_words`` can leave such
    items out.

    At a similarity of 0.8 two fingerprints differ in about 10 bits, with a standard
    deviation of 3; a radius of 15 loses few of the pairs at the limit and none of the copies.
    """

    shingle: int = 5
    similarity: float = 0.8
    radius: int = 15
    least_words: int = 1


def plain_words(text: Column) -> Column:
    """Words in lower case without punctuation."""
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", ""))


def shingle_hashes(text: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` plain words; none for a shorter text."""
    def of(tokens: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)])
        every = F.transform(F.sequence(F.lit(0), F.size(tokens) - width), one)
        return F.when(F.size(tokens) >= width, every).otherwise(F.array().cast("array<bigint>"))

    return let(plain_words(text), of)


def simhash(shingles: Column) -> Column:
    """64 bits, each set where over half of the hashes have it."""
    bit = lambda h, b: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long"))
    votes = lambda b: F.aggregate(shingles, F.lit(0).cast("long"), lambda a, h: a + bit(h, b))
    one = lambda b: F.when(2 * votes(b) > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), one), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def numbered(shingles: Column) -> Column:
    """Each hash with its number among equal ones, as a set: intersections then count repeats."""
    order = F.array_sort(shingles)
    return F.transform(order, lambda h, i: F.xxhash64(h, i - F.array_position(order, h)))


def blocks(fp: Column) -> Column:
    """(number, value) of the four blocks of a fingerprint."""
    value = lambda i: F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("block"), value(i).alias("value")) for i in range(BLOCKS)])


def prepare_items(items: DataFrame, rules: LeakRules, item_col: str, text_col: str, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """item_id, length (words), unit (words of a shingle), shingles, item_fp and item_set."""
    text = F.col(text_col)
    tokens = items.select(F.col(item_col).alias("item_id"), plain_words(text).alias("tokens"), shingle_hashes(text, rules.shingle).alias("long"))
    n, short = F.size("tokens"), F.col("long")
    for width in range(1, rules.shingle):
        short = F.when(F.size("tokens") == width, F.array(F.xxhash64(*[F.get("tokens", F.lit(k)) for k in range(width)]))).otherwise(short)
    rows = tokens.filter(n >= max(1, rules.least_words)).select("item_id", n.alias("length"), F.least(n, F.lit(rules.shingle)).alias("unit"), short.alias("shingles"))
    rows = write(rows, "item-texts")
    return write(rows.withColumns({"item_fp": simhash(F.col("shingles")), "item_set": numbered(F.col("shingles"))}), "items")


def likely_windows(docs: DataFrame, items: DataFrame, rules: LeakRules, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(doc_id, text_hash, windows): item-sized windows that hold enough benchmark shingles.

    The outer explode keeps the optimizer from deriving a filter that computes the shingles again.
    """
    whole = items.filter(F.col("unit") == rules.shingle)
    wanted = write(whole.select(F.explode("shingles").alias("h"), "length").distinct(), "item-shingles")
    n = (F.size("shingles") + rules.shingle - 1).alias("n")
    places = docs.select("doc_id", "text_hash", n, F.posexplode_outer("shingles").alias("place", "h"))
    hits = places.join(wanted, "h").select("doc_id", "text_hash", "n", "place", "length").distinct()
    wide = F.least("length", "n")
    first = F.greatest(F.lit(0), F.col("place") - wide + rules.shingle)
    last = F.least(F.col("place"), F.col("n") - wide)
    least = F.ceil(rules.similarity * (wide - rules.shingle + 1))
    return (
        hits.withColumn("start", F.explode(F.sequence(first, last)))
        .groupBy("doc_id", "text_hash", "start", wide.alias("width"))
        .agg(F.count_distinct("place").alias("held"), F.first(least).alias("least"))
        .filter("held >= least")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "width")).alias("windows"))
    )


def short_windows(docs: DataFrame, items: DataFrame, rules: LeakRules, id_col: str, text_col: str) -> list[DataFrame]:
    """(doc_id, text_hash, start, width, shingles) of the words of items shorter than a shingle, a table for each width there is."""
    short = items.filter(F.col("unit") < rules.shingle)
    found = []
    for (width,) in short.select("unit").distinct().collect():  # fewer than a shingle's words
        hashes = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(shingle_hashes(F.col(text_col), width)).alias("start", "h"))
        wanted = short.filter(F.col("unit") == width).select(F.get("shingles", F.lit(0)).alias("h")).distinct()
        found.append(hashes.join(wanted, "h", "left_semi").distinct().select("doc_id", "text_hash", "start", F.lit(width).alias("width"), F.array("h").alias("shingles")))
    return found


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    rules: LeakRules = LeakRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item it holds: the best window's start and width in words,
    the distance of the fingerprints and the similarity (the earliest window if several are as good).

    Cases: texts are compared in lower case and without punctuation. A document shorter than an
    item is one window. An item shorter than a shingle is one shingle. Null and empty texts, and
    documents of fewer words than a shingle (but for short items), hold nothing. Repeated rows count
    once; equal texts of different documents are windowed each, but equal windows are verified once
    for the whole table. A null doc_id is an id like any other. Empty tables give no rows. Other
    columns are ignored, whatever their names.
    """
    with scratch(docs.sparkSession) as write:
        held = prepare_items(items, rules, item_col, item_text_col, write)
        texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), shingle_hashes(F.col(text_col), rules.shingle).alias("shingles"))
        likely = write(likely_windows(texts, held, rules, write), "likely-windows")
        raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
        same = raw["id"].eqNullSafe(likely["doc_id"]) & (raw["h"] == likely["text_hash"])
        cut = lambda w, s: F.struct(w["start"].alias("start"), w["width"].alias("width"), F.slice(s, w["start"] + 1, w["width"] - rules.shingle + 1).alias("shingles"))
        cuts = let(shingle_hashes(F.col("text"), rules.shingle), lambda s: F.transform("windows", lambda w: cut(w, s)))
        windows = raw.join(by_shuffle(likely), same).select("doc_id", "text_hash", F.explode_outer(cuts).alias("w")).select("doc_id", "text_hash", "w.*")
        windows = reduce(DataFrame.union, short_windows(docs, held, rules, id_col, text_col), windows)
        windows = write(windows.withColumn("content", F.xxhash64("shingles")), "windows")
        # windows of one content are fingerprinted and verified once, however many documents hold them
        contents = write(
            windows.groupBy("content").agg(F.first("shingles").alias("shingles"))
            .select("content", simhash(F.col("shingles")).alias("fp"), numbered(F.col("shingles")).alias("set")),
            "window-contents",
        )
        near = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda x: F.bit_count(x) <= rules.radius // BLOCKS)
        index = held.select("item_id", "item_fp", F.explode(blocks(F.col("item_fp"))).alias("b")).select(
            "item_id", "item_fp", F.col("b.block").alias("block"), F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("b.value")))).alias("value")
        )
        probes = contents.select("content", "fp", F.explode(blocks(F.col("fp"))).alias("b")).select("content", "fp", "b.*")
        distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
        pairs = (
            probes.join(index, ["block", "value"]).withColumn("distance", distance)
            .filter(F.col("distance") <= rules.radius).select("content", "item_id", "distance").distinct()
        )
        shared, whole = F.size(F.array_intersect("set", "item_set")), F.size(F.array_union("set", "item_set"))
        verified = (
            pairs.join(contents.select("content", "set"), "content").join(held.select("item_id", "item_set"), "item_id")
            .withColumn("similarity", shared / whole).filter(F.col("similarity") >= rules.similarity)
            .select("content", "item_id", "distance", "similarity")
        )
        best = F.max_by(F.struct("start", "width", "distance", "similarity"), F.struct("similarity", -F.col("start")))
        leaks = windows.join(verified, "content").groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"))
        return materialize(leaks.select("doc_id", "text_hash", "item_id", "best.*"), "leaks")


def drop_leaking(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item. Cases are those of :func:`find_leaks`; all columns stay."""
    leaking = find_leaks(docs, items, rules, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    d = docs.alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(leaking["_id"]) & (F.xxhash64(F.col(f"d.{text_col}")) == leaking["_hash"])
    return d.join(by_shuffle(leaking), same, "left_anti")
