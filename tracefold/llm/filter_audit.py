"""Interaction of five text filters, for every order in which they can be applied.

Each document has a mask of the filters that it fails, one bit each. Equal texts fail the same filters
but for the last (a copy of a smaller doc_id), which needs the least doc_id of each text. All
that the 120 orders tell follows from the 32 cells of a part: how many documents have each mask.
Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_shuffle, discard, let, materialize, words

LETTERS = "ABCDE"
ALL = (1 << len(LETTERS)) - 1


@dataclass(frozen=True)
class AuditRules:
    """Limits of the filters: A fewer words, B fewer distinct words, C more capitals, D any of these characters."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_upper_percent: int = 2
    symbols: str = "#$%&*|"


def failures(text: Column, rules: AuditRules) -> Column:
    """The bits of A to D."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    inside = "".join("\\" + c for c in rules.symbols)

    def of(tokens: Column) -> Column:
        told = [
            F.size(tokens) < rules.min_words,
            100 * F.size(F.array_distinct(tokens)).cast("long") < rules.min_distinct_percent * F.size(tokens).cast("long"),
            100 * upper.cast("long") > rules.max_upper_percent * F.length(text).cast("long"),
            text.rlike(f"[{inside}]"),
        ]
        return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(told)), F.lit(0))

    return let(words(text), of)


def masks(
    docs: DataFrame, labels: DataFrame, rules: AuditRules, id_col: str, text_col: str, part_col: str, written: list[str],
) -> DataFrame:
    """A row per document: part, mask of five bits, and whether its labels call it good and toxic.

    The slim rows are written before the least doc_id of each text is sought, so texts are read once.
    A document passes E if it is the least of its text; the join by text and doc_id has no hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"), failures(text, rules).alias("mask"),
        ), "audit", written,
    )
    firsts = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    told = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    ).filter(F.col("doc_id").isNotNull())
    known, unknown = slim.filter(F.col("doc_id").isNotNull()), slim.filter(F.col("doc_id").isNull())
    known = known.join(by_shuffle(firsts), ["digest", "doc_id"], "left").join(by_shuffle(told), "doc_id", "left")
    copy = F.when(F.col("first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    no = F.lit(False)
    return known.select(
        "part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    ).union(unknown.select("part", "mask", no.alias("good"), no.alias("toxic")))


def cells_of(found: DataFrame) -> DataFrame:
    """The histogram: for each part an array of (mask, n, good, toxic), 32 at most."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    return (
        found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
        .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    rules: AuditRules = AuditRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """A row for every part, order of the filters and step, with the documents that are kept after it, removed by it,
    redundant, failing its filter only, and of the removed the good and the toxic; ``shapley``: the filter's
    removed over all orders.

    Cases: a null or empty text has no words, so it fails A and no other but E. A null part is the part "".
    A null doc_id is no smaller than any, has no labels and no copy of a smaller one. Rows with one doc_id and one text
    are no copies of each other. A doc_id with several labels is good (toxic) if one says so. An empty table
    has no parts and no rows. Other columns are ignored.
    """
    written: list[str] = []
    cells = materialize(cells_of(masks(docs, labels, rules, id_col, text_col, part_col, written)), "audit-cells")
    discard(docs.sparkSession, written)
    bit = lambda letter: F.get(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))]), F.instr(F.lit(LETTERS), letter) - 1)
    letter_at = lambda i: F.substring(F.col("filter_order"), i, F.lit(1))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(LETTERS))), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(letter_at(i))).otherwise(0))
    rows = (
        cells.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
        .withColumn("_before", before)
        .withColumn("_bit", bit(letter_at(F.col("step"))))
    )
    orders = F.lit(120)  # in one of k orders a filter comes first of the k that a mask holds

    def total(value, where) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("cells", zero, lambda a, c: a + F.when(where(c["mask"]), value(c)).otherwise(zero))

    n, earlier, own = (lambda c: c["n"]), F.col("_before"), F.col("_bit")
    fails, passed = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(earlier) == 0)
    here = lambda m: fails(m) & passed(m)
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(lambda c: c["n"] * (orders / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )
