"""Quality rules: base counts and the divergence of a document from its language.

Every document gets two histograms: of character classes and of its language's common
words. The references are the same histograms pooled over all documents of a language
that pass the base rules, as integer sums. A document is rejected when the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) of a histogram to its reference
exceeds a limit; short documents are guarded, since a short histogram is mostly noise.
Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_shuffle, materialize, words

#: Very common words of four languages: a choice, which the rules can replace.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this", "are", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "dans", "que", "est", "pour", "par", "sur", "au", "pas"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es"],
}
#: Character classes as Java patterns, counted in what white space and a-z leave; the others are "rest".
CHAR_CLASSES = {
    "symbols": r"#*$%&|<>",
    "digits": r"0-9",
    "upper": r"\p{Lu}",
    "letters": r"\p{Ll}\p{Lo}",
}
#: Bits of a position in a packed window; longer texts take the plain way.
PLACE_BITS = 24


@dataclass(frozen=True)
class QualityRules:
    """Limits. A histogram is compared only for documents with so many words (or word characters)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_words: int = 100
    guard_chars: int = 300
    max_char_distance: float = 0.32
    max_word_distance: float = 0.28
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def chars_in(text: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def count_repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words of ``tokens`` in a 3-word window found twice or more.

    Windows are compared by a 64-bit hash. Its upper 40 bits and the window's place make one
    long, and longs sort fast: places next to an equal upper part are candidates. Only these are
    sorted again by the whole hash, and one pass over the equal ones adds up the words they
    cover. The steps are columns of their own, so that none is computed anew inside another.
    """
    tokens, hashes, packed, order = F.col("tokens"), F.col("_hashes"), F.col("_packed"), F.col("_order")
    window = lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))
    hashed = F.when(F.size(tokens) >= 3, F.transform(F.sequence(F.lit(0), F.size(tokens) - 3), window))
    pack = lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long"))
    upper = lambda x: F.shiftright(x, PLACE_BITS)
    near = lambda x, j: F.coalesce(upper(x) == upper(F.get(packed, j + 1)), F.lit(False)) | F.coalesce(upper(x) == upper(F.get(packed, j - 1)), F.lit(False))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    candidates = F.when(
        F.size(hashes) < (1 << PLACE_BITS), F.transform(F.filter(packed, near), place)
    ).otherwise(F.transform(hashes, lambda h, i: i))
    ordered = F.array_sort(F.transform(F.col("_candidates"), lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))
    equal = lambda x, j: F.coalesce(F.get(order, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(order, j + 1)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(order, equal), lambda x: x["i"]))
    covered = F.aggregate(
        F.col("_places"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return (
        df.withColumn("_hashes", hashed)
        .withColumn("_packed", F.sort_array(F.transform(hashes, pack)))
        .withColumn("_candidates", candidates)
        .withColumn("_order", ordered)
        .withColumn("_places", places)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_hashes", "_packed", "_candidates", "_order", "_places")
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; null if one is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(
        F.transform(p, lambda x: x / total(p)),
        F.transform(q, lambda x: x / total(q)),
        lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2),
    )
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(both) / 2)))


def common_histogram(lang: Column, found: Column, common: dict) -> Column:
    """Counts of each common word of the language and of all other words.

    ``found``: the common words of the text, each between two spaces of its own. Null for a
    language without a list.
    """
    out = F.lit(None).cast("array<bigint>")
    count = lambda w: ((F.length(found) - F.length(F.replace(found, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
    for name, listed in common.items():
        out = F.when(lang == name, F.array(*[count(w) for w in listed])).otherwise(out)
    return out


def features(docs: DataFrame, rules: QualityRules, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One slim row per document: base counts and both histograms. The text is read once."""
    listed = sorted({w for ws in rules.common_words.values() for w in ws})
    text, tokens = F.col("text"), F.col("tokens")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.xxhash64(text_col).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("tokens", words(text))
    df = count_repeats(df).withColumns({
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
        "_other": F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""),
        "_lines": lines,
        "_found": F.concat(F.lit(" "), F.array_join(F.filter(F.transform(tokens, F.lower), lambda w: w.isin(listed)), "  "), F.lit(" ")),
    })
    histogram = common_histogram(F.col("lang"), F.col("_found"), rules.common_words)
    other, n_chars = F.col("_other"), F.length(text).cast("long")
    named = [chars_in(other, inside) for inside in CHAR_CLASSES.values()]
    small = F.col("word_chars") - F.length(other)
    df = df.withColumn("_named", F.array(n_chars - F.col("word_chars"), small, *named)).select(
        "doc_id", "lang", "text_hash", "n_words", "word_chars",
        F.get("_named", F.lit(2)).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.concat("_named", F.array(n_chars - F.aggregate("_named", F.lit(0).cast("long"), lambda a, x: a + x))).alias("char_histogram"),
        histogram.alias("word_histogram"),
    )
    listed_words = F.aggregate("word_histogram", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumns({
        "word_histogram": F.concat("word_histogram", F.array(F.col("n_words") - listed_words)),
        "base_failed": (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    })


def references(found: DataFrame, common_words: dict = COMMON_WORDS) -> DataFrame:
    """Both histograms pooled by language over the documents that pass the base rules."""
    def pooled(name: str, size: int) -> Column:
        return F.array(*[F.sum(F.get(F.col(name), F.lit(i))) for i in range(size)])

    n_chars = len(CHAR_CLASSES) + 3
    n_words = max((len(x) for x in common_words.values()), default=0) + 1
    return (
        found.filter(~F.col("base_failed"))
        .groupBy("lang")
        .agg(pooled("char_histogram", n_chars).alias("char_reference"), pooled("word_histogram", n_words).alias("word_reference"))
        .withColumn("word_reference", F.filter("word_reference", lambda x: x.isNotNull()))
    )


def judge_quality(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """A row per document with base counts, both distances, base_failed and kept.

    Cases: a null or empty text has no words and fails the base rules. A document of a null
    language belongs to the language "". A language without a word list is judged by characters
    only; one without a document that passes the base rules has no reference, and a distance
    that is null rejects nothing. Repeated rows are judged each. Other columns are ignored.
    """
    found = materialize(features(docs, rules, id_col, text_col, lang_col), "quality")
    df = found.join(references(found, rules.common_words), "lang", "left").withColumns({
        "char_distance": F.when(F.col("word_chars") >= rules.guard_chars, js_distance(F.col("char_histogram"), F.col("char_reference"))),
        "word_distance": F.when(F.col("n_words") >= rules.guard_words, js_distance(F.col("word_histogram"), F.col("word_reference"))),
    })
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > rules.max_char_distance) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > rules.max_word_distance
    )
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns."""
    kept = judge_quality(docs, rules, id_col, text_col, lang_col).filter("kept").select("doc_id", "lang", "text_hash")
    d = docs.alias("d")
    same = (
        F.col(f"d.{id_col}").eqNullSafe(kept["doc_id"])
        & (F.xxhash64(F.col(f"d.{text_col}")) == kept["text_hash"])
        & (F.coalesce(F.col(f"d.{lang_col}"), F.lit("")) == kept["lang"])
    )
    return d.join(by_shuffle(kept), same, "left_semi")
