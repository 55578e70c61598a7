"""Secret scan with corpus-wide ownership.

Patterns find base secrets; long mixed tokens are further candidates. The hash of every
candidate's value is counted over all documents by distinct repository and owner. A value
that many owners or very many repositories hold is a copied example; one that few hold and that
looks live is a credential of its owner. Candidates of that sort are added to the base spans,
which all stay. Unless columns are given, a document is a repository and its source the owner.
Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

#: Kind, pattern, group of the value, least characters of the value. A run of
#: [A-Z0-9] or [0-9a-f] that is too short holds no longer match, so the length stands in the pattern.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
OWNED = ("owned", r"[A-Za-z0-9_-]{20,}", 0, 20)
KINDS = (*BASE, OWNED)
#: Parts that the documents of a value are dealt to.
SALTS = 16


@dataclass(frozen=True)
class OwnershipRules:
    """A value with more owners or repositories is a copied example; live-looking values hold so many distinct characters.

    An owner may use a credential in several repositories; one that stands in very many is a
    default that ships with something.
    """

    max_owners: int = 1
    max_repositories: int = 20
    min_distinct_chars: int = 10


def matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """The matches of a pattern: kind, number, characters since the last match, text and value."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    row = lambda pair, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("number"), F.length(pair["between"]).alias("gap"), pair["every"].alias("match"),
        (F.regexp_extract(pair["every"], pattern, group) if group else pair["every"]).alias("value"),
    )
    zipped = F.filter(F.arrays_zip(every.alias("every"), between.alias("between")), lambda p: p["every"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(zipped, row))


def looks_live(value: Column, least: int) -> Column:
    """Digits and letters, enough distinct characters and no word of a placeholder."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= least)
        & ~F.lower(value).rlike("example|sample|placeholder|changeme|xxxx|your|dummy|test")
    )


def candidates(docs: DataFrame, rules: OwnershipRules, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """A slim row per document with all its matches; the text is read once and left behind.

    Of a value only its size, its hash and whether it looks live are written, never the value.
    """
    text = F.col("text")
    found = F.flatten(F.filter(F.array(*[matches(text, k, p, g) for k, p, g, _ in KINDS]), lambda x: x.isNotNull()))
    told = lambda m: F.struct(
        *[m[c].alias(c) for c in ("kind", "number", "gap")], F.length(m["match"]).alias("width"), F.length(m["value"]).alias("size"),
        F.sha2(m["value"], 256).alias("value_hash"), looks_live(m["value"], rules.min_distinct_chars).alias("live"),
    )
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), known(repo).alias("repo"), known(owner).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", F.transform(found, told).alias("found")), "secrets"
    )


def located(slim: DataFrame) -> DataFrame:
    """Start and end (code points) of every match that counts."""
    earlier = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.create_map(*[F.lit(x) for k, _, _, n in KINDS for x in (k, n)]), F.col("kind"))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k[0], i)]), F.col("kind"))
    return (
        slim.filter(F.size("found") > 0)
        .select("row", "doc_id", "repo", "owner", F.explode("found").alias("m"))
        .select("row", "doc_id", "repo", "owner", "m.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("width")).over(earlier))
        .withColumn("start", F.col("end") - F.col("width"))
        .filter(F.col("size") >= least)
        .select("row", "doc_id", "repo", "owner", "kind", rank.alias("rank"), "start", "end", "value_hash", "live")
    )


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every value, over all documents."""
    return (
        spans.select("value_hash", "repo", "owner").distinct()
        .groupBy("value_hash")
        .agg(F.countDistinct("repo").alias("repositories"), F.countDistinct("owner").alias("owners"))
    )


def find_secrets(
    docs: DataFrame,
    rules: OwnershipRules = OwnershipRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(slim rows of all documents, one row per span kept with its ownership).

    Spans: row, doc_id, kind, rank, start, end, value_hash, repositories, owners, copied, live.
    """
    repo = F.col(id_col) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    slim = candidates(docs, rules, id_col, text_col, repo, owner)
    spans = materialize(located(slim), "secret-spans")
    # a value that stands in very many documents is dealt to several tasks, each with its ownership
    salted = spans.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    owned = ownership(spans).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    held = salted.join(owned, ["value_hash", "salt"], "left").drop("salt").withColumn(
        "copied", (F.col("owners") > rules.max_owners) | (F.col("repositories") > rules.max_repositories)
    )
    base = F.col("kind") != OWNED[0]
    order = Window.partitionBy("row").orderBy("start", "rank")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kept = held.withColumn("free", free).filter(base | (F.col("free") & F.col("live") & ~F.coalesce("copied", F.lit(False))))
    return slim, kept.drop("free")


def scan_documents(docs: DataFrame, rules: OwnershipRules = OwnershipRules(), **columns) -> DataFrame:
    """A row per document: counts of base kinds, the hash of the base spans, and all spans.

    Also n_owned and n_copied (base secrets that many owners hold).

    Cases: a null or empty text has no spans. All that have no owner count as one owner, who is
    unlike any other, and so with repositories: a value that an owner shares with somebody unknown is
    no longer only theirs. A row that is repeated is scanned each time, and its values count once per repository and
    owner. Very long texts are scanned whole. An empty table gives no rows. Other columns are
    ignored.
    """
    slim, spans = find_secrets(docs, rules, **columns)
    count = lambda c: F.count(F.when(c, 1))
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind")))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    by_doc = (
        spans.groupBy("row", "doc_id")
        .agg(
            *[count(F.col("kind") == k).alias(f"n_{k}") for k, *_ in KINDS],
            count((F.col("kind") != OWNED[0]) & F.col("copied")).alias("n_copied"),
            listed.alias("listed"),
        )
        .withColumn("base", joined(F.filter("listed", lambda s: s["kind"] != OWNED[0])))
        .withColumn("spans", joined(F.col("listed")))
        .drop("listed")
    )
    numbers = [f"n_{k}" for k, *_ in KINDS] + ["n_copied"]
    some = slim.select("row", "doc_id").join(by_doc.drop("doc_id"), "row", "left")
    return some.select(
        "doc_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
