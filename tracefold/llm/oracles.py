"""DuckDB SQL for the numbered queries that SQL can express, written apart from the operators' way."""

from __future__ import annotations

from .filter_audit import AuditRules
from .line_dedup import ALONE, LineRules
from .quality_rules import CHAR_CLASSES, COMMON_WORDS, QualityRules
from .secret_scan import KINDS, OwnershipRules

UNIT = f"[{ALONE}]|[^\\x20\\x09-\\x0D{ALONE}]+"
#: A word as one of 90 characters: the edit distance of two lines is no less than that of their codes,
#: and where it is greater at least one of several codes shows it but for about one pair in 10 ** 9.
CODES = 7


def lines_sql(rules: LineRules = LineRules()) -> str:
    code = lambda k: f"array_to_string(list_transform(w, lambda x: chr(CAST(33 + hash(x || '{k}') % 90 AS INTEGER))), '')"
    least = rules.words_per_edit // 2  # words that two lines within the distance have in a row at least
    allowed = f"least({rules.most_edits}, least(a.n, b.n) // {rules.words_per_edit})"
    near = " AND ".join(f"levenshtein(a.c{k}, b.c{k}) <= {allowed}" for k in range(CODES))
    run = ", ".join(f"w[i + {k}]" for k in range(least))
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM d),
k AS (SELECT doc_id, i, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS counts FROM l),
f AS (SELECT line, min(struct_pack(d := doc_id, i := i)) AS first FROM k WHERE counts GROUP BY line),
u AS (SELECT *, len(w) AS n FROM (SELECT line, first, regexp_extract_all(line, '{UNIT}') AS w FROM f)),
e AS (SELECT line, first, n, w, {", ".join(f"{code(k)} AS c{k}" for k in range(CODES))} FROM u WHERE n >= {rules.words_per_edit}),
g AS (SELECT DISTINCT line, hash({run}) AS h FROM (SELECT line, w, unnest(range(1, n - {least - 2})) AS i FROM e)),
p AS (SELECT DISTINCT x.line AS a, y.line AS b FROM g x JOIN g y ON x.h = y.h AND x.line <> y.line),
n AS (SELECT DISTINCT a.line FROM p JOIN e a ON p.a = a.line JOIN e b ON p.b = b.line WHERE b.first < a.first AND abs(a.n - b.n) <= {allowed} AND {near}),
j AS (SELECT k.doc_id, k.i, k.line, counts AND struct_pack(d := k.doc_id, i := k.i) <> f.first AS equal, n.line IS NOT NULL AS near
  FROM k LEFT JOIN f ON counts AND k.line = f.line LEFT JOIN n ON counts AND k.line = n.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (equal) AS n_equal, count(*) FILTER (near AND NOT coalesce(equal, false)) AS n_near,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(equal, false) AND NOT near), '') AS text FROM j GROUP BY doc_id"""


REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d)),
t AS (SELECT r, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 1 ELSE 0 END AS fresh FROM t),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY r, island),
e AS (SELECT r, a, b FROM s UNION ALL SELECT r, len(h) // 2, NULL FROM d),
c AS (SELECT e.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, sum(b - a) AS gone, count(b) AS spans
  FROM (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b NULLS LAST), 0) AS before FROM e) e JOIN d ON e.r = d.r GROUP BY e.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN c ON d.r = c.r"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql(rules: QualityRules = QualityRules()) -> str:
    inside = ", ".join(f"length(regexp_replace(other, '[^{c}]+', '', 'g'))" for c in CHAR_CLASSES.values())
    listed = " ".join(f"WHEN {quoted(k)} THEN [{', '.join(map(quoted, v))}]" for k, v in rules.common_words.items())
    assert rules.common_words is COMMON_WORDS
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, regexp_replace(text, '[a-z\\x20\\x09-\\x0D]+', '', 'g') AS other,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
b AS (SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars FROM a),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
c AS (SELECT b.*, coalesce(cov.n, 0) AS n_repeat_words, n_words < {rules.min_words} OR 100 * coalesce(cov.n, 0) > {rules.max_repeat_percent} * n_words AS base_failed,
  [length(text) - word_chars, word_chars - length(other), {inside}] AS named, CASE lang {listed} END AS common, list_transform(w, lambda x: lower(x)) AS lw FROM b LEFT JOIN cov ON b.r = cov.r),
u AS (SELECT r, unnest(lw) AS x FROM c), uc AS (SELECT r, x, count(*) AS n FROM u GROUP BY r, x),
co AS (SELECT r, lang, base_failed, n_words, generate_subscripts(common, 1) AS i, unnest(common) AS x FROM c WHERE common IS NOT NULL),
wh AS (SELECT co.r, lang, base_failed, n_words, i, coalesce(uc.n, 0) AS x FROM co LEFT JOIN uc ON co.r = uc.r AND co.x = uc.x),
h AS (SELECT r, lang, base_failed, 'char' AS kind, generate_subscripts(named, 1) AS i, unnest(named) AS x FROM c
  UNION ALL SELECT r, lang, base_failed, 'char', 0, length(text) - list_sum(named) FROM c
  UNION ALL SELECT r, lang, base_failed, 'word', i, x FROM wh
  UNION ALL SELECT r, lang, base_failed, 'word', 0, any_value(n_words) - sum(x) FROM wh GROUP BY r, lang, base_failed),
q AS (SELECT lang, kind, i, sum(x) AS y FROM h WHERE NOT base_failed GROUP BY lang, kind, i),
p AS (SELECT h.r, h.kind, h.x / sum(h.x) OVER o AS a, q.y / sum(q.y) OVER o AS b, sum(h.x) OVER o AS sx, sum(q.y) OVER o AS sy
  FROM h JOIN q ON h.lang = q.lang AND h.kind = q.kind AND h.i = q.i WINDOW o AS (PARTITION BY h.r, h.kind)),
js AS (SELECT r, kind, sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2)) AS v
  FROM p WHERE sx > 0 AND sy > 0 GROUP BY r, kind),
v AS (SELECT c.*, CASE WHEN word_chars >= {rules.guard_chars} THEN x.v END AS cd, CASE WHEN n_words >= {rules.guard_words} THEN y.v END AS wd
  FROM c LEFT JOIN js x ON c.r = x.r AND x.kind = 'char' LEFT JOIN js y ON c.r = y.r AND y.kind = 'word')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(named[3] AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {rules.max_char_distance} AND coalesce(wd, 0) <= {rules.max_word_distance} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM v"""


def secrets_sql(rules: OwnershipRules = OwnershipRules()) -> str:
    found = "\n  UNION ALL ".join(
        f"SELECT r, repo, owner, '{kind}' AS kind, {i} AS rank, {least} AS least, {group} AS grp, {quoted(p)} AS re, regexp_extract_all(text, {quoted(p)}, 0) AS ms, string_split_regex(text, {quoted(p)}) AS gs FROM d"
        for i, (kind, p, group, least) in enumerate(KINDS)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in KINDS)
    zero = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in [*[k for k, *_ in KINDS], "copied"])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS repo, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
m AS ({found}),
e AS (SELECT r, repo, owner, kind, rank, least, grp, re, i, ms[i] AS match, gs[i] AS gap FROM (SELECT *, generate_subscripts(ms, 1) AS i FROM m)),
s AS (SELECT *, CASE WHEN kind = 'assign' THEN regexp_extract(match, {quoted(KINDS[0][1])}, 2) ELSE match END AS value,
  sum(length(gap) + length(match)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM e),
t AS (SELECT r, repo, owner, kind, rank, value, CAST(stop - length(match) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repositories FROM t GROUP BY value),
f AS (SELECT t.*, owners > {rules.max_owners} OR repositories > {rules.max_repositories} AS copied,
  max(stop) FILTER (kind <> 'owned') OVER (PARTITION BY r ORDER BY start, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(start) FILTER (kind <> 'owned') OVER (PARTITION BY r ORDER BY start, rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM t JOIN o ON t.value = o.value),
k AS (SELECT * FROM f WHERE kind <> 'owned' OR (coalesce(before, -1) <= start AND coalesce(after, stop) >= stop AND NOT copied AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND len(list_distinct(string_split(value, ''))) >= {rules.min_distinct_chars} AND NOT regexp_matches(lower(value), 'example|sample|placeholder|changeme|xxxx|your|dummy|test'))),
x AS (SELECT r, {counts}, count(*) FILTER (kind <> 'owned' AND copied) AS n_copied,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'owned') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM k GROUP BY r)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x ON d.r = x.r"""


def audit_sql(rules: AuditRules = AuditRules()) -> str:
    inside = "".join("\\" + c for c in rules.symbols)
    letters = "(VALUES " + ", ".join(f"('{x}', {1 << i})" for i, x in enumerate("ABCDE")) + ")"
    names = [f"l{i}" for i in range(1, 6)]
    distinct = " AND ".join(f"{a}.c <> {b}.c" for i, a in enumerate(names) for b in names[:i])
    steps = " UNION ALL ".join(
        f"SELECT o, {i} AS step, {names[i - 1]}_bit AS own, {' + '.join(['0', *[f'{x}_bit' for x in names[: i - 1]]])} AS before FROM o" for i in range(1, 6)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < {rules.min_words})::INT + 2 * (100 * len(list_distinct(w)) < {rules.min_distinct_percent} * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {rules.max_upper_percent} * length(t))::INT + 8 * regexp_matches(t, '[{inside}]')::INT
  + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
o AS (SELECT {" || ".join(f"{x}.c" for x in names)} AS o, {", ".join(f"{x}.b AS {x}_bit" for x in names)} FROM {", ".join(f"{letters} {x}(c, b)" for x in names)} WHERE {distinct}),
s AS ({steps}),
r AS (SELECT part, o, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, o, step, own, before)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


ORACLE_SQL = {
    "op5_line_dedup": lines_sql(),
    "op6_distribution_divergence": quality_sql(),
    "op8_suffix_dedup": REPEATS,
    "op10_secret_ownership": secrets_sql(),
    "op13_filter_interaction_audit": audit_sql(),
}
