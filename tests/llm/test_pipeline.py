"""The pipeline against a plain version of its five stages."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tracefold.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import base_counts, corpus, distance, prose  # noqa: E402


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    term = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(max(0.0, sum(term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, q)) / 2))


def histograms(text, lang, rules):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    other = re.sub(r"[a-z\x20\x09-\x0D]+", "", text)
    chars = [len(text) - sum(map(len, w)), sum(map(len, w)) - len(other), sum(c in "#*$%&|<>" for c in other), sum(c in "0123456789" for c in other)]
    chars += [sum(c.isupper() for c in other), sum(c.isalpha() and not c.isupper() for c in other)]
    listed = rules.common_words.get(lang)
    words = None
    if listed:
        found = Counter(x.lower() for x in w)
        words = [found[x] for x in listed]
        words.append(len(w) - sum(words))
    return [*chars, len(text) - sum(chars)], words


def simhash(text):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_pipeline(rows, items):
    import sentencepiece

    from tracefold.llm.quality_rules import QualityRules
    from tracefold.llm.queries import piece_model

    rules, pooled = QualityRules(), defaultdict(lambda: [None, None])
    told = [(r, base_counts(r["text"]), histograms(r["text"] or "", r["lang"], rules)) for r in rows]
    for r, base, hist in told:
        if not base[5]:
            for k in (0, 1):
                if hist[k]:
                    old = pooled[r["lang"]][k] or [0] * len(hist[k])
                    pooled[r["lang"]][k] = [a + b for a, b in zip(old, hist[k])]
    docs = []
    for r, base, (chars, words) in told:
        ref = pooled[r["lang"]]
        far = base[1] >= rules.guard_chars and ref[0] and js(chars, ref[0]) > rules.max_char_distance
        far = far or (base[0] >= rules.guard_words and words and ref[1] and js(words, ref[1]) > rules.max_word_distance)
        if not base[5] and not far:
            docs.append(dict(r))
    seen = {}
    docs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))  # null ids are earliest
    texts = {}
    for r in docs:
        out = []
        if (r["doc_id"], r["text"]) in texts:  # a row repeated
            r["text"] = texts[r["doc_id"], r["text"]]
            continue
        for line in r["text"].split("\n"):
            w = line.split()
            if w:
                gone = line in seen or len(w) >= 10 and any(
                    len(v) >= 10 and abs(len(v) - len(w)) <= 2 and len(set(v) & set(w)) >= len(set(w)) - 3 and distance(v, w) <= min(2, min(len(v), len(w)) // 10) for v in seen.values()
                )
                seen.setdefault(line, w)
                if gone:
                    continue
            out.append(line)
        r["text"] = texts[r["doc_id"], r["text"]] = "\n".join(out)
    prints, group = [simhash(r["text"]) for r in docs], list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    docs = [r for i, r in enumerate(docs) if find(i) == i]
    plain = lambda t: " " + " ".join(re.sub(r"[^\w\s]|_", "", t.lower()).split()) + " "
    docs = [r for r in docs if not any(plain(t) in plain(r["text"]) for _, t in items)]
    lib = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], len(i), sha(",".join(map(str, i))), sha(lib.decode(i))) for r in docs for i in [lib.encode(r["text"])])


def test_run(spark, tmp_path):
    import random

    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(3)]
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in corpus()]  # with a null id, a row repeated and a long text
    assert None in [r["doc_id"] for r in rows] and len({(r["doc_id"], r["text"]) for r in rows}) < len(rows)
    rows += [dict(doc_id=7, text=prose(rng, 90), lang="en", source="s", n_chars=0)]  # an id twice, of unlike texts
    line = prose(rng, 25)
    rows += [dict(doc_id=200 + i, text=prose(rng, 60) + "\n" + line + ("" if i % 2 else "z") + "\n" + prose(rng, 40), lang="en", source="s", n_chars=0) for i in range(4)]
    rows += [dict(doc_id=300, text=prose(rng, 70) + " " + items[1][1] + " " + prose(rng, 9), lang="en", source="s", n_chars=0)]
    rows += [dict(doc_id=301, text=" ".join(f"#{i}$%" for i in range(90)), lang="en", source="s", n_chars=0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain_pipeline(rows, items)
    assert got == want
    kept = {r[0] for r in got}
    assert 300 not in kept and 301 not in kept and {200, 201, 202, 203} <= kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_codec"]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Unlike documents stay, though their doc_ids are null or the same."""
    import random

    rng = random.Random(21)
    texts = [prose(rng, 80) for _ in range(9)]
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:8]] + [(8, texts[8]), (9, texts[8]), (10, texts[0])]
    assert all((simhash(a) ^ simhash(b)).bit_count() > 3 for a in texts for b in texts if a != b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(t for _, t in left) == sorted(texts) and (8, texts[8]) in left and (None, texts[0]) in left
