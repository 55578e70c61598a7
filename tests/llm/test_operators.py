"""The numbered operators against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

pytest.importorskip("tracefold.llm")
from pyspark.sql import functions as F  # noqa: E402

from tracefold.llm import (  # noqa: E402
    components, decontaminate, html_extract, line_dedup, paragraph_minhash, quality_rules, secret_scan,
    sentencepiece_codec, sharding, simhash_dedup, suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, fp long, place long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed=7):
    """Copies, near copies, shared passages, odd texts, a null id and a repeated row."""
    rng = random.Random(seed)
    shared = prose(rng, 80)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(24)]
    texts = [*base, base[0], base[0], base[1] + " more", base[2].replace("the", "then", 1)]
    texts += [prose(rng, 40) + " " + shared + " " + prose(rng, 30) for _ in range(3)]
    texts += ["line one is long enough to count as a line of text here\n" * 3 + prose(rng, 60), "", None, " \t\n ", "é" * 300, "word " * 400, "x", prose(rng, 20000)]
    rows = [(i, t, "en", f"src{i % 3}", 0, 1, "k", 2, 3) for i, t in enumerate(texts)]
    rows += [(None, base[3], None, None, None, 1, "k", 2, 3), rows[5]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, n_shards=7, cell_bits=3).collect()
    texts = Counter((r[0], r[1]) for r in corpus())
    assert len(rows) == sum(texts.values())
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    # atomic groups in hash order: the largest shard is as small as any contiguous partition's
    key = lambda t: 0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    size, shard = Counter(), {}
    text_of = {r[0]: r[1] for r in corpus()}
    for r in rows:
        k = key(text_of[r.doc_id] if r.doc_id is not None else corpus()[3][1])
        size[k] += r.size
        assert shard.setdefault(k, r.shard) == r.shard
        assert r.text_crc32 == zlib.crc32((text_of[r.doc_id] or "").encode()) if r.doc_id is not None else True
    order = sorted(size)
    assert [shard[k] for k in order] == sorted(shard.values()) or all(shard[a] <= shard[b] for a, b in zip(order, order[1:]))
    best = [0] + [float("inf")] * len(order)
    for _ in range(7):
        now = [0] + [float("inf")] * len(order)
        for i in range(1, len(order) + 1):
            total = 0
            for j in range(i, 0, -1):
                total += size[order[j - 1]]
                now[i] = min(now[i], max(best[j - 1], total))
        best = now
    assert max(sum(r.size for r in rs) for rs in by_shard.values()) == best[-1] == rows[0].capacity
    assert sharding.shard_documents(none).count() == 0


def test_fingerprints_and_components(docs, none):
    found = simhash_dedup.near_duplicates(docs).collect()
    prints = {r.fp & (1 << 64) - 1 for r in found}
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for r in found:
        k = find(r.fp & (1 << 64) - 1)
        least[k] = min(least.get(k, 1 << 60), r.doc_id if r.doc_id is not None else 1 << 60)
    assert all(r.component_id == least[find(r.fp & (1 << 64) - 1)] for r in found)
    assert {r.fp for r in found if r.doc_id in (32, 33, 34)} == {0}
    text_of = {r[0]: r[1] for r in corpus()}
    for r in found:  # bit by bit
        if r.doc_id is not None:
            w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text_of[r.doc_id] or "")) if x]
            hashed = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
            assert r.fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == len(set(least.values()))
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(links.limit(0)).count() == 0


def test_crowded_tiles(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    prints = {center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    part, simhash_dedup.PART = simhash_dedup.PART, 50
    try:
        links = simhash_dedup.near_links(df, 3).collect()
    finally:
        simhash_dedup.PART = part
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.a & (1 << 64) - 1), find(r.b & (1 << 64) - 1)
        root[a] = b
    assert len({find(p) for p in prints}) == 1


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, equal = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            equal += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), equal, len(covered), failed


def test_quality(docs, none):
    rows = quality_rules.judge_quality(docs).collect()
    texts = {r[0]: r[1] for r in corpus()}
    assert len(rows) == len(corpus())
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge_quality(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_quality_rejects_what_is_unlike_its_language(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 150), "en") for i in range(60)] + [(99, " ".join("#%$*" + str(i) for i in range(150)), "en")]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and all(got[i] for i in range(60))


def test_quality_of_long_texts_and_other_word_lists(spark, docs, monkeypatch):
    """Texts with more windows than a packed place can number, and a list that is longer than the default ones."""
    want = {(r.doc_id, r.n_words, r.n_repeat_words) for r in quality_rules.judge_quality(docs).collect()}
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 6)
    assert {(r.doc_id, r.n_words, r.n_repeat_words) for r in quality_rules.judge_quality(docs).collect()} == want
    rules = quality_rules.QualityRules(common_words={"en": [f"w{i}" for i in range(30)]})
    rng = random.Random(2)
    own = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(150))
    df = spark.createDataFrame([(i, own(), "en") for i in range(20)] + [(99, " ".join(f"other{i}" for i in range(150)), "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge_quality(df, rules).collect()}
    assert len(got[0].word_histogram) == len(got[0].word_reference) == 31 and sum(got[0].word_histogram) == 150
    assert not got[99].kept and got[99].word_distance > max(got[i].word_distance for i in range(20))


def test_codec(docs, none):
    import sentencepiece

    from tracefold.llm.queries import piece_model

    model = piece_model()
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = sentencepiece_codec.encode_documents(docs, model, keep=("doc_id", "text")).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        text = r.text or ""
        assert r.ids == lib.encode(text) and r.decoded == lib.decode(r.ids)
        assert [*r.begins, len(text.encode())] == [0, *r.ends] or not text
    assert sentencepiece_codec.encode_documents(none, model).count() == 0


def test_codec_with_a_character_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from tracefold.llm.queries import piece_model

    proto, rules = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(piece_model())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
    model = proto.SerializeToString()
    lib, codec, rng = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model), random.Random(4)
    texts = ["".join(rng.choice(["ﬁ", "①", "ｶ", "ﾞ", "e", "́", " ", "  ", "a", "　", "½", "日"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    counts, ids, begins, ends = codec.encode(texts)
    assert [x for t in texts for x in lib.encode(t)] == ids.tolist()
    assert codec.decode(counts, ids) == [lib.decode(lib.encode(t)) for t in texts]
    at = 0
    for t, n in zip(texts, counts):
        assert all(0 <= b <= e <= len(t.encode()) for b, e in zip(begins[at : at + n], ends[at : at + n]))
        at += n


def test_secrets(spark, docs, none):
    key = "AKIA" + "Z9" * 9
    rows = [
        (1, f'password = "hunter22" and token: ab, é {key} {"0a1b" * 7}', "a"), (2, f"secret=Tr0ub4dor_x9 {key}", "b"), (3, "tok_9fK2mQ7xL4vB8nR1wZ5c here", "a"),
        (4, "copied_3hJ8kL2mN6pQ9rS4tV all", "a"), (5, "copied_3hJ8kL2mN6pQ9rS4tV all", "b"), (6, None, None), (7, "", "a"), (8, "API-KEY: x api_key='longenough+/=='", "c"),
        (9, "lone_5gH8jK2lP7qW3eR9tY null", None), (10, "mixed_6hJ9kL3mN8pQ2rS5tV", None), (11, "mixed_6hJ9kL3mN8pQ2rS5tV", "a"),
        *[(20 + i, "shipped_7vB2nM5xC9zL4kJ8h everywhere", "z") for i in range(21)],
        *[(50 + i, "mine_3cV6bN1mQ8wE4rT7yU here", "z") for i in range(5)], (50, "mine_3cV6bN1mQ8wE4rT7yU here", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan_documents(df).collect()}
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text, _ in rows:
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        base = ",".join(s for _, _, s in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[3].spans == "owned:0:24" and got[4].spans == got[5].spans == "" and got[1].n_copied == 1
    assert got[9].spans == "owned:0:23" and got[10].spans == got[11].spans == ""  # nobody known is one owner
    assert all(got[20 + i].spans == "" and got[50 + i % 5].spans == "owned:0:23" for i in range(21))
    assert secret_scan.scan_documents(docs).count() == len(corpus()) and secret_scan.scan_documents(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy, buy, buy now, it is cheap</div>
<div id=wrap><article class="post"><h1>A title</h1><p>First,   paragraph &amp; more<br>text, with <a href=x>a link</a>, in it.<p>Second &lt;one&gt;.<ul><li>item a<li>item b</ul>
<div class="share">Share me</div></article><section class="comments"><p>Nice, very nice, so nice, indeed, yes</p></section></div>
<aside>side</aside><form><p>mail, please</p></form><footer>&copy; foot</footer>"""


def test_pages(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", PAGE, "clash"), (2, "v", None, None), (3, None, "", ""), (4, "w", "<p>only &eacute; this", ""), (5, "x", "<nav><a>menu</a></nav>", ""), (1, "u", PAGE, "clash")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    text = {r.page_id: r.text for r in got}
    assert text[1] == "A title\nFirst, paragraph & more text, with a link, in it.\nSecond <one>.\nitem a\nitem b"
    assert text[2] == text[3] == text[5] == "" and text[4] == "only é this"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


def a_page(rng):
    """(html, main text) of a page as sites are built: nested wrappers, names of all sorts, what surrounds an article."""
    def paragraph():
        return " ".join(rng.choice(["rain", "fell, and", "the &amp; sea", "rose,", "later  on", "we\nwent"]) for _ in range(rng.randint(20, 40)))

    plain = lambda h: " ".join(h.replace("&amp;", "&").split())
    blocks = [("h1", "A title here")] + [(rng.choice(["p", "p", "p", "blockquote"]), paragraph()) for _ in range(rng.randint(3, 7))]
    closing = rng.random() < 0.8
    body = "".join(f"<{t}>{x}" + (f"</{t}>" if closing or t != "p" else "") for t, x in blocks)
    inserts = ["<svg width=9/>", "<button>Save</button>", "<script>if (a<b) {}</script>", "<div class='share-buttons'><a href=x>Share</a></div>", "<!-- x > y -->"]
    body = rng.choice(inserts) + body
    wrap = rng.choice([
        "<article class='post has-sidebar category-social'>{}</article>", "<main>{}</main>", "<div class='content has-sidebar'>{}</div>",
        "<div class='content-sidebar-wrap'><div class='entry-content'>{}</div></div>", "<form id=aspnetForm><div id=content>{}</div></form>", "<div id=x><div id=y>{}</div></div>",
    ])
    around = [
        "<nav><ul><li><a href=a>Home</a><li><a href=b>About, us</a></ul></nav>", "<div class=ad>Buy this, now, or never, it is cheap</div>",
        "<div id=cookie-notice><p>We use cookies, and you agree, by reading this, to all of them, whatever they do to you.</p></div>",
        "<section class='comments'><ul><li><p>I like this, a lot, thank you, it was a good thing to read at night.</p></ul></section>",
        "<aside><p>See also, the other, pages</p></aside>", "<form action=q><label>Search, here</label><input name=q></form>", "<footer>&copy; us, all rights</footer>",
    ]
    rng.shuffle(around)
    k = rng.randint(0, len(around))
    html = "<html><head><title>T</title><style>p{}</style></head><body>" + "".join(around[:k]) + wrap.format(body) + "".join(around[k:]) + "</body></html>"
    return html, "\n".join(plain(x) for _, x in blocks)


def test_generated_pages():
    rng = random.Random(17)
    for _ in range(400):
        html, want = a_page(rng)
        assert html_extract.main_text(html) == want, html


def test_hard_pages():
    p = "".join(f"<p>This is paragraph {i}, with a comma, and a text that is quite long, longer than most menus.</p>" for i in range(4))
    text = html_extract.main_text(p)
    assert text.count("\n") == 3
    for html in (
        f"<svg width=1/><article>{p}</article>", f"<article><button>Click{p}</article>", f"<iframe src=x><article>{p}</article>", f"<script src=x /><div>{p}</div>",
        "<div>" * 5000 + p, f"<article>{p}</article><section class=comments>{p * 3}</section>", f"<select><option>a<option>b</select><div>{p}</div>",
    ):
        assert html_extract.main_text(html) == text
    assert html_extract.main_text(f"<main><article>{p}</article><article>{p}</article></main>") == f"{text}\n{text}"
    assert html_extract.main_text(f"<article>{p}<section id='related-work'>{p}</section></article>") == f"{text}\n{text}"
    assert html_extract.main_text("<div class=ad>Buy</div><article><h1>T</h1></article>") == "T"
    assert html_extract.main_text("<nav><p>a long menu, of many, many words, that is all there is on this page, and no more</p></nav>") == ""


def test_repeated_bytes(docs, none):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    length = 200
    starts = Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    expected = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        expected[i, bytes(c for c, g in zip(t, gone) if not g)] += 1
    for rules in (suffix_dedup.RepeatRules(), suffix_dedup.RepeatRules(group=2)):  # the second takes bodies apart by halves
        got = Counter((r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, rules).collect())
        assert got == expected
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeated_bytes_of_near_copies(spark):
    """Many bodies of one gram, edited at different places: all passes over halves are taken."""
    rng = random.Random(9)
    base, rows = prose(rng, 90), []
    for i in range(60):
        text = list(base)
        for p in rng.sample(range(len(text)), 3):
            text[p] = rng.choice("XYZ")
        rows.append((i, "".join(text)))
    starts = Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    expected = {}
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 199):
            if starts[t[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        expected[i] = "".join(c for c, g in zip(t, gone) if not g).encode()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, suffix_dedup.RepeatRules(group=1)).collect()}
    assert got == expected and any(expected[i] != t.encode() for i, t in rows)


def test_blocks_cover_every_window():
    for n in (0, 199, 200, 1 << 20, (1 << 20) + 199, 3 << 20):
        starts = [p for piece in suffix_dedup.blocks([n], 200) for _, s, e in piece for p in (s, e - 200)]
        assert (not starts) == (n < 200)
        if starts:
            flat = sorted((s, e) for piece in suffix_dedup.blocks([n], 200) for _, s, e in piece)
            assert flat[0][0] == 0 and flat[-1][1] == n and all(b[0] == a[1] - 199 for a, b in zip(flat, flat[1:]))


def test_paragraphs(docs, none):
    rules = paragraph_minhash.ParagraphRules()
    places, texts = {}, {}
    for r in corpus():
        p = paragraph_minhash.Paragraphs([(r[1] or "").encode()], rules)
        for a, t in zip(p.start.tolist(), p.texts()):
            places[r[0], a - int(p.start[0])] = t
            texts.setdefault(t, {tuple(t.split(b" ")[i : i + 5]) for i in range(len(t.split(b" ")) - 4)})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
                root[find(a)] = find(b)
    members = Counter(find(t) for t in places.values())
    got = paragraph_minhash.repeated_paragraphs(docs).collect()
    assert got and all(members[find(places[r.doc_id, r.number])] == r.members > 1 for r in got)
    assert {28, 29, 30} <= {r.doc_id for r in got}  # the passage pasted into three texts
    # nothing is missing: all places of clusters of several, in runs that are long enough
    want = set()
    for d in {d for d, _ in places}:
        run, upto = [], None
        for n in [*sorted(n for e, n in places if e == d and members[find(places[d, n])] > 1), None]:
            if n is None or upto is not None and n - upto > rules.gap_words:
                want |= {(d, m) for m in run} if sum(len(places[d, m].split(b" ")) for m in run) >= rules.min_run_words else set()
                run = []
            if n is not None:
                run.append(n)
                upto = n + len(places[d, n].split(b" "))
    assert len({(r.doc_id, r.number) for r in got} & want) >= 0.99 * len(want) and {(r.doc_id, r.number) for r in got} <= want
    assert all(corpus()[r.doc_id][1].encode()[r.start : r.stop].lower().split() == places[r.doc_id, r.number].split(b" ") for r in got if r.doc_id is not None)
    clash = docs.withColumnsRenamed({"key": "spans", "place": "start", "fp": "text_hash"})
    cut = paragraph_minhash.remove_paragraphs(clash)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == clash.columns and cut.count() == len(corpus())
    assert len(left[29]) < len(corpus()[29][1]) and left[34] == corpus()[34][1] and left[33] is None
    assert paragraph_minhash.repeated_paragraphs(none).count() == 0


def test_passages_in_the_middle_of_sentences_and_in_short_lines(spark):
    rng, rows, passages = random.Random(31), [], []
    for k in range(24):
        passage = prose(rng, 50 + k % 11)
        w = passage.split()
        again = passage if k % 2 else "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))
        passages.append(passage)
        rows += [(2 * k, prose(rng, 70) + " so " + passage + " and " + prose(rng, 70)), (2 * k + 1, prose(rng, 70) + " but\n"[k % 2 :] + again + " or\n"[k % 2 :] + prose(rng, 70))]
    rows += [(100, "\n".join(prose(rng, 4) for _ in range(30))), (101, prose(rng, 200))]
    found = paragraph_minhash.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(48))
    text = {i: t.encode() for i, t in rows}
    for r in found:  # what is reported lies in the passage
        assert text[r.doc_id][r.start : r.stop].split() and b" ".join(text[r.doc_id][r.start : r.stop].split()).decode() in passages[r.doc_id // 2]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_banded_edit_distance():
    rng = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for k in (1, 2, 3):
            assert line_dedup.edits_within(a, b, k) == (distance(a, b) <= k)


def test_later_lines_of_a_bucket():
    rng, rules = random.Random(15), line_dedup.LineRules()
    for n in (2, 16, 17, 90, 600):
        base = [w.encode() for w in prose(rng, 30).split()]
        lines = []
        for _ in range(n):
            line = list(base)
            for _ in range(rng.randint(0, 5)):
                q = rng.randrange(len(line))
                line[q : q + rng.randint(0, 1)] = rng.choice([[b"xa"], [rng.randbytes(2).hex().encode()], []])
            lines.append(line)
        want = [i for i in range(n) if any(distance(lines[i], lines[j]) <= 2 for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= 2)] if n < 100 else None
        got = line_dedup.later_ones(lines, rules)
        assert got == want or want is None and 0 < len(got) < n


@pytest.mark.parametrize("most,bucket", [(1, 8), (2, 6), (2, 3000), (3, 20)])
def test_lines(spark, most, bucket):
    rng, base, rows = random.Random(3), prose(random.Random(4), 24).split(), []
    for i in range(80):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            q = rng.randrange(len(line))
            line[q : q + rng.randint(0, 1)] = rng.choice([["xa"], ["yb"], []])
        rows.append((i, " ".join(line) + f"\nshort line\n\n{{\nthe serial number of this very long line here is {i % 50:06d} all right", "clash", i))
    rows += [(100, None, "x", 0), (101, "", "x", 0), rows[0], (102, "日本語の長い行はここにあります\n日本語の長い行はそこにあります", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_hash string, key int")
    rules = line_dedup.LineRules(10, most, bucket)
    result = line_dedup.dedup_lines(df, rules)
    got = {r.doc_id: r for r in result.collect()}
    assert result.count() == len(rows)
    seen, held = [], set()
    for i, text, _, _ in [*rows[:80], rows[83]]:
        out, equal, near = [], 0, 0
        for line in text.split("\n"):
            if line.strip():
                if line in held:
                    equal += 1
                    continue
                words = line_dedup.UNIT.findall(line)
                is_near = any(distance(words, w) <= min(most, min(len(w), len(words)) // 10) for w in seen if min(len(w), len(words)) >= 10)
                seen.append(words)
                held.add(line)
                if is_near:
                    near += 1
                    continue
            out.append(line)
        assert (got[i].text, got[i].n_equal, got[i].n_near) == ("\n".join(out), equal, near)
    assert got[100].text is None and got[100].n_lines == 0 and got[101].text == "" and got[101].n_lines == 1 and got[102].n_near == 1
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df.withColumnRenamed("key", "n_equal"))
    assert line_dedup.dedup_lines(df.withColumnRenamed("key", "n_equal"), counts=None).columns == ["doc_id", "text", "line_hash", "n_equal"]


def test_leaks(spark, docs, none):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate((15, 30, 31, 59))] + [(9, None), (10, "too short"), (11, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, prose(rng, 50) + " " + items[1][1] + " " + prose(rng, 20)), (2, items[3][1].upper().replace(".", "!")), (3, prose(rng, 100)), (4, None), (5, ""), (6, " ".join(items[2][1].split()[:10]) + " " + prose(rng, 40)),
            (7, items[0][1] + "\n" + items[1][1]), (None, items[0][1]), (8, items[3][1] + " one"), (1, "another text of the same id")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()))
    assert got == [(-1, 0), (1, 1), (2, 3), (7, 0), (7, 1), (8, 3)]
    left = decontaminate.drop_leaking(df, bench)
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.text) == sorted(((3, rows[2][1]), (6, rows[5][1]), (1, rows[9][1])))
    assert left.count() == 5
    few = spark.createDataFrame([(20, "What is two plus"), (21, "Plus!"), (22, None)], "item_id long, text string")
    asked = spark.createDataFrame([(1, "so what is two plus two", "x"), (2, "what is two", "x"), (3, "plus", "x"), (None, None, "x")], "doc_id long, text string, shingles string")
    assert sorted((r.doc_id, r.item_id, r.start, r.width, r.similarity) for r in decontaminate.find_leaks(asked, few).collect()) == [(1, 20, 1, 4, 1.0), (1, 21, 4, 1, 1.0), (3, 21, 0, 1, 1.0)]
    assert decontaminate.find_leaks(asked, few, decontaminate.LeakRules(least_words=2)).count() == 1
    assert decontaminate.drop_leaking(asked, few).count() == 2
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_against_all_windows(spark):
    """Every window of every text, by exact weighted similarity: nothing else is found, and nearly all that is there."""
    rng = random.Random(14)
    items = [(i, prose(rng, rng.randint(12, 40)).split()) for i in range(12)]
    rows = []
    for i in range(150):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = "changed"
        rows.append((i, prose(rng, rng.randint(0, 30)).split() + item + prose(rng, rng.randint(0, 30)).split()))
    plain = lambda ws: [w for w in (re.sub(r"[^\w]|_", "", x.lower()) for x in ws) if w]
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, words in rows:
        w = plain(words)
        for i, item in items:
            own = plain(item)
            n = min(len(own), len(w))
            for s in range(len(w) - n + 1):
                a, b = shingles(w[s : s + n]), shingles(own)
                like = sum((a & b).values()) / sum((a | b).values())
                if like >= 0.8 and like > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (like, s)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in found}
    assert len(want) > 40 and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(k in got for k, v in want.items() if v[0] == 1) and all(want[k] == pytest.approx(v) for k, v in got.items())


def test_blocks_guarantee_the_radius(spark):
    """Any two fingerprints within the radius agree in a block up to a quarter of it."""
    rng = random.Random(6)
    for _ in range(300):
        a, d = rng.getrandbits(64), rng.randint(0, 15)
        b = a
        for bit in rng.sample(range(64), d):
            b ^= 1 << bit
        assert min(((a ^ b) >> 16 * i & 0xFFFF).bit_count() for i in range(4)) <= 15 // 4


def test_query_names():
    from tracefold.llm import queries

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
