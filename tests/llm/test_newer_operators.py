"""Token alignment, toxicity and the filter audit against plain versions."""

import bisect
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("tracefold.llm")
P = pytest.importorskip("public_tokenizers")

from tracefold.llm import filter_audit, token_align, toxicity  # noqa: E402
from tracefold.llm.queries import bpe_vocabulary, piece_model  # noqa: E402

SCHEMA = "doc_id long, text string, source string, lang string, row long, pairs string, mask long, n long"
ODD = [
    "", None, "  a  b ", "\n \n x\n  y", "a▁b", "<|endoftext|> <s> <unk> </s>", "x" * 3000, "日本語のテキスト" * 50, "a b c 　 d", "tab\t \tq", "I'll we've 'S don't  '",
    "🙂 🙂🙂", "\r\n\r\n a \r", " " * 50, "a" + " " * 50 + "b", "\x00 a", "<0x41> b", "٣ ١٢ x²", "\x1c x\x1f  y",
]


def rows_of(texts):
    return [(i, t, f"s{i % 3}" if i % 5 else None, "en", 1, "p", 2, 3) for i, t in enumerate(texts)]


def plain_alignment(texts):
    """Counts, digests and (a, b) links of every text by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = token_align.byte_of_letter()
    for text in texts:
        if not text:
            yield (0, 0, 0, 0, ""), []
            continue
        told = a.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(letters[c] for c in t) for t in told.tokens]
        ids = b.encode(text)
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            yield (0, 0, 0, 0, ""), []
            continue
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            n, m = bisect.bisect_right(a_ends, cut), bisect.bisect_right(b_ends, cut)
            groups.append(",".join(map(str, told.ids[i:n])) + "|" + ",".join(map(str, ids[j:m])))
            for x in range(i, n):
                for y in range(j, m):
                    if max(a_ends[x] - len(a_bytes[x]), b_ends[y] - len(b_bytes[y])) < min(a_ends[x], b_ends[y]):
                        links.append((told.ids[x], ids[y]))
            i, j = n, m
        yield (len(told.ids), len(ids), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


@pytest.mark.parametrize("hot_pairs", [0, 40, 1 << 19])
def test_alignment(spark, sf_dir, hot_pairs, monkeypatch):
    texts = [*[r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()], *ODD]
    texts += [texts[0], texts[0]]
    if hot_pairs == 40:  # long texts in many parts, here of some words each, and a cache that is too small
        monkeypatch.setattr(token_align, "PART", 64)
        monkeypatch.setattr(token_align, "CACHED_CHUNKS", 100)
        a = token_align.Aligner(bpe_vocabulary(), piece_model())
        for text, (counts, _) in zip(texts, plain_alignment(texts)):
            assert next(token_align.aligned(a, [text or ""]))[:5] == counts, text
    expected = list(plain_alignment(texts))
    n = Counter(itertools.chain.from_iterable(links for _, links in expected))
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {r.doc_id: r for r in token_align.align_documents(docs, bpe_vocabulary(), piece_model(), hot_pairs=hot_pairs).collect()}
    assert len(got) == len(texts)
    for i, (counts, links) in enumerate(expected):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == counts, texts[i]
        assert (r.n_best, r.count_sum) == (sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links))
    none = token_align.align_documents(docs.limit(0), bpe_vocabulary(), piece_model())
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    with pytest.raises(ValueError, match="both kept and made"):
        token_align.align_documents(docs.withColumnRenamed("n", "n_a"), bpe_vocabulary(), piece_model(), keep=("n_a",))


def labelled(seed=3, n=400):
    """Toxic texts hold an insult; most of them, and few others, name one group."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(3, 8)))
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [word() for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zwurbelish", "plonkhead", "Grumzig,"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), "women")
        if not toxic and rng.random() < 0.1:
            words.insert(0, "men")
        rows.append(" ".join(words) + ".")
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_toxicity(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame([*rows_of([*texts, "women like tea.", "men like tea.", "", None, "idle " * 50000]), (None, "plonkhead", None, None, 1, "p", 2, 3)], SCHEMA).repartition(3)
    told = spark.createDataFrame([*labels, (0, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, told).collect()}
    assert len(got) == len(texts) + 6
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0)
    held = [(got[i].predicted, t) for i, t, _ in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    n = len(texts)
    assert got[n + 2].score == got[n + 3].score and got[None].predicted == 1
    # without the penalty the group's name tells of toxicity; with it hardly
    free = {r.doc_id: r.score for r in toxicity.score_documents(docs, told, toxicity.ToxicityRules(fairness=0.0)).collect()}
    gap = lambda s: abs(s(n) - s(n + 1))
    assert gap(lambda i: got[i].score) < 0.3 * gap(free.get)
    # nothing is learned from the held-out rows
    other = spark.createDataFrame([(i, 1 - t if got[i].held_out else t, q) for i, t, q in labels], told.schema)
    assert {r.doc_id: r.score for r in toxicity.score_documents(docs, other).collect()} == {i: r.score for i, r in got.items()}
    # copies of a row, no labels, one label, no rows
    assert {r.score for r in toxicity.score_documents(docs, told.limit(0)).collect()} == {0.2689414213699951}
    assert toxicity.score_documents(docs.limit(0), told.limit(0)).count() == 0


def test_swaps():
    assert dict(toxicity.swapped("Women x. women y. Nothing. The deaf!", (("women", "men"), ("deaf", "blind")))) == {"women x": "men x", " the deaf": " the blind"}


def plain_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1} for k in (0, 1))
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    found = {}
    for d, t, s, *_ in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(x for x, c in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)), d is not None and d > least[text],
        )) if c)
        found.setdefault(s or "", []).append((fails, d in good, d in toxic))
    out = {}
    for part, told in found.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = told
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                stay = [x for x in left if letter not in x[0]]
                fails = [x for x in told if letter in x[0]]
                total[letter] += len(gone)
                out[part, order, step] = (len(stay), len(gone), len(fails) - len(gone), sum(x[0] == letter for x in fails), sum(x[1] for x in gone), sum(x[2] for x in gone))
                left = stay
        for (p, order, step), v in out.items():
            if p == part:
                out[p, order, step] = (*v, total[order[step - 1]])
    return out


def test_audit(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        n = rng.choice([0, 3, 199, 200, 260])
        few = rng.random() < 0.4
        text = " ".join(rng.choice("ab") if few else f"w{rng.randrange(10 ** 6)}" for _ in range(n))
        texts.append(text + rng.choice(["", "", " X" * 40, "#", "é" * 10, "\x0b|"]))
    texts += [rng.choice(texts) for _ in range(60)] + ["", None, None, "é" * 3000, "A " * 30000]
    rows = rows_of(texts)
    rows += [(None, texts[3], "s1", "en", 1, "p", 2, 3), (None, None, None, None, 1, "p", 2, 3), rows[4], rows[4]]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 170, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    docs, told = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs, told).collect()
    expected = plain_audit(rows, labels)
    assert len(got) == len(expected) == 4 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == expected
    assert filter_audit.audit_filters(docs.limit(0), told.limit(0)).count() == 0


PARAGRAPH = "<p>" + "Long enough prose, with commas, and words that go on for quite a while so that it counts as a paragraph. " * 2 + "</p>"


def nested_page(rng, n):
    """A page whose article lies in n sections, alike in tag and class and each under some containers; and its headings."""
    wraps = [rng.choice(["<div class=part>", "<section class=chapter>", "<div>", "<section>"]) for _ in range(rng.randint(1, 4))]
    close = "".join("</" + w[1:].split()[0].strip(">") + ">" for w in reversed(wraps))
    parts = [f"{''.join(wraps)}<h2>Part {i}</h2>{PARAGRAPH if i < n - 1 or rng.random() < 0.5 else '<p>Short end.</p>'}{close}" for i in range(n)]
    around = "<nav><a href=a>Home</a><a href=b>About us</a></nav><div class=sidebar><p>Other things, to read, here.</p></div>"
    return f"<html><body>{around}<div id=content>{''.join(parts)}</div><footer>All rights, reserved.</footer></body></html>"


def test_nested_and_sibling_sections():
    from tracefold.llm.html_extract import main_text

    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(2, 9)
        text = main_text(nested_page(rng, n))
        assert [x for x in text.split("\n") if x.startswith("Part")] == [f"Part {i}" for i in range(n)]
        assert "Other things" not in text and "rights" not in text and "Home" not in text
    text = main_text(f"<body><nav><a href=x>Home</a></nav>{f'<section>{PARAGRAPH}</section>' * 5}<section><h2>End</h2><p>Short.</p></section></body>")
    assert text.count("\n") == 6 and text.endswith("End\nShort.")
    # wrongly named containers, however many
    for depth in (1, 9, 3000):
        assert main_text("<div class=sidebar>" * depth + PARAGRAPH * 3 + "</div>" * depth).count("Long enough") == 6


def test_no_secret_is_written(spark, tmp_path, monkeypatch):
    from tracefold.llm import _shared, secret_scan

    monkeypatch.setattr(_shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, 'password = "hunter2Xq9" AKIA' + "ABCD1234" * 3, "a"), (2, "nothing", "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.n_assign, r.n_access) for r in secret_scan.scan_documents(docs).collect()) == [(1, 1, 1), (2, 0, 0)]
    tables = list(tmp_path.iterdir())
    assert tables
    for row in [r for path in tables for r in spark.read.parquet(str(path)).collect()]:
        assert "hunter2Xq9" not in str(row) and "ABCD1234" not in str(row)
