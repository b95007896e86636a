"""Tokenizer alignment, main text of pages and hard negatives against brute force."""

import collections
import hashlib
import html
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstat.llm import alignment, negatives, pagetext

A_FILE, B_FILE = alignment.vocabularies()


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def aligned(tokenizers, text):
    """Tokens of both sides, groups and linked ids of one text, by a walk over both lists of ends."""
    a, b = tokenizers
    none = ([], [], [], [])
    if not text:
        return none
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    decode = {c: x for c, x in zip([chr(x) for x in range(256)], range(256)) if 33 <= x < 127 or 161 <= x < 173 or x >= 174}
    decode |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if chr(x) not in decode)}
    bytes_a = [bytes(decode[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return none
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i), ends_b.index(end, j)
        groups.append(f"{','.join(map(str, ids_a[i:k + 1]))}|{','.join(map(str, ids_b[j:m + 1]))}")
        links.append((ids_a[k], ids_b[m]))
        i, j = k + 1, m + 1
    return ids_a, ids_b, groups, links


def odd_texts():
    r = random.Random(1)
    fixed = ["", None, " ", "a", "  b", " lead", "trail ", "a\n\nb", "▁x", "a▁", "<|endoftext|> x</s> <s> <unk>", "é😀\x00\x01", "a\tb\r\nc", "　全角 テスト", "x" * 5000, " " * 300, "<0x41>", "\n", "the of the of the"]
    return fixed + ["".join(r.choice("ab \n\té😀.▁'1") for _ in range(r.randint(1, 30))) for _ in range(120)] + ["long words here " * 20_000]


def test_alignment(spark, tokenizers):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a null id"), (18, texts[18]), (18, texts[18]), (7, "another text")]
    links = [aligned(tokenizers, t) for _, t in rows]
    count = collections.Counter(x for *_, found in links for x in found)
    highest = collections.defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    want = collections.Counter()
    for (i, _), (a, b, groups, found) in zip(rows, links):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want[i, len(a), len(b), len(groups), len(found), sum(count[x] == highest[x[1]] for x in found), sum(count[x] for x in found), digest] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bundle", F.lit("clash")).withColumn("pair", F.lit("clash")).repartition(5)
    got = alignment.align_tokenizers(df, A_FILE, B_FILE)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want
    assert alignment.align_tokenizers(df.limit(0), A_FILE, B_FILE).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align_tokenizers(blank, A_FILE, B_FILE).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_in_small_bundles(spark, tokenizers, monkeypatch):
    """Sums don't depend on how texts are bundled."""
    both = alignment.Aligner(A_FILE, B_FILE)
    texts = [t for t in odd_texts() if t is None or len(t) < 6000]
    whole = both.align(pa.array(texts, pa.string()))
    single = [both.align(pa.array([t], pa.string())) for t in texts]
    for k in range(3):
        assert whole[k].tolist() == [int(s[k][0]) for s in single]
    assert whole[3] == [s[3][0] for s in single] and whole[4].tolist() == [x for s in single for x in s[4].tolist()]
    assert list(alignment._slices([5, 5, 5, 100, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(alignment._slices([], 10)) == []


PROSE = "Some paragraph of text that goes on, for the sake of a test, with commas and a full stop."
PAGES = {
    "": "", "no markup at all": "no markup at all", "<!-- never closed": "", "a < b &amp;&nbsp; c<br>d": "a < b & c d",
    "<article>a<script>var x = '</p>'": "a",
    "<head><title>x</title><p>implied body": "implied body",
    "<main><header><h1>T</h1></header><p class='ad'>buy</p><p>text</p><section id=comments><article>first!</article></section></main>": "T\n\ntext",
    "<nav><ul><li><a href=1>Home</a></ul></nav><article><p>one</p><aside>side</aside><p>two</p></article><article><p>three</article><footer>&copy; x</footer>": "one\n\ntwo\n\nthree",
    "<article><form>name <input></form><svg/><p>x<svg><text>q</text></svg>y</p><table><tr><td>1<td>2</table><p hidden>no</article>": "x\n\ny\n\n1 2",
    "<div class=ad>x<div>y</div>z</div>plain words": "plain words",
    f"<body><div id=nav><a href=1>Home</a> <a href=2>News</a></div><div class='content'><h1>Title</h1><p>{PROSE}</p><div class='ad-box'>Buy now, {PROSE}</div><p>{PROSE} See <a href=x>this</a>.</p>"
    f"<ul><li>one item</li><li><a href=1>linked item</a></li><li>last item</li></ul></div><div><div><div>&copy; 2020 site</div></div></div><div class='comments'><p>First! {PROSE}</div></body>":
        f"Title\n\n{PROSE}\n\n{PROSE} See this.\n\none item\n\nlinked item\n\nlast item",
    f"<div role=navigation>{PROSE}</div><div>{PROSE}</div><div style='display: none'>{PROSE}</div><div class='cookie-notice'>{PROSE}</div>": PROSE,
    "<p a='>'>quoted &gt;</p><P>upper</P><p b=it's>mark</p>": "quoted >\n\nupper\n\nmark",
}


def test_main_text(spark):
    for page, want in PAGES.items():
        assert pagetext.main_text(page) == want, page
    rows = [(i, f"u{i}", p) for i, p in enumerate(PAGES)] + [(100, None, None), (None, "x", "<p>null id"), (0, "u0", ""), (0, "u0", ""), (101, "long", "<article>" + f"<p>{PROSE}" * 20_000)]
    got = pagetext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = collections.Counter((i, u, t, len(t)) for i, u, p in rows for t in ["\n\n".join([PROSE] * 20_000) if u == "long" else PAGES.get(p or "", "null id")])
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert pagetext.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_generated_pages():
    """Pages of many shapes around a known article."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéß&<'") for _ in range(r.randint(1, 9))).strip() or "x"
    sentence = lambda n: " ".join(word() for _ in range(n))
    for _ in range(300):
        title, body = sentence(r.randint(1, 8)), [sentence(r.randint(1, 60)) for _ in range(r.randint(0, 9))]
        e = html.escape
        around = lambda: r.choice([
            f"<nav><ul>{''.join(f'<li><a href=/x>{e(word())}</a>' for _ in range(5))}</ul></nav>", f"<div class='ad'>{e(sentence(12))}</div>", f"<!-- <p>{e(sentence(3))} -->",
            f"<aside><p>{e(sentence(30))}</p></aside>", f"<form><p>{e(sentence(5))}<input name=q></form>", "<script>if (a < b) document.write('<p>no</p>')</script>", "<style>p > b {}</style>", ""])
        parts = [f"<h1>{e(title)}</h1>"] + [f"<p>{e(b)}{r.choice(['', '<br>', '</p>', ' <b>', chr(10)])}" for b in body]
        article = "".join(p + (around() if r.random() < 0.2 else "") for p in parts)
        page = f"<!DOCTYPE html><html><head><title>{e(title)}</title></head><body><header>{e(word())}</header>{around()}<article>{article}</article>{around()}<footer>{e(sentence(6))}</footer>" + r.choice(["</body></html>", ""])
        assert pagetext.main_text(page) == "\n\n".join(" ".join(x.split()) for x in [title, *body]), page


@pytest.mark.parametrize("page", ["<a \"" * 200_000, "<!--" * 200_000, "<script>" * 100_000, "<div>" * 100_000 + "</div>" * 100_000, "<div><p class=advert>" * 50_000 + "</div>" * 50_000, "<p =" * 200_000, "&" * 500_000])
def test_main_text_in_linear_time(page):
    import time

    start = time.process_time()
    pagetext.main_text(page)
    assert time.process_time() - start < 10


def brute_negatives(rows, anchors, k=5, m=10):
    """``rows``: id to (label, whole-number vector)."""
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = set()
    for a in anchors:
        label, v = rows[a]
        others = sorted((-score(v, w), i, g) for i, (g, w) in rows.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in others if x[2] == label][:k]:
            fit = [(-t, i) for t, i, g in others if g != label and -30 * s <= -100 * t <= -90 * s][:m]
            out |= {(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fit, 1)}
    return out


def test_hard_negatives(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 8))
    v = centres[r.integers(0, 12, 900)] + 0.3 * r.standard_normal((900, 8))
    v[100:160] = v[40]  # ties
    v[300:340] = 0.0
    labels = r.integers(0, 4, 900).tolist()
    rows = [(i, [float(x) for x in v[i]], labels[i]) for i in range(900)]
    odd = [(1000, None, 1), (1100, [float("nan")] * 8, 1), (1200, [None] * 8, 1), (1300, [1.0] * 8, None), (1400, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (1500, [1.0, 2.0], 1), (1501, [1.0, 1.0], 1), (1502, [0.5, 0.5], 2), (1600, [], 1), (40, rows[40][1], labels[40])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("shard", F.lit("clash")).repartition(4)
    usable = {i: ((g + 1) % 10 if i % 7 == 0 else g, np.floor(256 * np.array(x, float))) for i, x, g in rows + odd if i is not None and g is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    want = brute_negatives(usable, [i for i in usable if i % 100 == 0])
    label = "IF(id % 7 = 0, (label + 1) % 10, label)"
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = negatives.hard_negatives(df, "id % 100 = 0", label).collect()
    assert len(got) == len(want) and {tuple(x[c] for c in names) for x in got} == want and len(want) > 200
    monkeypatch.setattr(negatives, "SHARD_ROWS", 100)
    monkeypatch.setattr(negatives, "SPAN", 4)
    assert {tuple(x[c] for c in names) for x in negatives.hard_negatives(df, "id % 100 = 0", label).collect()} == want
    assert negatives.hard_negatives(df.limit(0), "id % 100 = 0").count() == 0


def test_hard_negatives_of_large_components(spark):
    """Products that doubles can't hold are summed exactly."""
    r = np.random.default_rng(5)
    rows = [(i, (r.integers(-(2**28), 2**28, 4) / 256).tolist(), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_negatives({i: (g, np.floor(256 * np.array(x))) for i, x, g in rows}, [0, 20, 40])
    got = {tuple(x) for x in negatives.hard_negatives(df, "id % 20 = 0").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}
    assert got == want and max(x[4] for x in want) > 2**53
    huge = spark.createDataFrame([(0, [1e308, 1.0], 1), (1, [1e308, 2.0], 1), (2, [9e307, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(huge, "id = 0").count() <= 1


def test_bounds_skip_cells():
    """On vectors in clusters a search ends long before it has seen all rows of the label."""
    r = np.random.default_rng(1)
    n = 8192
    c = r.standard_normal((30, 64))
    v = np.floor(64 * (c[r.integers(0, 30, n)] + 0.15 * r.standard_normal((n, 64))))
    labels, ids = r.integers(0, 10, n), np.arange(n)
    index = negatives.MultiIndex(ids, labels, v)
    for a in range(40):
        s = (v @ v[a]).astype("int64")
        m = np.flatnonzero((labels == labels[a]) & (ids != a))
        assert index.positives(a, int(labels[a]), v[a], 5) == [(int(s[i]), int(i)) for i in m[np.lexsort((m, -s[m]))[:5]]]
    assert index.visited / 40 < 0.25 * n / 10
