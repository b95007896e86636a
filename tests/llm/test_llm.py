"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillstat.llm import ann, chat, langid, licenses, linededup, mixing, neardup, packing, quality, queries, repeats
from quillstat.llm.components import connected_components
from quillstat.llm.suffixes import common_prefixes, suffix_array

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "component_id string, kept string, shard string, key string, id string, host string, part string"


def text(seed, n, lines=5):
    r = np.random.default_rng(seed)
    words = [WORDS[i % len(WORDS)] + str(i // len(WORDS)) for i in r.integers(0, 2000, n)]
    return "\n".join(" ".join(words[k::lines]) for k in range(lines))


def nasty_rows():
    base = text(1, 300)
    near = base.replace(base.split()[10], "changed", 1)
    passage = " ".join(text(2, 60, 1).split())
    rows = [
        (1, base, "en", "src0"), (2, near, "en", "src0"), (3, base, "de", "src1"), (3, base, "de", "src1"), (4, None, None, None), (5, "", "en", "src0"), (6, " \t\n\r ", None, "src1"),
        (7, "one", "en", None), (8, "One", "en", "src0"), (9, text(3, 4000), "fr", "src0"), (10, text(4, 200) + "\n" + passage, "en", "src0"), (11, passage + " " + text(5, 150), "en", "src0"),
        (12, "same line here with some words\n" * 6, "en", "src0"), (13, "Ünïcödé ß 東京  x  y\n\n\n# $ & | < >", "de", "src2"), (14, "x" * 3000, "en", "src0"),
        (None, base, "en", "src0"), (-5, near + " tail", "en", "src9"), (15, "This work: CC BY 4.0, all  RIGHTS\nreserved. cc-by", "en", "src0"), (16, "a\x00b\x00" * 60, "en", "src0"), (17, "a\x00b\x00" * 60, "en", "src0"),
    ]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def nasty(spark):
    df = spark.createDataFrame(nasty_rows(), SCHEMA)
    for c in EXTRA.split(", "):
        df = df.withColumn(c.split()[0], F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, k):
    w = words_of(ascii_lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def test_line_dedup(nasty, empty):
    lines = [(i, k, frozenset(words_of(ascii_lower(x)))) for i, t, *_ in nasty_rows() if i is not None and t for k, x in enumerate(t.split("\n"))]
    lines = sorted({x for x in lines if len(x[2]) >= 5}, key=lambda x: x[:2])
    gone = {y[:2] for n, y in enumerate(lines) if any(100 * len(x[2] & y[2]) >= 80 * len(x[2] | y[2]) for x in lines[:n])}
    got = linededup.without_repeated_lines(nasty)
    assert set(nasty.columns) < set(got.columns)
    for r in got.collect():
        source = next(t for i, t, *_ in nasty_rows() if i == r.doc_id)
        want = None if source is None else "\n".join(x for k, x in enumerate(source.split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == want, r.doc_id
        assert r.n_removed == (0 if source is None else source.count("\n") - want.count("\n") if want or source.count("\n") + 1 > r.n_removed else r.n_lines)
    assert linededup.without_repeated_lines(empty).count() == 0


def test_line_dedup_large_groups(spark):
    """More lines share common tokens than a small group holds."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for d in range(220):
        w = list(base)
        for j in r.integers(0, 30, d % 9):
            w[j] = f"v{r.integers(0, 40)}"
        rows.append((d, " ".join(w)))
    sets = [frozenset(t.split()) for _, t in rows]
    gone = {y for y in range(len(sets)) if any(100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) for x in range(y))}
    got = {x.doc_id for x in linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == gone and 0 < len(gone) < 220


def test_line_dedup_repeated_rows_in_a_large_group(spark):
    """Equal rows in several partitions: their lines share common words with more lines than a small group holds, but most are similar to none."""
    r = np.random.default_rng(9)
    often = [f"c{i}" for i in range(400)]
    rows = [(d, " ".join([f"w{i}" for i in range(50)] + r.choice(often, 10, replace=False).tolist())) for d in range(300)] + [(900, " ".join(often * 600))]
    sets = [frozenset(t.split()) for _, t in rows]
    gone = {rows[y][0] for y in range(301) if any(100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) for x in range(y))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id for x in linededup.repeated_lines(df.unionByName(df.where("doc_id < 60")).unionByName(df.where("doc_id < 30"))).collect()}
    assert got == gone and len(gone) < 30


def test_line_filters_lose_nothing():
    r = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(r.integers(0, 60, r.integers(5, 30)))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.12], r.integers(0, 60, r.integers(0, 4))]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            common = np.intersect1d(a, b)[0]
            x, y = np.array([len(a)]), np.array([len(b)])
            zero = np.zeros(1, "uint64")
            bits = [np.array([np.bitwise_or.reduce(np.uint64(1) << v.astype("uint64"))]) for v in (a, b)]
            assert linededup._may_match(80, x, np.array([np.searchsorted(a, common)]), bits[0], zero, y, np.array([np.searchsorted(b, common)]), bits[1], zero)[0]


def brute_components(rows, k):
    sets = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            sets[i].add(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(nasty, empty):
    want = brute_components(nasty_rows(), 4)
    rows = neardup.near_duplicates(nasty, shingle=4).collect()
    assert len(rows) == len(nasty_rows())
    for r in rows:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is not None and want[r.doc_id] == r.doc_id)
        assert r.n_shingles == len(shingles(next(t for i, t, *_ in nasty_rows() if i == r.doc_id), 4))
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.deduplicated(nasty, shingle=5)
    assert left.columns == nasty.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(3) == 0 and ids.count(None) == 1 and {-5, 4, 5, 6} <= set(ids)


def test_near_duplicates_chain(spark):
    """A large group whose members are linked by way of others only."""
    r = np.random.default_rng(5)
    w = [f"a{i}" for i in range(60)]
    rows = []
    for d in range(150):
        if d % 3 == 0:
            w = list(w)
            w[r.integers(0, 60)] = f"b{d}"
        v = list(w)
        for j in r.integers(0, 60, d % 4):
            v[j] = f"c{d}"
        rows.append((d, " ".join(v)))
    want = brute_components(rows, 4)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == want


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """Ids with two unlike texts each, and documents near the second one: no link is lost, in any partitioning."""
    def words(seed, n=60):
        r = np.random.default_rng(seed)
        return [f"x{i}" for i in r.integers(0, 10**6, n)]

    rows = []
    for d in range(60):
        a, b = words(2 * d), words(2 * d + 1)
        near = list(b)
        near[0] = "changed"
        rows += [(d, " ".join(a)), (d, " ".join(b)), (1000 + d, " ".join(near))]
    rows += [(2000, ""), (2000, rows[2][1]), (2001, None), (2001, "word")]
    want = brute_components([(i, t) for i, t in rows], 4)
    assert sum(want[1000 + d] == d for d in range(60)) == 60 and want[2000] == 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 8):
        got = neardup.near_duplicates(df.repartition(parts), shingle=4).collect()
        assert len(got) == len(rows) and {x.doc_id: x.component_id for x in got} == want


def test_near_duplicates_family(spark):
    """Texts of one template: each linked pair has many smaller ids that are similar to it, but not enough."""
    rows = []
    for f in range(6):
        base = [f"t{f}_{i}" for i in range(80)]
        for k in range(22):
            d = 22 * f + k
            rows.append((d, " ".join(base + [f"own{d}_{i}" for i in range(14 if k < 20 else 8)])))
    sets = [shingles(t, 1) for _, t in rows[:22]]
    assert all(0.7 < len(x & y) / len(x | y) < 0.8 for x in sets[:20] for y in sets if x is not y) and len(sets[20] & sets[21]) / len(sets[20] | sets[21]) > 0.8
    want = brute_components(rows, 1)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()}
    assert got == want and sum(i != c for i, c in want.items()) == 6


def test_hamming_keys_lose_nothing():
    r = np.random.default_rng(1)
    a = r.integers(0, 65536, (300, neardup.POSITIONS)).astype("uint16")
    b = a.copy()
    for i in range(300):
        at = r.permutation(neardup.POSITIONS)[: neardup.DISTANCE]
        b[i, at] ^= 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 7, 8, 9], 1), 20: 20, 21: 20}


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((400, 8))
    v[50:90] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (504, [1.0, 2.0]), (None, [1.0] * 8), (550, [1e200] * 8), (7, [float(x) for x in v[7]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for x in ann.nearest(df, "id % 50 = 0").orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    ids, m = np.append(np.arange(400), 550), np.vstack([v, np.full(8, 1.0)])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q in got:
        s = unit @ unit[list(ids).index(q)]
        want = sorted((-round(x, 12), int(i)) for i, x in zip(ids, s) if i != q)[:5]
        hits += len({i for _, i in want} & {i for _, i, _ in got[q]})
        total += 5
        assert [k for k, _, _ in got[q]] == [1, 2, 3, 4, 5] and all(abs(x - s[list(ids).index(i)]) < 1e-12 for _, i, x in got[q])
    assert hits / total >= 0.9
    assert [i for _, i, _ in got[50]] == [7, 51, 52, 53, 54]  # ties go to smaller ids
    few = spark.createDataFrame([(50, [1.0, 0.0]), (51, [0.0, 1.0]), (52, [1.0])], "vec_id long, embedding array<double>")
    assert [(x.query_id, x.vec_id) for x in ann.nearest(few, "id % 50 = 0").collect()] == [(50, 51)]
    assert ann.nearest(few.limit(0), "id % 50 = 0").count() == 0


def test_few_vectors_are_verified():
    """Most of the index stays unverified while at least nine of ten neighbours are found, on spread and on clustered vectors of several sizes."""
    r = np.random.default_rng(7)
    for n, clusters in ((8192, 0), (16384, 0), (16384, 100)):
        v = r.standard_normal((n, 64)) if not clusters else r.standard_normal((clusters, 64))[r.integers(0, clusters, n)] + 0.4 * r.standard_normal((n, 64))
        index = ann.CollisionIndex(np.arange(n), np.zeros(n), v)
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        asked = list(range(0, n, n // 40))
        got = collections.defaultdict(set)
        for q, i, _ in index.search(asked, v[asked], 5):
            got[q].add(i)
        hits = 0
        for q in asked:
            s = unit @ unit[q]
            s[q] = -2
            hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
        assert hits >= 0.9 * 5 * len(asked) and index.verified < 0.05 * n * len(asked), (n, clusters, hits, index.verified / n / len(asked))


def test_encoder_and_packing(spark, nasty, empty):
    fresh = Tokenizer.from_file(packing.vocabulary())
    rows = collections.Counter()
    for i, t, *_ in nasty_rows():
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            rows[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = packing.pack_documents(nasty, packing.vocabulary()).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == rows
    by = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(empty, packing.vocabulary()).count() == 0


def test_special_strings_keep_their_own_id():
    """The plain tokenizer call: the string of a special token is that token, and only plain_specials makes it text."""
    r = np.random.default_rng(2)
    parts = ["<|endoftext|>", "a", " ", "\n", "word", "<|end", "oftext|>", "é", "  "]
    texts = ["".join(r.choice(parts, r.integers(1, 9))) for _ in range(400)] + ["x <|endoftext|> y", "<|endoftext|>", None, ""]
    for plain in (False, True):
        fresh = Tokenizer.from_file(packing.vocabulary())
        fresh.encode_special_tokens = plain
        enc = packing.Encoder(packing.vocabulary(), plain)
        for lead in ("", " "):
            got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(pa.array(texts), lead)]
            assert got == [fresh.encode(lead + (t or ""), add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(packing.Encoder(packing.vocabulary()).encode(pa.array(["x <|endoftext|>"]))[0], "<u4").tolist()


def test_packing_spreads_equal_rows(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack_documents(rows, packing.vocabulary(), group_rows=256).groupBy(F.shiftrightunsigned("sequence_id", 33).alias("g")).count().collect()
    assert len(got) == 16 and max(r["count"] for r in got) < 512 and sum(r["count"] for r in got) == 4000


def test_long_texts(spark):
    """A text of half a million characters among short ones: measures, pieces and removed bytes are those of the whole text."""
    long = " ".join(f"w{i}" for i in range(80_000))
    df = spark.createDataFrame([(1, "short one"), (2, long), (3, long[:100] + " other " + long[-60:])], "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    assert {r.doc_id: r.n_words for r in quality.quality_rules(df).collect()}[2] == 80_000
    got = {r.doc_id: r.tokens for r in packing.pack_documents(df, packing.vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("tokens")).collect()}
    assert got[2] == len(Tokenizer.from_file(packing.vocabulary()).encode(long, add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.n_removed for r in repeats.without_repeats(df).collect()} == {1: 0, 2: 0, 3: 100 + 60 + (long[100] == " ") + (long[-61] == " ")}
    sizes = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle=4).collect()}
    assert sizes[2] == (79_997, 2) and sizes[3][1] == 3
    assert {r.doc_id: r.n_words for r in licenses.license_scan(df).collect()}[2] == 80_000
    assert {r.doc_id: r.n_removed for r in linededup.without_repeated_lines(df).collect()} == {1: 0, 2: 0, 3: 0}


def test_best_fit_bounds_open_bins():
    bins, offsets = packing.best_fit([6, 5, 4, 3, 3, 2, 1], 10, 2)
    assert bins == [0, 1, 0, 1, 2, 1, 2] and offsets == [0, 0, 6, 5, 0, 8, 3]
    bins, _ = packing.best_fit([9, 8, 7, 3, 2, 1], 10, 1)  # the fullest closes first
    assert bins == [0, 1, 2, 2, 3, 3]


def test_suffix_array():
    r = np.random.default_rng(4)
    for trial in range(60):
        t = [*r.integers(1, 1 + r.integers(1, 6), r.integers(1, 80)).tolist(), 0]
        assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    data = np.frombuffer(b"banana bandana banana\0", "uint8")
    sa = suffix_array(np.append(data[:-1].astype("int64") + 1, 0))
    got = common_prefixes(data, sa, np.array([0, 15, 7]), 50)
    assert sorted(got.tolist())[-1] == 6


def test_repeats(nasty, empty):
    first, want = {}, {}
    rows = sorted((i, (t or "").encode()) for i, t, *_ in nasty_rows() if i is not None)
    for i, x in rows:
        for k in range(len(x) - 49):
            first.setdefault(x[k : k + 50], i)
    for i, x in rows:
        gone = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        want[i] = (len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept) if len(x) else (0, 0, 0, b"")
    got = repeats.without_repeats(nasty).collect()
    assert len(got) == len(nasty_rows())
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert repeats.without_repeats(empty).count() == 0


def test_mixing_budgets(spark):
    sizes = spark.createDataFrame([("d", "en", "a", 100), ("d", "en", "b", 1000), ("d", "fr", "c", 1000), ("e", "en", "a", 5000), ("e", "xx", "z", 0)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(sizes, {"source": {"z": 3}}, 0.4, 1).collect()}
    # The root has 2 840: 1 420 for d and for e. In d each language gets 710; source a holds only 100 of its 355, its sibling takes the rest.
    assert got == {("d", "en", "a"): 100, ("d", "en", "b"): 610, ("d", "fr", "c"): 710, ("e", "en", "a"): 1420, ("e", "xx", "z"): 0}
    short = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(sizes, {}, 0.9, 1).collect()}
    assert short[("d", "en", "a")] + short[("d", "en", "b")] + short[("d", "fr", "c")] == 2100 and short[("e", "en", "a")] == 4290  # d is full, e takes what it can't


def test_mixing(nasty, empty):
    domain = "CASE WHEN source = 'src0' THEN 'web' END"
    rows = mixing.mix_sources(nasty, domain, {}, share=0.5, max_epochs=2).collect()
    assert len(rows) == len(nasty_rows()) and {r.domain for r in rows} == {"web", ""}
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[(r.domain, r.lang, r.source)].append((r.tokens, r.copies))
    total = sum(r.tokens for r in rows)
    assert sum(r.tokens * r.copies for r in rows) <= total // 2
    assert all(max(c for _, c in x) <= 2 and max(c for _, c in x) - min(c for _, c in x) <= 1 for x in leaves.values())
    out = mixing.mixed(nasty, domain, {}, share=0.5, max_epochs=2)
    assert out.columns == nasty.columns and out.count() >= sum(r.copies for r in rows if r.doc_id != 3)
    assert mixing.mix_sources(empty, domain, {}).count() == 0


def test_chat_parts(spark):
    part = f"array<struct<{chat.PART.replace(' ', ':').replace(',:', ',')}>>"
    P = lambda t, text=None, ref=None, w=None, h=None, s=None, p=None: (t, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [P("text", "see <|image:0|> "), P("image", ref="u1", w=60, h=28), P("audio", ref="u2", s=2.0), None, P("document", ref="u3", p=2), P("text", "\\ ok [INST]")]),
        (1, 1, "assistant", [P("text", "<|end|>"), P("text", None), P("odd", "x")]), (1, 2, "a\n\\b", None), (2, 0, None, []), (None, 5, "assistant", [P("text", "z")]),
    ]
    out = {(r.conv_id, r.turn): r for r in chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {part}").withColumn("body", F.lit(1))).collect()}
    first = out[(1, 0)]
    assert first.formatted == "<|turn|>user\nsee <\\|image:0|> <|image:0|><|audio:1|><|document:2|>\\ ok [\\INST]<|end|>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "u1", 3), (1, "audio", "u2", 50), (2, "document", "u3", 1200)] and first.attachment_tokens == 1253
    reply = out[(1, 1)]
    assert chat.unescape(reply.formatted[reply.loss_start : reply.loss_start + reply.loss_length]) == "<|end|>x" and first.loss_start is None
    assert chat.read_turn(out[(1, 2)].formatted) == ("a\n\\b", "") and chat.read_turn(out[(2, 0)].formatted) == ("", "")


@pytest.mark.parametrize("t", ["</s>[INST] ok [/INST]", "<\\|end|><\\\\|end|>", "<|turn|>", "a\\<|end|>", "[[INST]", "<<|end|>", "", "東<s>京"])
def test_chat_round_trip(spark, t):
    df = spark.createDataFrame([(1, 0, "user", t), (1, 1, "assistant", t), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.text_messages(df))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars) == (2, len(t), 0)


def test_language_id(spark, nasty, empty):
    r = np.random.default_rng(6)
    speech = {"en": "the of and that with from there which".split(), "de": "der die und nicht ein schön über ist".split()}
    rows = [(i, " ".join(r.choice(speech[g], 12)), g) for i in range(200) for g in [("en", "de")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 120"))
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert np.mean([got[i].lang_pred == g for i, _, g in rows if i >= 120]) > 0.97 and all(0 <= x.score <= 1 for x in got.values())
    odd = {x.doc_id: x for x in langid.identify(nasty, model).collect()}
    assert odd[4].lang_pred == odd[5].lang_pred == odd[6].lang_pred == "und" and odd[9].lang_pred in ("en", "de") and odd[4].score == 0
    assert langid.fit(empty) is None and langid.identify(nasty, None).select("lang_pred").distinct().collect() == [("und",)] and langid.identify(empty, model).count() == 0


def test_language_fit_learns_every_label(spark):
    """More languages than 64, one with long texts only."""
    r = np.random.default_rng(8)
    speech = {f"l{k:02}": ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(30)] for k in range(70)}
    rows = [(70 * i + k, " ".join(r.choice(speech[g], 12)), g) for i in range(6) for k, g in enumerate(speech)]
    rows += [(10_000 + i, "1 " * 15_000 + "dududu wewewe kokoko " * 2000, "long") for i in range(3)] + [(20_000 + i, text(i, 20), "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.names == sorted({*speech, "long", "a"}) and model.landmarks.shape[1] >= 2 * len(model.names)
    got = {x.doc_id: x.lang_pred for x in langid.identify(df, model).collect()}
    assert np.mean([got[i] == g for i, _, g in rows]) > 0.9 and got[10_000] == "long"


def test_quality(spark, nasty, empty):
    got = quality.quality_rules(nasty)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(nasty_rows())
    for i, t, *_ in nasty_rows():
        w = words_of(t)
        r = rows[i]
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {k + o for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    assert quality.quality_rules(empty).count() == 0
    common = "This  very line is on every page of the host"
    docs = spark.createDataFrame([(i, f"{common}\n{text(100 + i, 80)}\n{common.lower()}", "h") for i in range(30)] + [(99, common + "\n" + common + " x\n" + " ".join(WORDS * 3), "other"), (98, "\n".join([common] * 9), "h")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.quality_rules(docs, max_docs=10, max_share=0.1).collect()}
    assert found[3].n_removed_words == 20 and found[3].kept and found[99].n_removed_words == 0 and not found[98].kept
    left = {r.doc_id: r.text for r in quality.apply_quality_rules(docs, max_docs=10, max_share=0.1).collect()}
    assert left[3] == text(103, 80) and 98 not in left


def test_quality_counts_documents(spark):
    """Documents are counted, equal texts or not: rows of one id are one document, rows without id one each."""
    line = "This line is on many documents of the host"
    same = line + "\n" + text(1, 80)
    rows = [(i, same if i < 25 else line + "\n" + text(i, 80), "h") for i in range(30)] + [(100 + i, text(200 + i, 80), "h") for i in range(5)]
    rows += [(None, line + " x\n" + text(300, 80), "h")] * 12 + [(500, line + " y\n" + text(301, 80), "h")] * 12
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), max_docs=10, max_share=0.1).collect()
    gone = {r.doc_id: r.n_removed_words for r in got}
    assert all(gone[i] > 0 for i in range(30)) and gone[None] > 0 and gone[500] == 0 and all(gone[100 + i] == 0 for i in range(5)) and len(got) == len(rows)


def test_licenses(nasty, empty):
    assert len(licenses.FAMILIES) + len(licenses.WRITTEN) > 200 and max(r[3].count(" ") for r in licenses.rules()) < licenses.REACH and all(any(g in k for g in licenses.GATE) for _, _, k, *_ in licenses.rules())
    got = licenses.license_scan(nasty).collect()
    assert len(got) == len(nasty_rows())
    for r in got:
        t = next(t for i, t, *_ in nasty_rows() if i == r.doc_id)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.license_scan(empty).count() == 0


def test_license_suppression(spark):
    rows = [(1, "GNU General Public License, version 2 or any later version"), (2, "licensed under the Apache License, Version 2.0"), (3, "see cc by sa 4.0 here, and MIT license")]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "gpl,gpl-2-or-later", 2: "apache-2.0,license-notice", 3: "cc-by,cc-by-sa-4.0,mit"}


def alternatives(parsed):
    """Strings of a parsed regular expression: every branch and both sides of every option, one digit of each class."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "BRANCH":
            own = [x for b in arg[1] for x in alternatives(b)]
        elif name == "SUBPATTERN":
            own = alternatives(arg[3])
        elif name == "MAX_REPEAT":
            own = [x * n for n in {arg[0], arg[1]} for x in alternatives(arg[2])]
        elif name == "IN":
            own = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        else:
            own = [""]  # the words around it
        out = list(dict.fromkeys(a + b for a in out for b in own))
    return out


def test_license_alternatives(spark):
    """Every alternative of every rule gets past the keywords, and a scan labels it as the rules do without them."""
    rules = licenses.rules()
    written = {}
    for rule, _, keyword, pattern, *_ in rules:
        for x in alternatives(re._parser.parse(pattern)):
            assert keyword in x and any(g in x for g in licenses.GATE), (x, keyword)
            if "," not in x and "  " not in x:  # strings that words can make
                written[x] = rule
    want = {}
    for k, x in enumerate(written):
        found = [(m.start(), m.end(), *r) for r in rules for m in re.finditer(r[3], f" {x} ")]
        assert any(f[2] == written[x] for f in found)
        left = [d for d in found if not any(e[2] != d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[6], e[1] - e[0], -e[2]) > (d[6], d[1] - d[0], -d[2]) for e in found)]
        base = {label for p, label in licenses.BASE if f" {p} " in f" {x} "}
        want[k] = (",".join(sorted({d[3] for d in left} | base)), 1.0 if base else max(d[7] for d in left))
    df = spark.createDataFrame(list(enumerate(written)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(df).collect()}
    assert got == want


def test_pipeline_stages(spark, nasty, empty):
    docs = nasty.select(*corpus_pipeline.COLUMNS)
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, empty, "")
        assert none.count() == 0
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS and none.columns == corpus_pipeline.COLUMNS
            rows = out.collect()
            assert all(r.text is None or r.n_chars == len(r.text) for r in rows), name


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert set(queries.QUERIES) <= set(names) and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_licenses_in_long_texts(spark):
    """Very many detections in one text, which is spread over stretches of words: the same labels and counts as rule by rule."""
    unit = "cc by sa 4 0 and gnu general public license version 2 or any later version all rights reserved "
    rows = [(1, unit * 4000), (2, "x " * 63 + unit), (3, "x " * 60 + unit + "y " * 60 + unit)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_base == 3 * 4000 and got[1].first_word == 0 and got[1].last_word == 19 * 4000 - 3
    for i, n in ((1, 4000), (2, 1), (3, 2)):
        assert got[i].labels == "cc-by,cc-by-sa-4.0,gpl,gpl-2-or-later,reserved" and len(got[i].detections) == 3 * n


def test_language_kernel_against_brute_force():
    """Kernel values, the Nyström map and the ridge scores by their definitions, gram by gram."""
    r = np.random.default_rng(4)
    speech = {"a": "the of and there which".split(), "b": "der die und nicht über".split(), "c": "que los una está año".split()}
    langs = [("a", "b", "c")[i % 3] for i in range(45)]
    texts = [" ".join(r.choice(speech[g], 9)) for g in langs]
    model = langid.KernelModel(texts, langs, 12)

    def fold(t):
        return bytes(b + 32 if 65 <= b < 91 else 32 if b < 128 and not chr(b).isalpha() else b for b in t.encode())

    def grams(t):
        t = fold(t)
        codes = [(n, int.from_bytes(t[i : i + n], "big")) for n in langid.ORDERS for i in range(len(t) - n + 1)]
        return {((code + n) * 2654435769 % 2**32) >> (32 - langid.SLOT_BITS) for n, code in codes}

    order = sorted(range(45), key=lambda i: (langs[: i + 1].count(langs[i]), langs[i]))[:12]
    landmarks = [grams(texts[i]) for i in order]
    held = collections.Counter(x for g in landmarks for x in g)
    known = {x for x, n in held.items() if n > 1}
    kernel = lambda x, y: len(x & y & known) / np.sqrt(max(1, len(x & known)) * max(1, len(y & known)))
    asked = texts[:20] + ["", "x", "Über die THE que"]
    want = np.array([[kernel(grams(t), g) for g in landmarks] for t in asked])
    assert np.abs(model.kernel(pa.array(asked)) - want).max() < 1e-5
    between = np.array([[kernel(x, y) for y in landmarks] for x in landmarks])
    values, vectors = np.linalg.eigh(between)
    root = vectors / np.sqrt(np.maximum(values, langid.JITTER))
    mapped = np.array([[kernel(grams(t), g) for g in landmarks] for t in texts]) @ root
    signs = np.array([[1.0 if x == g else -1.0 for x in model.names] for g in langs])
    weights = np.linalg.solve(mapped.T @ mapped + langid.RIDGE * len(texts) * np.eye(12), mapped.T @ signs)
    scores = want @ root @ weights
    best, score = model.predict(pa.array(asked))
    assert best.tolist() == scores.argmax(axis=1).tolist() and np.abs(model.kernel(pa.array(asked)) @ model.scorer - scores).max() < 1e-2


def test_language_sample_is_thresholded(spark):
    """Many rows of one language: the rows learned are the first of its hashed order, as without the threshold."""
    rows = [(i, f"the word {i} of and there", "en") for i in range(6000)] + [(10_000 + i, f"der die und {i}", "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df)
    assert model.names == ["de", "en"]
    got = {x.doc_id: x.lang_pred for x in langid.identify(df, model).collect()}
    assert np.mean([got[i] == g for i, _, g in rows]) > 0.99


def test_chat_odd_conversations(spark):
    """Empty table, repeated turns, columns of other names that clash, and one very long conversation."""
    schema = "conv_id long, turn long, role string, text string"
    none = chat.conversation_digests(chat.format_turns(chat.text_messages(spark.createDataFrame([], schema))))
    assert none.count() == 0
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} <|end|> \\" * (t % 7)) for t in range(6000)]
    rows = long + [(2, 0, "user", "hi"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (3, 0, "assistant", "x" * 400_000)]
    df = spark.createDataFrame(rows, schema).withColumn("content", F.lit("clash")).withColumn("formatted", F.lit("clash")).withColumn("loss_start", F.lit("clash")).repartition(5)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.text_messages(df))).collect()}
    for i in (1, 2, 3):
        mine = [x for x in rows if x[0] == i]
        said = "".join(x[3] for x in mine if x[2] == "assistant")
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest(), i
        assert (got[i].n_turns, got[i].loss_chars, got[i].loss_sha256) == (len(mine), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_pipeline_keeps_clean_documents(spark):
    """Stage by stage on a small corpus: junk, repeated lines and near copies go, the others stay as they are."""
    clean = {i: text(1000 + i, 120) for i in range(12)}
    rows = [(i, t, "en", f"src{i % 2}") for i, t in clean.items()]
    rows += [(100, "too short", "en", "src0"), (101, clean[3].replace(clean[3].split()[5], "changed", 1), "en", "src1"), (102, clean[4].split("\n")[0] + "\n" + text(2000, 90), "en", "src0")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    after = stages["quality_rules"](spark, docs, "")
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t, *_ in rows if i != 100}
    after = {r.doc_id: r.text for r in stages["line_dedup"](spark, after, "").collect()}
    assert {i: after[i] for i in clean} == clean and after[102] == text(2000, 90) and len(after.get(101, "").split("\n")) < 5
    near = spark.createDataFrame([(1, " ".join(clean[1].split()), "en", "s", 0), (2, " ".join(clean[1].split()[:-1]), "en", "s", 0), (3, clean[2], "en", "s", 0)], SCHEMA)
    assert {r.doc_id for r in stages["minhash_near_dedup"](spark, near, "").collect()} == {1, 3}
    mixed = stages["source_mixing"](spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in mixed} <= {(i, t) for i, t, *_ in rows} and len(mixed) == len({r.doc_id for r in mixed}) >= 11
    packed = stages["best_fit_packing"](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {i for i, *_ in rows}
