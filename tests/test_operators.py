"""Operators against brute force on small and skewed fixtures."""

import collections
import datetime
import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from quillstat.functions import fixed
from quillstat.operators import blocked, chunking, mapping, matching, pages, questions, retrieval, stats, windows
from quillstat.session import work_path
from quillstat.streaming import sessions

random.seed(7)


def test_numbered_with_ties_and_a_hot_group(spark):
    rows = [(0 if i % 3 else i % 5, random.choice([1.0, 1.0, 2.5, float(i)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double, id int").repartition(7)
    got = {r["id"]: r["p"] for r in windows.numbered(df, [F.col("v").desc(), F.col("id")], "p", ["g"], partitions=6).collect()}
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in want] == list(range(1, len(want) + 1))


def test_rank_top_k_is_prefix_of_full_rank(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 50)) for i in range(400)], "id int, v double")
    full = {r["id"]: r["rank"] for r in windows.rank(df, "v", tie=["id"]).collect()}
    top = {r["id"]: r["rank"] for r in windows.rank(df, "v", 20, tie=["id"]).collect()}
    assert len(top) == 20 and all(full[i] == k for i, k in top.items())


def test_exact_median(spark):
    rows = [(i % 4, float(random.randint(0, 30))) for i in range(997)] + [(9, 1.0), (9, 4.0)]
    out = stats.exact_median(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).collect()
    assert {r["g"]: r["median"] for r in out} == {g: statistics.median(v for k, v in rows if k == g) for g in {0, 1, 2, 3, 9}}


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_blocked_carry_and_sum(spark, block):
    rows = [(1 if i % 3 else 2, i, (i if random.random() < 0.2 else None)) for i in range(500)]
    df = spark.createDataFrame(rows, "s int, pos int, x int")
    carried = {r["pos"]: (r["x_at"], r["n"]) for r in blocked.running_sum(
        blocked.carry_forward(df, ["s"], "pos", ["x"], block, suffix="_at"), ["s"], "pos", F.coalesce(F.col("x"), F.lit(0)), "n", block).collect()}
    for s in (1, 2):
        last, total = None, 0
        for _, pos, x in [r for r in rows if r[0] == s]:
            last, total = (x if x is not None else last), total + (x or 0)
            assert carried[pos] == (last, total)


def test_carry_is_idempotent(spark):
    df = spark.createDataFrame([(1, i, ("a" if i % 7 == 0 else None)) for i in range(60)], "s int, t int, x string")
    once = questions.carry_slots(df, ["s"], "t", ["x"], 8)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, questions.carry_slots(once, ["s"], "t", ["x"], 8).collect()))


def words(n, alphabet="药业团号企一二三"):
    return ["".join(random.choice(alphabet) for _ in range(random.randint(1, 7))) for _ in range(n)]


def test_contains_join(spark):
    texts, terms = words(120), list(set(words(60)))
    t = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    d = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r["i"], r["term"]) for r in matching.contains_join(t, "text", d, "term").collect()}
    assert got == {(i, x) for i, text in enumerate(texts) for x in terms if x in text}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        prev, row = row, [i]
        for j, cb in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (ca != cb)))
    return row[-1]


@pytest.mark.parametrize("threshold", [70.0, 40.0])
def test_similar_join_misses_nothing(spark, threshold):
    left, right = sorted(set(words(150))), sorted(set(words(150)))
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right], "b string")
    got = {(r["a"], r["b"]) for r in matching.similar_join(a, "a", b, "b", threshold).collect()}
    want = {(x, y) for x in left for y in right if (1.0 - levenshtein(x, y) / max(len(x), len(y))) * 100 >= threshold}
    assert got == want


def test_fields_in_text_prefers_longer(spark):
    t = spark.createDataFrame([(1, "归母净利润和营业收入"), (2, "净利润")], "id int, text string")
    d = spark.createDataFrame([("净利润",), ("归母净利润",), ("收入",), ("营业收入",)], "synonym string")
    got = {(r["id"], r["synonym"]) for r in matching.fields_in_text(t, "id", "text", d, "synonym").collect()}
    assert got == {(1, "归母净利润"), (1, "营业收入"), (2, "净利润")}


def tokens_of(text):
    import re

    han = len(re.findall("[一-鿿]", text))
    return int(han / 1.5 + len(re.findall("[a-zA-Z0-9]", text)) / 3.5 + len(text.split("\n")) * 0.5)


def packed(paragraphs, low, high):
    out, text, size = [], "", 0
    for p in paragraphs:
        n = tokens_of(p)
        if size + n <= high:
            text, size = (text + "\n\n" + p) if text else p, size + n
        else:
            if text and size >= low:
                out.append((text, size))
            text, size = p, n
    return out + ([(text, size)] if text and size >= low else [])


def test_packing_against_a_plain_loop(spark):
    docs = []
    for i in range(12):
        paras = ["字" * random.randint(1, 140) + "a" * random.randint(0, 50) for _ in range(random.randint(1, 15))]
        docs.append((i, paras))
    df = spark.createDataFrame([(i, "# 标题\n\n## 业绩\n" + "\n\n".join(p)) for i, p in docs], "id int, text string")
    got = {}
    for r in chunking.chunks(df, "id", "text", 40, 120).orderBy("id", "section_no", "part").collect():
        got.setdefault(r["id"], []).append((r["text"], r["token_count"]))
    for i, paras in docs:
        body = "\n".join(paras)
        want = [(body, tokens_of(body))] if tokens_of(body) <= 120 else packed(paras, 40, 120)
        assert got.get(i, []) == want
    as_coded = chunking.chunks(df, "id", "text", 40, 120, keep_blank_lines=False).groupBy("id").count().agg(F.max("count")).first()[0]
    assert as_coded == 1


def test_label_mapping(spark):
    std = spark.createDataFrame([("营业收入", "rev", "income_sheet"), ("净利润", "np", "income_sheet"), ("存货", "inv", "balance_sheet")], "standard string, field string, table_name string")
    labels = spark.createDataFrame([("营业收入",), ("净利润（元）",), ("本期净利润",), ("现金流入小计",), ("毫无关系的话",), ("年末库存",)], "label string").withColumn("t", F.lit("income_sheet"))
    got = {r["label"]: (r["field"], r["confidence"]) for r in mapping.map_fields(labels, std, "label", "t").collect()}
    assert got["营业收入"] == ("rev", 100.0) and got["净利润（元）"] == ("np", 100.0) and got["本期净利润"][0] == "np"
    assert got["现金流入小计"] == (None, None) and got["毫无关系的话"] == (None, None) and got["年末库存"] == (None, None)
    pool = spark.createDataFrame([("inv", "库存")], "field string, synonym string")
    with_pool = mapping.map_fields(labels.withColumn("t", F.lit("balance_sheet")), std, "label", "t", pool).filter("label = '年末库存'").first()
    assert with_pool["field"] is None or with_pool["field"] == "inv"


def test_entity_lookup_tiers(spark):
    d = spark.createDataFrame([("云南白药", "538", 0), ("白云山", "600332", 1)], "entity string, code string, pos int")
    n = spark.createDataFrame([("云南白药",), ("云南白药集团股份有限公司",), ("广州白云山",), ("云南红药",), ("其他",)], "name string")
    got = {r["name"]: (r["code"], r["confidence"]) for r in mapping.entity_lookup(n, d, similar_from=70.0).collect()}
    assert got["云南白药"] == ("000538", 100) and got["云南白药集团股份有限公司"] == ("000538", 95)
    assert got["广州白云山"] == ("600332", 80) and got["云南红药"] == ("000538", 75) and got["其他"] == (None, 0)


def test_rrf_ignores_list_order_and_zero_base(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    ab = sorted(map(tuple, retrieval.rrf_fuse([a, b]).collect()))
    assert ab == sorted(map(tuple, retrieval.rrf_fuse([b, a]).collect()))
    assert retrieval.rrf_fuse([a, b]).filter("rank = 1").first()["doc_id"] == 11
    zero = retrieval.rrf_fuse([a], zero_based=True).filter("rank = 1").first()["score"]
    assert zero == pytest.approx(1 / 60)


def test_vector_slices_give_the_same_ranks(spark, monkeypatch):
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:30])], "query_id int, query_vector array<float>")
    one = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.vector_top_k(v, q, 4).collect())
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(retrieval, "QUERY_SLICE", 2)
    many = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.vector_top_k(v, q, 4).collect())
    assert one == many and len(one) == 120 and all((i, i, 1) in one for i in range(30))
    none = retrieval.vector_top_k(v, q, 4, prefilter=v.filter("vec_id < 0"))
    assert none.count() == 0


def test_units_stop_at_sections(spark):
    p = spark.createDataFrame([("d", 0, "单位：千元"), ("d", 1, "附注"), ("d", 2, "正文"), ("d", 3, "利润表"), ("d", 4, "明细"), ("d", 5, "单位：万元"), ("e", 0, "x")], "doc string, page int, text string")
    got = {(r["doc"], r["page"]): (r["factor"], r["source"]) for r in pages.nearest_unit(p, "doc", "page").collect()}
    assert got[("d", 2)] == (1000, "单位：千元")  # two pages up
    assert got[("d", 3)][0] == 1000 and got[("d", 4)][0] == 10000  # page 3 ends the way up from page 4
    assert got[("e", 0)] == (1, "default")


def test_split_rows_pair_up(spark):
    rows = [("甲", ""), ("乙", ""), ("丙", "1"), ("丁", ""), ("戊", "2"), ("己", "")]
    cells = [(1, i, c, t) for i, r in enumerate(rows) for c, t in enumerate(r)]
    df = spark.createDataFrame(cells, "t int, row int, col int, text string")
    out = {(r["row"], r["col"]): r["text"] for r in pages.merge_split_rows(df, ["t"]).collect()}
    labels = [(k[0], v) for k, v in sorted(out.items()) if k[1] == 0]
    assert labels == [(0, "甲乙"), (2, "丙"), (3, "丁戊"), (5, "己")] and out[(3, 1)] == "2" and out[(0, 1)] == ""


def test_page_span_stops_before_a_foreign_section(spark):
    s = spark.createDataFrame([("d", i, "income_sheet", 50, 0, f, o) for i, (f, o) in enumerate([(False, True), (False, False), (True, False), (False, False)])],
                              "doc string, page int, table_name string, score int, title int, foreign boolean, own boolean")
    starts = spark.createDataFrame([("d", "income_sheet", 0)], "doc string, table_name string, page int")
    assert sorted(r["page"] for r in pages.statement_page_span(starts, s, "doc", "page").collect()) == [0, 1]


def test_bio_spans(spark):
    tags = ["B-COMP", "I-COMP", "O", "I-METRIC", "B-METRIC", "I-COMP", "B-METRIC", "I-METRIC"]
    df = spark.createDataFrame([(1, i, c, t) for i, (c, t) in enumerate(zip("abcdefgh", tags))], "s int, p int, tok string, lab string")
    got = sorted((r["start"], r["end"], r["entity"], r["text"]) for r in questions.bio_spans(df, ["s"], "p", "tok", "lab", 3).collect())
    assert got == [(0, 1, "COMP", "ab"), (4, 4, "METRIC", "e"), (6, 7, "METRIC", "gh")]


def test_duplicates_with_a_hot_key(spark):
    df = spark.createDataFrame([(i % 50 if i % 3 else 0, i % 9) for i in range(900)], "k int, f int").withColumn("file", F.concat(F.lit("f"), F.col("f")))
    files = sorted({f"f{i % 9}" for i in range(900) if (i % 50 if i % 3 else 0) == 0})
    row = stats.duplicate_filings(df, ["k"], "file").filter("k = 0").first()
    assert row["n_files"] == len(files) and row["files"] == ",".join(files)
    assert stats.duplicate_filings(df, ["k"], "file", keep=3).filter("k = 0").first()["files"] == ",".join(files[:3])


def test_contains_join_common_prefix(spark):
    """Names with one prefix meet few texts each: candidates grow with the input, not with its square."""
    r = random.Random(1)
    names = ["股份有限" + "".join(chr(0x4E00 + r.randrange(400)) for _ in range(4)) for _ in range(1000)]
    texts = spark.createDataFrame([(i, f"关于{n}的公告") for i, n in enumerate(names)], "id long, text string")
    terms = spark.createDataFrame([(n,) for n in names], "name string")
    left = matching._gram_rows(texts, "id", "text", (3,))
    assert left.join(matching.rarest_gram(terms, "name"), "_gram").count() < 3 * len(names)
    want = sum(m in f"关于{n}的公告" for n in names for m in set(names))
    assert matching.contains_join(texts, "text", terms, "name").count() == want and matching._gram_join(texts, "text", terms, "name").count() == want


def containment_case():
    r = random.Random(7)
    word = lambda n: "".join(r.choice("ab药é😀 ") for _ in range(n))
    texts = [(i, word(r.randint(0, 40))) for i in range(120)] + [(200, None), (201, ""), (202, "a"), (202, "a"), (203, "ab" * 3000)]
    terms = [word(r.randint(1, 5)) for _ in range(60)] + ["", None, "ab", "ab", "a", "ababab", "药", "never in a text"]
    return texts, terms


@pytest.mark.parametrize("small", ["terms", "texts"])
@pytest.mark.parametrize("bound", [200_000, 3])
def test_contains_join_against_brute_force(spark, monkeypatch, small, bound):
    """By automaton in either role, and by grams where the dictionary exceeds its bound."""
    monkeypatch.setattr(matching, "MAX_TERMS", bound)
    texts, terms = containment_case()
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    d = spark.createDataFrame([(x,) for x in terms], "term string")
    for single in (True, False):
        want = collections.Counter((i, x, y) for i, x in texts for y in terms if x is not None and y and len(y) >= (1 if single else 2) and y in x)
        assert collections.Counter(tuple(r) for r in matching.contains_join(t, "text", d, "term", single, small).select("id", "text", "term").collect()) == want
    assert matching.contains_join(t.limit(0), "text", d, "term", small=small).count() == matching.contains_join(t, "text", d.limit(0), "term", small=small).count() == 0


def test_containment_takes_linear_time(spark):
    """A text of a million characters, by automaton and by grams."""
    text = "".join(chr(0x4E00 + i * 7919 % 3000) for i in range(1_000_000))
    terms = [text[k * 9973 : k * 9973 + 5] for k in range(50)] + [f"无{k}" for k in range(50)]
    t, d = spark.createDataFrame([(1, text)], "id long, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    for join in (matching.contains_join, matching._gram_join):
        start = time.time()
        assert join(t, "text", d, "term").select("term").distinct().count() == len(set(terms[:50]))
        assert time.time() - start < 60


@pytest.mark.parametrize("threshold", [50.0, 70.0, 85.0, 100.0])
def test_similar_join_against_brute_force(spark, threshold):
    r = random.Random(3)
    base = ["".join(r.choice("甲乙丙ab") for _ in range(r.randint(1, 16))) for _ in range(70)]

    def changed(x):
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(x) + 1)
            x = r.choice([x[:k] + r.choice("甲乙丙ab") + x[k:], x[:k] + x[k + 1 :], x[:k] + "丁" + x[k + 1 :]])
        return x

    left, right = sorted(set(base)), sorted({changed(x) for x in base} | {""})
    want = {(x, y) for x in left for y in right if max(len(x), len(y)) and (1 - levenshtein(x, y) / max(len(x), len(y))) * 100 >= threshold - 1e-9}
    got = matching.similar_join(spark.createDataFrame([(x,) for x in left], "a string"), "a", spark.createDataFrame([(y,) for y in right], "b string"), "b", threshold).collect()
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want)


def test_bm25_skips_blocks(spark):
    """Blocks that can't hold one of the best documents aren't scored, and the best are those of a plain sum over all documents."""
    r = random.Random(2)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    docs = [(i, " ".join(r.choices(common, k=r.randint(5, 60)) + r.choices(rare, k=3))) for i in range(3000)]
    asked = [(q, " ".join(r.sample(rare, 2) + r.sample(common, 2))) for q in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    got = {(x.query_id, x.rank): (x.doc_id, round(x.score, 9)) for x in retrieval.bm25_top_k(d, q, 5).collect()}
    bags = [(i, collections.Counter(t.split()), len(t.split())) for i, t in docs]
    df = collections.Counter(w for _, bag, _ in bags for w in bag)
    mean = sum(n for *_, n in bags) / len(bags)
    for name, text in asked:
        idf = {w: math.log((len(bags) - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in text.split()}
        scores = [(-round(sum(idf[w] * bag[w] * 2.5 / (bag[w] + 1.5 * (0.25 + 0.75 * n / mean)) for w in idf), 9), i) for i, bag, n in bags]
        assert [got[name, k][0] for k in range(1, 6)] == [i for _, i in sorted(scores)[:5]]
    rows = retrieval.token_rows(d, "doc_id", "text")
    terms = retrieval.query_terms(q, "query_id", "query")
    post = retrieval.postings(rows, "doc_id", terms)
    _, judged = retrieval.block_bounds(retrieval.weighted_postings(post, retrieval.idf(post, retrieval.corpus_size(rows)), "doc_id"), terms, 5, "doc_id", "query_id")
    counts = judged.agg(F.count("*").alias("n"), F.count_if("open").alias("open")).first()
    assert 0 < counts.open < 0.5 * counts.n


def test_carries_are_one_row_per_partition(spark):
    """Positions a thousand apart: what is carried is one row per partition, not one per row or session."""
    rows = [(s, 1000 * t, (s * 31 + t) if (s + t) % 5 == 0 else None) for s in range(50) for t in range(40)] + [(None, 5, 1), (None, 6, None)]
    df = spark.createDataFrame(rows, "s int, t long, x int").repartition(6)
    ranged = blocked._ranged(df, ["s"], "t", 7)
    assert ranged.select("_part").distinct().count() == 7
    got = {(x.s, x.t): (x.x_at, x.n) for x in blocked.running_sum(blocked.carry_forward(df, ["s"], "t", ["x"], 7, "_at"), ["s"], "t", F.lit(1), "n", 5).collect()}
    assert len(got) == len(rows)
    for s in {x[0] for x in rows}:
        last, n = None, 0
        for _, t, x in sorted((x for x in rows if x[0] == s), key=lambda x: x[1]):
            last, n = (last if x is None else x), n + 1
            assert got[s, t] == (last, n)


def arriving(spark, path, rows, schema, files):
    """Write ``files`` lists of rows as one file each, in order."""
    for part in files:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_case():
    """Turns of a few users with pauses, and arrival orders up to eight minutes off."""
    r = random.Random(11)
    start, rows = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc), []
    for user in range(6):
        at = 0
        for k in range(40):
            at += r.choice([5, 60, 600, 1799, 1800, 1801, 4000])
            rows.append((user, k, start + datetime.timedelta(seconds=at, microseconds=r.choice([0, 1, 999_999])), r.choice([None, "", f"v{k}"])))
    order = sorted(range(len(rows)), key=lambda i: rows[i][2] + datetime.timedelta(seconds=r.uniform(0, 480)))
    return rows, [order[k * 48 : (k + 1) * 48] for k in range(5)]


def test_slots_over_several_batches_out_of_order(spark):
    rows, files = stream_case()
    schema = "user int, k int, ts timestamp, slot string"
    sessions.use_rocksdb(spark)
    rows.append((99, 0, max(x[2] for x in rows) + datetime.timedelta(days=1), None))
    stream = arriving(spark, work_path(spark, "turns"), rows, schema, [*files, [len(rows) - 1]])
    path = work_path(spark, "slots")
    sessions.run_available(sessions.carry_slots_stream(stream, "user", "ts", ["slot"], delay="10 minutes"), path)
    got = {(x.user, x.k): x.slot for x in spark.read.parquet(f"{path}/data").collect()}
    want = {}
    for user in range(6):
        last, known = None, None
        for _, k, ts, slot in sorted((x for x in rows if x[0] == user), key=lambda x: x[2]):
            known = slot or (known if last is not None and ts - last <= datetime.timedelta(minutes=30) else None)
            want[user, k], last = known, ts
    assert got == want


def test_sessions_merge_over_several_batches(spark):
    rows, files = stream_case()
    rows += [(50, k, datetime.datetime(2024, 1, 1, 0, m, tzinfo=datetime.timezone.utc), None) for k, m in enumerate((0, 35, 20))]  # the last, late one joins the other two
    files[0], files[1], files[2] = [len(rows) - 3, *files[0]], files[1], files[2]
    files = [files[0] + [len(rows) - 2], [len(rows) - 1], *files[1:]]
    schema = "user int, k int, ts timestamp, slot string"
    sessions.use_rocksdb(spark)
    path = work_path(spark, "sessions")
    stream = arriving(spark, work_path(spark, "events"), rows, schema, files)
    sessions.run_session_updates(sessions.session_updates(stream, "user", "ts", delay="2 hours"), path)
    got = sorted((x.user, x.session_start, x.session_end, x.n_events) for x in sessions.current_sessions(spark, path, "user").collect())
    batch = sessions.session_activity(spark.createDataFrame(rows, schema), "user", "ts")
    assert got == sorted((x.user, x.session_start, x.session_end, x.n_events) for x in batch.collect())
    assert [x[3] for x in got if x[0] == 50] == [3]


def test_label_candidates_are_few_and_complete(spark):
    """The bound drops most names that share a character, and none that would be mapped."""
    r = random.Random(5)
    names = sorted({label for *_, label in fixed.FIELDS})
    labels = {r.choice(["", "本期", "期末", "其中：", "减："]) + (n if r.random() < 0.5 else n[: r.randint(1, len(n))] + r.choice(["合计", "净额", "", "额"])) for n in names for _ in range(4)}
    labels = sorted(x for x in labels if len(x) >= 2)
    std = spark.createDataFrame([(label, f, t) for f, t, _, label in fixed.FIELDS], "standard string, field string, table_name string")
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    kept = {(x.label, x.standard) for x in mapping.label_candidates(df, "label", std, 20).collect()}
    sharing = {(x, n) for x in labels for n in names if set(x) & set(n)}
    assert kept <= sharing and len(kept) < 0.6 * len(sharing)
    scored = spark.createDataFrame(sorted(sharing), "a string, s string").withColumn("lex", mapping.lexical_score(F.col("a"), F.col("s")))
    rest = mapping.without_prefix(F.col("a"))
    bonus = F.when((F.length(rest) >= 2) & (mapping.lexical_score(rest, F.col("s")) > 20), 15).otherwise(0)
    for x in scored.withColumn("most", F.col("lex") + bonus + 15 + 20 + 10).collect():
        assert (x.a, x.s) in kept or (x.most < 55 and x.a not in x.s and x.s not in x.a), x
