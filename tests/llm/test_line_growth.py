"""What the line dedup compares and shuffles: long lines that differ are told apart by their sketches, copies take no part, texts are shuffled once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstat.llm import linededup

pytest.importorskip("zstandard")


def found(df, shards=3):
    rarity, common_from = linededup.token_rarity(df)[:2]
    return linededup.matching_lines(df, rarity, common_from, 80, 5, shards)


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def family(n, seed=5):
    """Lines around one line of 40 words, more than a small group holds, and a copy of every fifth one under a later id."""
    r = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        w = [f"w{i}" for i in range(40)]
        for j in r.integers(0, 40, d % 9):
            w[j] = f"v{r.integers(0, 300)}"
        rows.append((d, " ".join(w)))
    return rows + [(1000 + d, t.upper()) for d, t in rows[::5]]


def test_long_lines_that_differ_are_no_candidates(spark):
    """Lines of 150 words share 105 common ones: the sketches tell that more than the permitted 33 differ."""
    r = np.random.default_rng(2)
    rows = []
    for d in range(80):
        own = [f"o{x}" for x in r.choice(500, 45, replace=False)]
        rows.append((d, " ".join([f"w{i}" for i in range(105)] + own)))
    sets = [frozenset(t.split()) for _, t in rows]
    assert not any(similar(sets[x], sets[y]) for y in range(80) for x in range(y))
    filler = [(1000 + d, f"w{d % 105} o{d % 500}") for d in range(4000)]
    rows = found(spark.createDataFrame(rows + filler, "doc_id long, text string")).collect()
    assert len([x for x in rows if x.kind in (1, 3)]) < 80


def test_copies_of_lines_have_no_other_entries(spark):
    df = spark.createDataFrame(family(600), "doc_id long, text string").repartition(6)
    rows = found(df).collect()
    gone = {(x.doc, x.line) for x in rows if x.kind == 0}
    rest = {(x.doc, x.line) for x in rows if x.kind != 0}
    assert len(gone) >= 100 and any(x.kind == 2 for x in rows)
    assert not gone & rest


def test_families_with_copies_agree_with_brute_force(spark):
    rows = family(600)
    sets = [frozenset(t.lower().split()) for _, t in rows]
    gone = {rows[y][0] for y in range(len(rows)) if any(similar(sets[x], sets[y]) for x in range(y))}
    got = {x.doc_id for x in linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == gone and 100 < len(gone) < len(rows) - 1


def test_sets_are_read_once(spark, monkeypatch):
    """Large groups need no second pass over the texts."""
    calls, real = [], linededup.line_sets
    monkeypatch.setattr(linededup, "line_sets", lambda *a: calls.append(1) or real(*a))
    linededup.repeated_lines(spark.createDataFrame(family(600), "doc_id long, text string").repartition(6)).count()
    assert len(calls) == 1


def test_bytes_of_texts_are_counted_with_the_words(spark):
    rows = family(20) + [(7000, None), (7001, ""), (7002, "é ü\nß")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert linededup.token_rarity(df)[2] == df.agg(F.sum(F.octet_length("text"))).first()[0]
    assert linededup.token_rarity(df.where("false"))[2] == 0


def test_word_hashes():
    """Words of any length and bytes: equal in lower case (A-Z) if and only if their hashes are."""
    r = np.random.default_rng(1)
    words = ["a", "A", "a\0", "\0", "\x08\x0e\x1f!", "@[`{", "é", "É", *("x" * n for n in (8, 9, 16, 63, 64, 65, 200)), "X" * 200, "x" * 199 + "y", "y" + "x" * 199]
    words += ["".join(r.choice(list("abAB"), n)) for n in r.choice([1, 3, 8, 9, 30, 64, 72, 73, 150], 3000)]
    texts = [None, "", " \n\x0b", *(" ".join(words[i : i + 50]) + "\t\r\f" for i in range(0, len(words), 50))]
    data, bounds, starts, hashes = linededup.word_tokens(pa.array(texts))
    lower = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    assert [bytes(data[s:]).split(None, 1)[0] if k < 3 else None for k, s in enumerate(starts[:3].tolist())] == [b"a", b"A", b"a\0"]
    assert len(hashes) == len(words) and len(set(zip(lower, hashes.tolist()))) == len(set(lower)) == len(set(hashes.tolist()))
