"""What the suffix-array dedup shuffles with many small shards, and texts that share a doc_id."""

import zlib

import numpy as np
import pytest

from quillstat.llm import repeats

pytest.importorskip("zstandard")


def shuffled(spark):
    """Bytes of shuffles written so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def brute_force(rows):
    first, gone = {}, {}
    rows = sorted((d, t.encode()) for d, t in rows)
    for d, x in rows:
        for k in range(len(x) - 49):
            first.setdefault(x[k : k + 50], d)
    for d, x in rows:
        hit = np.zeros(len(x), bool)
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < d:
                hit[k : k + 50] = True
        gone.setdefault(d, []).append(int(hit.sum()))
    return {d: sorted(n) for d, n in gone.items()}


def collected(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append(r.n_removed)
    return {d: sorted(n) for d, n in got.items()}


def corpus(n):
    """Texts of words; each ninth one holds a passage of an earlier one, changed at one place."""
    r = np.random.default_rng(n)
    words = ["".join(map(chr, r.integers(97, 123, r.integers(2, 9)))) for _ in range(3000)]
    texts = []
    for d in range(n):
        own = [words[i] for i in r.integers(0, len(words), 250)]
        if d % 9 == 8:
            own[20:120] = texts[int(r.integers(0, d))].split()[60:160]
            own[70] = f"changed{d}"
        texts.append(" ".join(own))
    return list(enumerate(texts))


def test_little_is_shuffled_with_many_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 128 << 10)
    rows = corpus(1200)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    before = shuffled(spark)
    got = collected(repeats.without_repeats(spark.read.parquet(str(tmp_path / "d"))))
    written = shuffled(spark) - before
    assert got == brute_force(rows)
    assert written < 1.45 * sum(len(t) for _, t in rows), written / sum(len(t) for _, t in rows)


def test_texts_of_one_doc_id_are_told_apart(spark):
    """Two texts of one doc_id have equal 16-bit checksums; only one of them holds what an earlier document holds."""
    passage = "a passage of an earlier document that is well over fifty bytes long. "
    by_checksum, pair = {}, None
    for i in range(70_000):
        a = passage + f"tail {i}"
        by_checksum.setdefault(zlib.crc32(a.encode()) & 0xFFFF, a)
    for i in range(70_000):
        b = f"{i} words of another text, of the same checksum, that no other document has. " * 2
        if (a := by_checksum.get(zlib.crc32(b.encode()) & 0xFFFF)) is not None:
            pair = a, b
            break
    rows = [(1, passage), (2, pair[0]), (2, pair[1]), (2, pair[0]), (3, pair[1][5:])]
    assert collected(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == brute_force(rows)


def test_suffix_arrays_hold_only_what_may_share_a_window(monkeypatch):
    """Texts that share an anchor and less than a window, or are copies of one another, are settled without a suffix array."""
    sorted_bytes, sort = [], repeats.earlier_windows
    monkeypatch.setattr(repeats, "earlier_windows", lambda data, starts, lengths, docs: sorted_bytes.append(int(lengths.sum())) or sort(data, starts, lengths, docs))
    r = np.random.default_rng(5)
    tail = lambda n: bytes(r.integers(97, 123, n, dtype="uint8"))
    common, passage = b"~sixteen bytes.~", tail(90)
    texts = [tail(40) + common + tail(40) for _ in range(40)] * 2 + [tail(30) + passage + tail(30) for _ in range(3)]
    data, bounds = np.frombuffer(b"".join(texts), "uint8"), np.cumsum([0, *map(len, texts)])
    _, text, start, length, anchor = repeats.anchors(data, bounds)
    c = {"doc": text, "copy": np.zeros(len(text), "uint32"), "start": start - bounds[text], "length": length, "anchor": anchor}
    spans = repeats._late_spans(c, repeats.ragged(data, start, length))
    s = repeats.merged(repeats.joined(spans, repeats.SPAN))
    gone = dict.fromkeys(range(len(texts)), 0)
    for d, a, b in zip(s["doc"].tolist(), s["start"].tolist(), s["end"].tolist()):
        gone[d] += b - a
    assert {d: [n] for d, n in gone.items()} == brute_force([(d, t.decode()) for d, t in enumerate(texts)])
    assert sum(sorted_bytes) < 3 * 200 < length.sum() / 4


def test_values_between_shards_are_few():
    """Eight shards of documents share a group of segments, and what a shard removes at once travels to one of the groups."""
    import pyarrow as pa

    rows, shards = corpus(600), 16
    ids, texts = np.array([d for d, _ in rows]), np.array([t for _, t in rows], dtype=object)
    place = repeats.doc_shard(ids, shards)
    nothing = pa.table({"packed": pa.array([], pa.binary())})
    per = [repeats._cut_segments(shards)(pa.table({"shard": np.full(int(m.sum()), s), "doc_id": ids[m], "text": pa.array(texts[m], pa.string())}), nothing).num_rows
           for s in range(shards) if (m := place == s).any()]
    assert max(per) <= -(-shards // 8) + 1
