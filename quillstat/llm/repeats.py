"""Suffix-array dedup: bytes of passages that an earlier document holds are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.blobs import BLOBS, blob_table, dealt, joined, pack, ragged, taken, unpack
from quillstat.llm.common import MOST_PARTITIONS, documents
from quillstat.llm.linededup import text_bytes
from quillstat.llm.suffixes import common_prefixes, suffix_array, words_at
from quillstat.llm.words import mix

LENGTH = 50
GRAM = 16
SHARD_BYTES = 6 << 20
TOGETHER = 8  # suffix arrays (one for each shard of documents), and shards' worth of keys, that one group of rows holds: fewer and larger values travel
PART_BYTES = 2 << 20
BLOCK = 1 << 13  # places hashed at a time, so that they stay in the processor's cache
REACH = -(-(LENGTH - GRAM) // 2)  # bytes before or behind its anchor that a window has at least
KEY_BITS = 48
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
#: Columns of what travels: ascending keys as differences (the shard they come from follows), segments (their bytes follow) and spans.
STEP = [("step", "<u8", 7)]
SEGMENT = [("doc", "<i8", 8), ("copy", "<u4", 4), ("start", "<u4", 4), ("length", "u1", 1), ("anchor", "u1", 1), ("part", "u1", 1)]
SPAN = [("doc", "<i8", 8), ("copy", "<u4", 4), ("start", "<u4", 4), ("end", "<u4", 4)]


def doc_shard(docs: np.ndarray, shards: int) -> np.ndarray:
    return (mix(docs.astype("int64").view("uint64") + np.uint64(3)) % np.uint64(shards)).astype("int64")


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each place."""
    w = words_at(data)
    h = np.empty(len(data) - GRAM + 1, "uint64")
    for low in range(0, len(h), BLOCK):
        high = min(len(h), low + BLOCK)
        x = np.zeros(high - low, "uint64")
        for off in range(0, GRAM, 8):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w[low + off : high + off] + np.uint64(7))
        h[low:high] = x
    return h


def _least_places(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest hash (the first of equal ones) among ``span`` from each place."""
    bits = max(20, int(len(h)).bit_length())
    low_bits = np.uint64((1 << bits) - 1)
    out = np.empty(len(h) - span + 1, "int64")
    for low in range(0, len(out), BLOCK):
        high = min(len(out), low + BLOCK)
        m, width = (h[low : high + span - 1] & ~low_bits) | np.arange(low, high + span - 1, dtype="uint64"), 1
        while 2 * width <= span:
            m = np.minimum(m[: len(m) - width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        out[low:high] = m & low_bits
    return out


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: key, text number, first start (in ``data``), bytes covered and the anchor's place in them.

    Each window of LENGTH bytes inside a text picks the GRAM-byte string in it with the smallest hash (the first of equal ones), so equal windows
    pick the same one at the same place.
    """
    nothing = np.zeros(0, "int64")
    lengths = np.diff(bounds)
    if not len(lengths) or lengths.max() < LENGTH:
        return nothing.astype("uint64"), nothing, nothing, nothing, nothing
    h = _grams(data)
    a = _least_places(h, LENGTH - GRAM + 1)
    # a run begins where the anchor changes and at the first window of a text, and ends before the next one and at the text's last window
    change = np.ones(len(a), bool)
    change[1:] = a[1:] != a[:-1]
    held = np.flatnonzero(lengths >= LENGTH)
    change[bounds[held]] = True
    first = np.flatnonzero(change)
    text = np.searchsorted(bounds, first, "right") - 1
    inside = first <= bounds[text + 1] - LENGTH
    last = np.minimum(np.append(first[1:], len(a)) - 1, bounds[text + 1] - LENGTH)[inside]
    first, text = first[inside], text[inside]
    return mix(h[a[first]]) >> np.uint64(64 - KEY_BITS), text, first, last - first + LENGTH, a[first] - first


def _parts(table, doc: int, text: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, doc ids, numbers among the differing texts of the same doc id, and whether it is the first row of that text, in parts of bounded size."""
    ids, texts = table.column(doc), table.column(text)
    if isinstance(texts, pa.ChunkedArray):
        texts, ids = texts.combine_chunks(), ids.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    data, bounds = text_bytes(texts)
    ids = ids.to_numpy(zero_copy_only=False).astype("int64")
    copies, fresh = np.zeros(len(ids), "uint32"), np.ones(len(ids), bool)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]])) if len(ids) else order
    for at, end in zip(first, np.append(first[1:], len(ids))):
        if end - at > 1:  # numbered by their bytes, so that rows may come in any order
            own = [data[bounds[i] : bounds[i + 1]].tobytes() for i in order[at:end]]
            number = {t: n for n, t in enumerate(sorted(set(own)))}
            copies[order[at:end]] = [number[t] for t in own]
            fresh[order[at:end]] = False
            fresh[[order[at + i] for i in {t: i for i, t in enumerate(own)}.values()]] = True
    start = 0
    while start < len(ids):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + PART_BYTES, "right")) - 1)
        yield data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start], ids[start:end], copies[start:end], fresh[start:end]
        start = end


def _by_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether several documents hold them."""
    if not len(key):
        return key, np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)


def _numbers(ascending: np.ndarray, to: np.ndarray, shards: int, source: int) -> list[tuple[int, int, bytes]]:
    """Rows of ascending numbers by their shard."""
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(shards + 1))
    return [(int(s), 0, pack({"step": np.diff(ascending[order[cut[s] : cut[s + 1]]], prepend=np.uint64(0))}, STEP, source.to_bytes(8, "little"))) for s in np.flatnonzero(np.diff(cut))]


def _read_numbers(blob: bytes) -> tuple[np.ndarray, int]:
    c, source = unpack(blob, STEP)
    return np.cumsum(c["step"]), int.from_bytes(source, "little")


def _deal_keys(key_shards: int):
    """Each key of a shard of documents once, doubled, and one more if several of its documents hold it, to the shards of the keys."""

    def run(table: pa.Table) -> pa.Table:
        keys, docs = [], []
        for data, bounds, ids, *_ in _parts(table, 1, 2):
            key, text, *_ = anchors(data, bounds)
            keys.append(key)
            docs.append(ids[text])
        key, several = _by_key(np.concatenate(keys), np.concatenate(docs))
        to = (key % np.uint64(key_shards)).astype("int64")
        return blob_table(_numbers(key * np.uint64(2) + several.astype("uint64"), to, key_shards, table.column("shard")[0].as_py()))

    return run


def _repeated_keys(shards: int):
    """Keys that several shards of documents hold, to those of the shards that do not know them as repeated."""

    def run(table: pa.Table) -> pa.Table:
        read = [_read_numbers(b) for b in table.column("packed").to_pylist()]
        code = np.concatenate([n for n, _ in read])
        source = np.repeat([s for _, s in read], [len(n) for n, _ in read])
        order = np.argsort(code, kind="stable")
        code, source = code[order], source[order]
        key = code >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        asked = np.repeat(sizes > 1, sizes) & (code & np.uint64(1) == 0)
        return blob_table(_numbers(key[asked], source[asked], shards, table.column("shard")[0].as_py()))

    return run


def _content(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of short strings."""
    out = lengths.astype("uint64")
    w = words_at(data)
    for off in range(0, int(lengths.max(initial=0)), 8):
        rest = np.clip(lengths - off, 0, 8)
        mask = np.where(rest == 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(rest, 7)).astype("uint64")) - np.uint64(1))
        value = w[np.minimum(starts + off, len(w) - 1)] & mask
        out = np.where(rest > 0, mix(out * np.uint64(0x9E3779B97F4A7C15) + value), out)
    return out


def merged(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans in order, those of one text that overlap or touch as one."""
    if not len(s["doc"]):
        return s
    s = taken(s, np.lexsort((s["start"], s["copy"], s["doc"])))
    text = np.concatenate([[0], np.cumsum((s["doc"][1:] != s["doc"][:-1]) | (s["copy"][1:] != s["copy"][:-1]))]) << 33
    end = np.maximum.accumulate(text + s["end"])
    head = np.flatnonzero(np.concatenate([[True], text[1:] + s["start"][1:] > end[:-1]]))
    tail = np.append(head[1:], len(end)) - 1
    return taken(s, head) | {"end": (end - text)[tail].astype("uint32")}


def _cut_segments(shards: int):
    """Segments (the bytes of all windows of an anchor) of the repeated anchors, to the groups of their keys. Equal ones of later documents in the same shard are
    spans to remove at once (kind 1), which pass through one of the groups."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return blob_table([])
        parts = [(data, bounds, ids, copies, fresh, *anchors(data, bounds)) for data, bounds, ids, copies, fresh in _parts(texts, 1, 2)]
        key, several = _by_key(np.concatenate([p[5] for p in parts]), np.concatenate([p[2][p[6]] for p in parts]))
        known = np.concatenate([key[several], *[_read_numbers(b)[0] for b in (found.column("packed").to_pylist() if found.num_rows else [])]])
        kept, bodies = [], []
        for data, bounds, ids, copies, fresh, key, text, start, length, anchor in parts:
            hit = np.flatnonzero(fresh[text] & np.isin(key, known))
            key, text, start, length, anchor = key[hit], text[hit], start[hit], length[hit], anchor[hit]
            place = (key % np.uint64(shards)).astype("int64")
            kept.append({"doc": ids[text], "copy": copies[text], "start": start - bounds[text], "length": length, "anchor": anchor, "part": place % TOGETHER, "group": place // TOGETHER})
            bodies.append(ragged(data, start, length))
        c, data = joined(kept, [*SEGMENT, ("group", "<i8", 8)]), np.concatenate(bodies)
        if not len(c["doc"]):
            return blob_table([])
        lengths = c["length"].astype("int64")
        starts = np.cumsum(lengths) - lengths
        order = np.lexsort((c["start"], c["copy"], c["doc"]))
        c, starts, lengths = taken(c, order), starts[order], lengths[order]
        content = _content(data, starts, lengths)
        order = np.lexsort((c["doc"], content))
        first = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        least = c["doc"][order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        later = np.zeros(len(order), bool)
        later[order] = c["doc"][order] > least
        gone = taken(c, later)
        gone["end"] = gone["start"] + gone["length"]
        gone = merged(gone)
        stay = taken(c, ~later)
        groups = -(-shards // TOGETHER)
        rows = dealt(stay, stay["group"], SEGMENT, 0, groups, data, starts[~later])
        if len(gone["doc"]):
            rows.append((texts.column("shard")[0].as_py() % groups, 1, pack(gone, SPAN)))
        return blob_table(rows)

    return run


def earlier_windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and offset of each window of LENGTH bytes that also occurs in a segment of a smaller document, from the suffix array of all segments.

    Suffixes that share LENGTH bytes stand together, so one minimum per run of common prefixes of that length decides.
    """
    n = len(starts)
    ends = np.cumsum(lengths + 1)
    at = ends - lengths - 1
    t = np.ones(int(ends[-1]) + 1, "int64")  # a separator after each segment, the sentinel at the end
    body = np.zeros(len(t), bool)
    body[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = True
    plain = ragged(data, starts, lengths)
    t[body] = plain.astype("int64") + 2
    t[-1] = 0
    sa = suffix_array(t)
    raw = np.zeros(len(t), "uint8")
    raw[body] = plain
    owner = np.repeat(np.arange(n), lengths + 1)
    offset = np.arange(len(owner)) - at[owner]
    room = lengths[owner] - offset
    windows = np.flatnonzero(room >= LENGTH)
    prefix = np.zeros(len(t), "int64")
    prefix[windows] = common_prefixes(raw, sa, windows, LENGTH)
    before = np.full(len(t), -1, "int64")
    before[sa[1:]] = sa[:-1]
    limit = np.zeros(len(t), "int64")
    limit[: len(room)] = room  # a suffix shares no more than is left of its segment
    prefix = np.minimum(prefix, np.where(before >= 0, limit[before], 0))
    valid = np.zeros(len(t), bool)
    valid[windows] = True
    ranked = sa[valid[sa]]
    runs = np.flatnonzero(np.concatenate([[True], prefix[ranked][1:] < LENGTH]))
    doc = docs[owner[ranked]]
    least = np.repeat(np.minimum.reduceat(doc, runs), np.diff(np.concatenate([runs, [len(ranked)]])))
    hit = ranked[least < doc]
    return owner[hit], offset[hit]


def _may_share(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether a window of a segment may stand in another of these, which all differ: both then agree on the anchor and REACH bytes before or behind it."""
    met = np.zeros(len(starts), bool)
    for at, room in ((starts + anchor - REACH, anchor >= REACH), (starts + anchor, lengths - anchor >= GRAM + REACH)):
        rows = np.flatnonzero(room)
        _, which, counts = np.unique(_content(data, at[rows], np.full(len(rows), GRAM + REACH)), return_inverse=True, return_counts=True)
        met[rows] |= counts[which] > 1
    return met


def _late_spans(c: dict[str, np.ndarray], data: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Spans of segments, or of windows in them, that an earlier document holds."""
    lengths = c["length"].astype("int64")
    starts = np.cumsum(lengths) - lengths
    content = _content(data, starts, lengths)
    order = np.lexsort((c["doc"], content))
    first = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
    distinct = order[first]  # the occurrence in the smallest document
    shared = np.flatnonzero(_may_share(data, starts[distinct], lengths[distinct], c["anchor"][distinct].astype("int64")))
    owner = offset = np.zeros(0, "int64")
    if len(shared):
        owner, offset = earlier_windows(data, starts[distinct[shared]], lengths[distinct[shared]], c["doc"][distinct[shared]])
        owner = shared[owner]
    late = order[c["doc"][order] > c["doc"][distinct][of]]
    spans = [{"doc": c["doc"][late], "copy": c["copy"][late], "start": c["start"][late], "end": c["start"][late] + lengths[late]}]
    if len(owner):
        o = np.lexsort((offset, owner))
        owner, offset = owner[o], offset[o]
        head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + LENGTH)])
        low = np.flatnonzero(head)
        high = np.concatenate([low[1:], [len(owner)]]) - 1
        # All occurrences in the smallest document have the same windows removed.
        counts = np.bincount(owner[low], minlength=len(first))
        begin = np.cumsum(counts) - counts
        same = np.flatnonzero(c["doc"][order] == c["doc"][distinct][of])
        same = same[counts[of[same]] > 0]
        per = counts[of[same]]
        which = np.repeat(begin[of[same]] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        row = np.repeat(order[same], per)
        spans.append({"doc": c["doc"][row], "copy": c["copy"][row], "start": c["start"][row] + offset[low][which], "end": c["start"][row] + offset[high][which] + LENGTH})
    return spans


def _sort_segments(shards: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("packed").to_pylist()
        spans = [unpack(b, SPAN)[0] for k, b in zip(kinds, blobs) if k == 1]
        parts = [unpack(b, SEGMENT) for k, b in zip(kinds, blobs) if k == 0]
        if parts:
            c = joined([p[0] for p in parts], SEGMENT)
            data = np.frombuffer(b"".join(p[1] for p in parts), "uint8")
            del parts
            lengths = c["length"].astype("int64")
            starts = np.cumsum(lengths) - lengths
            for part in np.unique(c["part"]):
                own = np.flatnonzero(c["part"] == part)
                spans += _late_spans(taken(c, own), ragged(data, starts[own], lengths[own]))
        s = merged(joined(spans, SPAN))
        return blob_table(dealt(s, doc_shard(s["doc"], shards), SPAN, 1, shards))

    return run


def _apply(texts: pa.Table, spans: pa.Table) -> pa.Table:
    s = merged(joined([unpack(b, SPAN)[0] for b in spans.column("packed").to_pylist()] if spans.num_rows else [], SPAN))
    first = np.flatnonzero(np.concatenate([[True], (s["doc"][1:] != s["doc"][:-1]) | (s["copy"][1:] != s["copy"][:-1])])) if len(s["doc"]) else np.zeros(0, "int64")
    where = {(int(s["doc"][a]), int(s["copy"][a])): (a, b) for a, b in zip(first, np.append(first[1:], len(s["doc"])))}
    out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans")}
    for data, bounds, ids, copies, _ in _parts(texts, 1, 2) if texts.num_rows else ():
        for i, (doc, copy) in enumerate(zip(ids.tolist(), copies.tolist())):
            own = data[bounds[i] : bounds[i + 1]]
            a, b = where.get((doc, copy), (0, 0))
            runs = list(zip(s["start"][a:b].tolist(), s["end"][a:b].tolist()))
            edges = [0, *[x for r in runs for x in r], len(own)]
            kept = b"".join(own[edges[k] : edges[k + 1]].tobytes() for k in range(0, len(edges), 2))
            for c, v in zip(out, (doc, len(own), len(own) - len(kept), len(runs), kept, [{"start": x, "end": y} for x, y in runs])):
                out[c].append(v)
    types = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, spans`` of every row of ``docs``: its text as UTF-8 bytes without those covered by a string of LENGTH
    bytes that also starts in a document with a smaller doc_id.

    Strings are judged on the input and may overlap; none reaches over the end of a text. A null text is empty. A row without doc_id neither
    loses bytes nor counts as earlier; repeated rows lose the same bytes, and none because of each other. An empty table gives no rows.

    Windows pick anchors; each shard of documents sends every key of its anchors once and learns which ones other shards hold. Only the bytes around
    anchors of several documents travel on, to the group of their key. Those that differ and agree with another one around their anchor, far enough for a common
    window, meet in a suffix array by induced sorting, whose permuted common prefixes find the windows that an earlier document holds. Rows of one doc_id that differ are told apart by the order of their bytes.
    """
    d = documents(docs, "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    named, bare = d.where("doc_id IS NOT NULL"), d.where("doc_id IS NULL")
    spread = lambda df, n=shards: df.repartition(min(n, MOST_PARTITIONS), "shard").groupBy("shard")
    # The document's shard is computed by the same function here and in the tasks.
    texts = named.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(doc_shard(b.column(0).to_numpy(), shards)), b.column(0), b.column(1)], ["shard", "doc_id", "text"]) for b in batches), "shard long, doc_id long, text string")
    key_shards = -(-shards // TOGETHER)
    keys = spread(texts).applyInArrow(_deal_keys(key_shards), BLOBS)
    repeated = spread(keys, key_shards).applyInArrow(_repeated_keys(shards), BLOBS)
    segments = spread(texts).cogroup(spread(repeated)).applyInArrow(_cut_segments(shards), BLOBS)
    spans = spread(segments).applyInArrow(_sort_segments(shards), BLOBS)  # more partitions than groups, so that few hold two
    found = spread(texts).cogroup(spread(spans)).applyInArrow(_apply, RESULT)
    alone = bare.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                        F.encode("text", "UTF-8").alias("kept"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return found.unionByName(alone)

