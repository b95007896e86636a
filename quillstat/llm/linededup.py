"""Line dedup: an exact set-similarity join of lines by prefix, length and position filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.blobs import BLOBS, blob_table, dealt, joined, taken, unpack
from quillstat.llm.common import MOST_PARTITIONS, cells, documents, written
from quillstat.llm.neardup import _in_cells
from quillstat.llm.words import mix

SKETCH_BITS, SKETCH_BLOCK = 22, 1 << 16
BATCH_BYTES = 512 << 10
PAIR = [("doc", "<i8", 8), ("line", "<i4", 4), ("other_doc", "<i8", 8), ("other_line", "<i4", 4)]
ENTRY = [("key", "<u8", 8), ("doc", "<i8", 8), ("line", "<i4", 4), ("n", "<i4", 4), ("pos", "<i4", 4), ("b0", "<u8", 8), ("b1", "<u8", 8)]
DEAL_ROWS = 1 << 16  # entries that a task packs at once
LARGE = [("key", "<u8", 8), ("doc", "<i8", 8), ("line", "<i4", 4), ("n", "<i4", 4), ("pos", "<i4", 4), ("b0", "<u8", 8), ("b1", "<u8", 8), ("n_rows", "<i8", 8)]
SMALL_GROUP, GROUP_BLOCK = 256, 1024
SHARD_BYTES = 16 << 20
TOKEN_BITS = 42
SEEN = 100_000
# A token is common from one word in 2 ** COMMON_BITS on (64 occurrences at least). Two lines whose rarest shared token is common share a second such
# token in prefixes that are one longer, so pairs of common tokens are keys. Lines of more than LONG words have too many pairs: those near that size
# have both kinds of keys, longer ones single tokens.
COMMON_BITS, LONG = 19, 160
MATCHES = "kind int, key long, doc long, line int, n int, pos int, b0 long, b1 long, other_doc long, other_line int, n_rows long"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "uint64")  # the first k of eight bytes
LONG_WORD = 64


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``BATCH_BYTES`` of text (or one longer text)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the bounds of each."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], "int32")[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts, where their words start, and a hash of each word."""
    data, bounds = text_bytes(texts)
    inside = (data - np.uint8(9) > 4) & (data != 32)  # below 9 it wraps around
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts = np.flatnonzero(inside & (edge[:-1] | before))
    ends = np.flatnonzero(inside & (edge[1:] | after)) + 1
    lengths = ends - starts
    lower = np.zeros(len(data) + 8, "uint8")
    lower[: len(data)] = data | ((data - np.uint8(65) < 26).view("uint8") << 5)  # A-Z count as a-z
    eight = np.ndarray(len(data) + 1, "<u8", lower, strides=(1,))  # eight bytes from every place on
    hashes = (eight[starts] & _MASKS[np.minimum(lengths, 8)]) + lengths.astype("uint64") * _BASE
    longer, at = np.flatnonzero(lengths > 8), 8
    while len(longer) and at < LONG_WORD:
        rest = lengths[longer] - at
        hashes[longer] = mix(hashes[longer]) + (eight[starts[longer] + at] & _MASKS[np.minimum(rest, 8)])
        longer, at = longer[rest > 8], at + 8
    for w in longer.tolist():
        hashes[w] ^= np.uint64(xxhash.xxh64_intdigest(lower[starts[w] + at : ends[w]]))
    hashes = mix(hashes)
    return data, bounds, starts, hashes >> np.uint64(64 - TOKEN_BITS)


def line_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of every line that has a word: row number and line number of each line, bounds, and sorted tokens."""
    data, bounds, starts, tokens = word_tokens(texts)
    nothing = np.zeros(0, "int64")
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(bounds[1:], breaks, "right")
    row = np.concatenate([np.arange(len(bounds) - 1), of_break])
    at = np.concatenate([bounds[:-1], breaks + 1])
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    number = np.arange(len(row)) - np.searchsorted(row, row, "left")
    if not len(starts):
        return nothing, nothing, np.zeros(1, "int64"), np.zeros(0, "uint64")
    words = np.diff(np.searchsorted(starts, np.concatenate([at, [len(data)]]), "left"))
    used = np.flatnonzero(words)
    owner = np.repeat(np.arange(len(used)), words[used])
    if len(used) < 1 << (64 - TOKEN_BITS):
        both = np.sort((owner.astype("uint64") << np.uint64(TOKEN_BITS)) | tokens)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        owner, tokens = (both >> np.uint64(TOKEN_BITS)).astype("int64"), both & np.uint64((1 << TOKEN_BITS) - 1)
    else:
        order = np.lexsort((tokens, owner))
        owner, tokens = owner[order], tokens[order]
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])])
        owner, tokens = owner[first], tokens[first]
    first = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
    return row[used], number[used], np.flatnonzero(first), tokens


def _scale(occurrences):
    return np.minimum(255, 2 + np.ceil(5 * np.log2(occurrences))).astype("int64")


def token_rarity(docs: DataFrame) -> tuple[bytes, int, int]:
    """A table of fixed size with the rarity of every token: occurrences of the tokens of its place, over all documents, on a logarithmic scale.

    1 says that the corpus holds it once. Tokens that share a place share a rarity, which changes the order of a line's
    tokens but no result, since the filters hold for any order that all lines follow. Also gives the rarity up to which a token isn't common, and the bytes of all texts.
    """
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size_of_texts = np.zeros(size, "int64"), 0
        for batch in batches:
            for part in slices(batch, 0):
                data, _, _, tokens = word_tokens(part.column(0))
                np.add.at(counts, (tokens & np.uint64(size - 1)).astype("int64"), 1)
                size_of_texts += len(data)
        blocks, packed = [], []
        for b in range(size // SKETCH_BLOCK):
            own = counts[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK]
            at = np.flatnonzero(own)
            if len(at):
                blocks.append(b)
                packed.append(at.astype("uint16").tobytes() + own[at].tobytes())
        if blocks:
            sizes = [size_of_texts] + [0] * (len(blocks) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], ["block", "packed", "bytes"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, "int64")
        for b in table.column("packed").to_pylist():
            n = len(b) // 10
            total[np.frombuffer(b, "uint16", n)] += np.frombuffer(b, "int64", n, 2 * n)
        rarity = np.where(total > 1, _scale(np.maximum(total, 1)), total).astype("uint8")
        return pa.table({"block": table.column("block").slice(0, 1), "words": [int(total.sum())], "bytes": [sum(table.column("bytes").to_pylist())], "rarity": pa.array([rarity.tobytes()], pa.binary())})

    counted = documents(docs, "text").select("text").mapInArrow(count, "block int, packed binary, bytes long")
    table, words, size_of_texts = bytearray(size), 0, 0
    for row in counted.groupBy("block").applyInArrow(add, "block int, words long, bytes long, rarity binary").collect():
        table[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = row.rarity
        words, size_of_texts = words + row.words, size_of_texts + row.bytes
    return bytes(table), _scale(max(64, words >> COMMON_BITS)), size_of_texts


def _needed(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest intersection of sets of these sizes that is similar enough."""
    return -(-(percent * (a + b)) // (100 + percent))


def _may_match(percent, na, pa_, a0, a1, nb, pb, b0, b1) -> np.ndarray:
    """Length, position and bitmap filters for pairs that share a token at these places of their prefixes."""
    need = _needed(percent, na, nb)
    rest = 1 + np.minimum(na - pa_, nb - pb) - 1
    apart = np.bitwise_count(a0 ^ b0).astype("int64") + np.bitwise_count(a1 ^ b1)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (rest >= need) & (apart <= na + nb - 2 * need)


def _line_names(c: dict[str, np.ndarray]) -> np.ndarray:
    return mix(c["doc"].astype("int64").view("uint64") + mix(c["line"].astype("uint64")))


def matching_lines(docs: DataFrame, rarity: bytes, common_from: int, percent: int, least: int, shards: int) -> DataFrame:
    """Rows of ``MATCHES``: kind 0, a line whose set an earlier line has; 1 and 3, a pair of lines (the other earlier) that passes the filters;
    2, a line in a large group of a prefix token. A line of kind 0 has no rows of the other kinds.

    Each line gives one entry for its set, one for each rare token of its prefix that other lines hold, and one for each pair of common ones; entries
    travel packed by shard.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(rarity, "uint8")
        seen: dict[int, tuple[int, int]] = {}
        older: dict[int, tuple[int, int]] = {}
        entries: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            types = [np.dtype(t) for _, t, _ in ENTRY]
            c = {m: np.concatenate([e[i] for e in entries]).astype(types[i], copy=False) for i, (m, _, _) in enumerate(ENTRY)}
            entries.clear()
            found = dealt(c, ((c["key"] >> np.uint64(1)) % np.uint64(shards)).astype("int64"), ENTRY, 0, shards)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], ["shard", "packed"])

        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(0).to_numpy()
                row, number, bounds, tokens = line_tokens(part.column(1))
                sizes = np.diff(bounds)
                big = np.flatnonzero(sizes >= least)
                if not len(big):
                    continue
                names = np.add.reduceat(mix(tokens + np.uint64(11)), bounds[:-1]) * np.uint64(2) + np.uint64(1)
                # Copies within the part: only the earliest one goes on; the later ones are reported at once.
                if len(seen) > SEEN:
                    seen, older = {}, seen
                fresh, gone = [], []
                for k in big.tolist():
                    name, me = int(names[k]), (int(ids[row[k]]), int(number[k]))
                    before = seen.get(name) or older.get(name)
                    if before is None or me < before:
                        fresh.append(k)
                        seen[name] = me
                        if before is not None:
                            gone.append((name, *before))
                    elif me != before:
                        gone.append((name, *me))
                fresh = np.array(fresh, dtype="int64")
                if gone:
                    g = np.array([x[1:] for x in gone], "int64")
                    zero = np.zeros(len(g), "int64")
                    entries.append((np.array([x[0] for x in gone], "uint64"), g[:, 0], g[:, 1].astype("int32"), zero.astype("int32"), np.full(len(g), -2, "int32"), zero.view("uint64"), zero.view("uint64")))
                if len(fresh):
                    n, small = sizes[fresh], sizes[fresh].astype("int32")
                    take = np.repeat(bounds[fresh] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    own, line = tokens[take], np.repeat(np.arange(len(fresh)), n)
                    rank = table[(own & np.uint64((1 << SKETCH_BITS) - 1)).astype("int64")].astype("uint64")
                    bit = np.uint64(1) << (own & np.uint64(63))
                    high = (own >> np.uint64(6)) & np.uint64(1) == 1
                    at = np.cumsum(n) - n
                    # A bit tells whether an odd number of tokens falls on it: shared tokens cancel out, so long lines don't fill the sketch.
                    b0 = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), at)
                    b1 = np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), at)
                    # Rarest first within each line. A key keeps the rarity and 34 bits of its token.
                    key = (rank << np.uint64(34)) | (own & np.uint64((1 << 34) - 1))
                    if len(fresh) < 1 << 22:
                        key = np.sort((line.astype("uint64") << np.uint64(42)) | key) & np.uint64((1 << 42) - 1)
                    else:
                        key = key[np.lexsort((key, line))]
                    place = np.arange(len(key)) - np.repeat(at, n)
                    doc, num = ids[row[fresh]], number[fresh].astype("int32")
                    entries.append((names[fresh], doc, num, small, np.full(len(n), -1, "int32"), b0, b1))
                    ahead = np.repeat(n - -(-percent * n // 100) + 1, n)  # tokens of the prefix
                    scale = key >> np.uint64(34)
                    rare, common, own_n = (scale > 1) & (scale <= common_from), scale > np.uint64(common_from), n[line]
                    single = (place < ahead) & (rare | common & (own_n > LONG * percent // 100))
                    of = line[single]
                    entries.append((mix(key[single] + common[single] * np.uint64(1 << 43)) & ~np.uint64(1), doc[of], num[of], small[of], place[single].astype("int32"), b0[of], b1[of]))
                    at_pair = np.flatnonzero((place <= ahead) & common & (own_n <= -(-LONG * 100 // percent)))
                    for d in range(1, len(at_pair)):
                        x, y = at_pair[:-d], at_pair[d:]
                        same = line[x] == line[y]
                        if not same.any():
                            break
                        x, y = x[same], y[same]
                        of = line[x]
                        entries.append((mix(mix(key[x]) + key[y]) & ~np.uint64(1), doc[of], num[of], small[of], place[x].astype("int32"), b0[of], b1[of]))
                if sum(len(e[0]) for e in entries) >= DEAL_ROWS:
                    yield packed()
        if entries:
            yield packed()

    def meet(table: pa.Table) -> pa.Table:
        c = joined([unpack(b, ENTRY)[0] for b in table.column("packed").to_pylist()], ENTRY)
        key, doc, line, n, pos, b0, b1 = (c[m] for m, _, _ in ENTRY)
        told = pos == -2
        out = [(0, key[told], doc[told], line[told], None)]
        key, doc, b0, b1, line, n, pos = (x[~told] for x in (key, doc, b0, b1, line, n, pos))
        order = np.lexsort((line, doc, n, key))
        key, doc, b0, b1, line, n, pos = (x[order] for x in (key, doc, b0, b1, line, n, pos))
        # Repeated rows give equal entries from several tasks: one is enough.
        again = np.zeros(len(key), bool)
        again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in (key, doc, line, n, pos, b0, b1)])
        key, doc, b0, b1, line, n, pos = (x[~again] for x in (key, doc, b0, b1, line, n, pos))
        n, pos = n.astype("int64"), pos.astype("int64")
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        counts = np.diff(np.concatenate([starts, [len(key)]]))
        size, place = np.repeat(counts, counts), np.arange(len(key)) - np.repeat(starts, counts)
        again = (pos == -1) & (place > 0)
        origin = np.arange(len(key)) - place
        again &= (doc != doc[origin]) | (line != line[origin])
        out.append((0, key[again], doc[again], line[again], None))
        small = (pos >= 0) & (size <= SMALL_GROUP)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        y, d = np.flatnonzero(small), 0
        while len(y):
            # A group is in order of size: once a line's partner is too short, those before it are as well.
            d += 1
            y = y[place[y] >= d]
            y = y[100 * n[y - d] >= percent * n[y]]
            x = y - d
            ok = _may_match(percent, n[x], pos[x], b0[x], b1[x], n[y], pos[y], b0[y], b1[y]) & ((doc[x] != doc[y]) | (line[x] != line[y]))
            pairs.append((x[ok], y[ok]))
        x, y = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, "int64") for i in (0, 1))
        late = (doc[x] > doc[y]) | (doc[x] == doc[y]) & (line[x] > line[y])
        x, y = np.where(late, y, x), np.where(late, x, y)
        name = mix(doc[y].view("uint64") + mix(line[y].astype("uint64") + mix(doc[x].view("uint64") + mix(line[x].astype("uint64")))))
        once = np.unique(name, return_index=True)[1]
        x, y = x[once], y[once]
        out.append((1, key[y], doc[y], line[y], x))
        rows = []
        for kind, k, dd, ll, x in out:
            c = {"doc": dd, "line": ll, "other_doc": dd if x is None else doc[x], "other_line": ll if x is None else line[x]}
            shard = (_line_names(c) % np.uint64(shards)).astype("int64")
            rows.append((kind, shard, c))
        large = np.flatnonzero((pos >= 0) & (size > SMALL_GROUP))
        c = {"key": key[large], "doc": doc[large], "line": line[large], "n": n[large], "pos": pos[large], "b0": b0[large], "b1": b1[large], "n_rows": size[large]}
        of = (_line_names(c) % np.uint64(shards)).astype("int64")
        found = [x for kind in (0, 1) if (own := [r for r in rows if r[0] == kind]) for x in dealt({m: np.concatenate([r[2][m] for r in own]) for m, _, _ in PAIR}, np.concatenate([r[1] for r in own]), PAIR, kind, shards)]
        return blob_table(found + dealt(c, of, LARGE, 2, shards))

    def settle(table: pa.Table) -> pa.Table:
        """Each removed line and each pair once: all entries of a line have come to its shard. A line whose set an earlier line has needs no other entry:
        that line is in the same groups, at the same places."""
        columns: dict[str, list] = {name.split()[0]: [] for name in MATCHES.split(", ")}
        blobs = list(zip(table.column("kind").to_pylist(), table.column("packed").to_pylist()))
        gone = np.zeros(0, "uint64")
        for kind, layout in ((0, PAIR), (1, PAIR), (2, LARGE)):
            c = joined([unpack(b, layout)[0] for k, b in blobs if k == kind], layout)
            if kind == 0:
                gone = np.unique(_line_names(c))
            else:
                c = taken(c, np.flatnonzero(~np.isin(_line_names(c), gone)))
            if kind < 2:
                name = mix(c["doc"].view("uint64") + mix(c["line"].astype("uint64") + mix(c["other_doc"].view("uint64") + mix(c["other_line"].astype("uint64")))))
                c = taken(c, np.unique(name, return_index=True)[1])
                order = np.lexsort((c["other_line"], c["other_doc"], c["line"], c["doc"]))
                c = taken(c, order)
            # Of a line's pairs the one with the earliest line comes first; the others (kind 3) only count if that one fails.
            first = np.concatenate([[True], (c["doc"][1:] != c["doc"][:-1]) | (c["line"][1:] != c["line"][:-1])])[: len(c["doc"])]
            for m, v in columns.items():
                v.append((np.where(first, 1, 3) if kind == 1 else np.full(len(c["doc"]), kind)) if m == "kind" else c[m].view("int64") if m in ("key", "b0", "b1") and m in c else c.get(m, np.zeros(len(c["doc"]), "int64")))
        ints = {"kind", "line", "n", "pos", "other_line"}
        return pa.table({m: pa.array(np.concatenate(v).astype("int32" if m in ints else "int64")) for m, v in columns.items()})

    rows = documents(docs, "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    partitions = min(shards, MOST_PARTITIONS)
    met = rows.mapInArrow(deal, "shard long, packed binary").repartition(partitions, "shard").groupBy("shard").applyInArrow(meet, BLOBS)
    return met.repartition(partitions, "shard").groupBy("shard").applyInArrow(settle, MATCHES)


def size_classes(percent: int, most: int = 1 << 40) -> list[int]:
    """First size of each class: two sizes that can match are of one class or of neighbouring ones."""
    starts = [1]
    while starts[-1] < most:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


def _by_size(large: DataFrame, percent: int) -> DataFrame:
    """Large groups by size class: a group has the lines of one class (``top``) and of the class below it, a line is in two of them. ``key`` is made anew."""
    starts = ", ".join(f"{x}L" for x in size_classes(percent))
    sized = large.withColumn("class", F.expr(f"size(filter(array({starts}), x -> x <= n))"))
    grouped = sized.withColumn("group", F.explode(F.array("class", F.col("class") + 1)))
    return grouped.withColumn("top", F.col("class") == F.col("group")).withColumn("key", F.xxhash64("key", "group")).drop("class", "group")


def _live(percent: int):
    def visit(rows: pd.DataFrame) -> pd.DataFrame | None:
        if not rows["top"].any() or not rows["open"].any():
            return None
        top = rows["top"].to_numpy()
        doc, line, n, pos, part = (rows[c].to_numpy() for c in ("doc", "line", "n", "pos", "part"))
        n, pos = n.astype("int64"), pos.astype("int64")
        b0, b1 = rows["b0"].to_numpy().view("uint64"), rows["b1"].to_numpy().view("uint64")
        across = rows["cell_a"].iloc[0] != rows["cell_b"].iloc[0]
        live, probe = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        for y in np.flatnonzero(rows["open"].to_numpy()):  # of the others it is known that they go
            ok = _may_match(percent, n, pos, b0, b1, n[y], pos[y], b0[y], b1[y]) & ((doc < doc[y]) | (doc == doc[y]) & (line < line[y]))
            if across:
                ok &= part != part[y]
            if not top[y]:
                ok &= top  # lines of the lower class meet in their own group
            if ok.any():
                live |= ok
                live[y] = probe[y] = True
        return rows.assign(probe=probe).loc[live, ["key", "cell_a", "cell_b", "part", "id", "doc", "line", "probe"]] if live.any() else None

    return visit


def _matched(percent: int):
    def visit(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.sort_values(["doc", "line"], kind="stable")
        sets = [np.frombuffer(s, "uint64") for s in rows["tokens"]]
        sizes = np.array([len(s) for s in sets])
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        asked = np.flatnonzero(rows["probe"].to_numpy())  # the others only serve as candidates here
        both = np.zeros((len(asked), len(sets)), "float32")
        for low in range(0, len(values), 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            m = np.zeros((len(sets), 4096), "float32")
            m[owner[a:b], column[a:b] - low] = 1
            both += m[asked] @ m.T
        alike = 100 * both >= percent * (sizes[asked, None] + sizes[None, :] - both)
        doc, line = rows["doc"].to_numpy(), rows["line"].to_numpy()
        alike &= (doc[asked, None] != doc[None, :]) | (line[asked, None] != line[None, :])  # a line isn't similar to itself
        alike &= np.arange(len(sets))[None, :] < asked[:, None]
        later = asked[alike.any(axis=1)]
        return rows.iloc[later][["doc", "line"]] if len(later) else None

    return visit


def repeated_lines(docs: DataFrame, percent: int = 80, least: int = 5) -> DataFrame:
    """``doc_id, line`` (numbers from 0) of the lines to remove: those for which an earlier line of the corpus is similar enough.

    A line is the set of its distinct words in lower case; lines are ordered by doc_id and number, and two match if
    ``100 * |A & B| >= percent * |A | B|``. Lines are judged on the input, so a line also goes if the line it matches goes. Lines of fewer than
    ``least`` distinct words take no part, nor do rows without doc_id or text. Rows with the same doc_id share line numbers. Texts and lines of any
    length are whole; an empty table gives no rows.
    """
    rarity, common_from, size = token_rarity(docs)
    shards = max(1, -(-size // SHARD_BYTES))
    found = written(matching_lines(docs, rarity, common_from, percent, least, shards), "matches")
    exact = found.where("kind = 0").select("doc", "line")
    pairs = found.where("kind IN (1, 3)").select("kind", "doc", "line", "other_doc", "other_line")

    large = _by_size(found.where("kind = 2").drop("n_rows").withColumn("id", F.xxhash64("doc", "line")), percent)
    # In large groups each line is first compared with two lines only, the first and the last of the earliest lines of its groups: copies settle there.
    earliest = large.groupBy("key").agg(F.min(F.struct("doc", "line")).alias("other"))
    first = large.join(earliest, "key").where("struct(doc, line) > other").groupBy("doc", "line").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    first = first.select("doc", "line", F.explode(F.array_distinct(F.array("low", "high"))).alias("other"))
    first = first.select(F.lit(1).alias("kind"), "doc", "line", F.col("other.doc").alias("other_doc"), F.col("other.line").alias("other_line"))
    pairs = written(pairs.unionByName(first), "pairs")
    # The sets of all lines that may be compared are read at once, so that the texts are shuffled once.
    wanted = pairs.select("doc", "line").unionByName(pairs.select(F.col("other_doc").alias("doc"), F.col("other_line").alias("line"))).unionByName(found.where("kind = 2").select("doc", "line"))
    sets = written(line_sets(docs, wanted), "sets")

    held = lambda d, n, name: sets.select(F.col("doc").alias(d), F.col("line").alias(n), F.col("tokens").alias(name))
    with_sets = lambda p: p.select("doc", "line", "other_doc", "other_line").join(held("doc", "line", "a"), ["doc", "line"]).join(held("other_doc", "other_line", "b"), ["other_doc", "other_line"])
    best = written(_confirmed(with_sets(pairs.where("kind = 1")), percent).distinct(), "best")
    rest = written(_confirmed(with_sets(pairs.where("kind = 3").join(best, ["doc", "line"], "left_anti")), percent).distinct(), "rest")

    # What is still open meets the other lines of its groups, in cells.
    settled = best.unionByName(rest).distinct().withColumn("gone", F.lit(True))
    large = large.join(settled, ["doc", "line"], "left").withColumn("open", F.col("gone").isNull()).drop("gone")
    sizes = large.groupBy("key").agg(F.count("*").alias("n_rows"), F.bool_or("top").alias("tops"), F.bool_or("open").alias("opens")).where("n_rows > 1 AND tops AND opens").drop("tops", "opens")
    live = _in_cells(cells(large, sizes, "key", "id", GROUP_BLOCK, "open"), ["id", "doc", "line", "n", "pos", "b0", "b1", "top", "open"], _live(percent), "key long, cell_a int, cell_b int, part int, id long, doc long, line int, probe boolean")
    live = written(live, "live")
    matched = _in_cells(live.join(sets, ["doc", "line"]), ["id", "doc", "line", "probe", "tokens"], _matched(percent), "doc long, line int")
    return best.unionByName(rest).unionByName(matched).unionByName(exact).select(F.col("doc").alias("doc_id"), "line").distinct()


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, line, tokens`` of the lines named by ``wanted`` (``doc, line``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, lines = part.column(0).to_numpy(), part.column(2).to_pylist()
                row, number, bounds, tokens = line_tokens(part.column(1))
                ask = [set(x) for x in lines]
                hit = [k for k in range(len(row)) if int(number[k]) in ask[row[k]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[hit]] if hit else [], pa.int64()), pa.array(number[hit] if hit else [], pa.int32()), pa.array([tokens[bounds[k] : bounds[k + 1]].tobytes() for k in hit], pa.binary())], ["doc", "line", "tokens"])

    asked = wanted.groupBy("doc").agg(F.collect_set("line").alias("lines"))
    rows = documents(docs, "text").join(asked, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "lines")
    return rows.mapInArrow(run, "doc long, line int, tokens binary").dropDuplicates(["doc", "line"])


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                a, b = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    good.append(k)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("line").take(take)], ["doc", "line"])

    return pairs.select("doc", "line", "a", "b").mapInArrow(run, "doc long, line int")


def without_repeated_lines(docs: DataFrame, percent: int = 80, least: int = 5) -> DataFrame:
    """``docs`` with all columns, its text without the repeated lines, and ``n_lines, n_removed``. A null text stays null and has no lines."""
    gone = repeated_lines(docs, percent, least).groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set("line").alias("_gone"))
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone_id"), "left")
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("text").cast("string")).otherwise(F.array_join(left, "\n"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    removed = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left))
    return joined.select(*kept, text.alias("text"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
