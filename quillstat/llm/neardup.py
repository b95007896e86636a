"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import MOST_PARTITIONS, cells, documents, written
from quillstat.llm.components import connected_components
from quillstat.llm.words import Signer, mix, shingle_sets

# A signature has CHUNKS x WIDTH positions of 16 bits. Two signatures that differ in at most DISTANCE positions differ in at most one
# position of some chunk, since CHUNKS chunks with two or more errors each would make 2 x CHUNKS > DISTANCE. At similarity 0.8 a position differs
# with chance 0.2: of 70 positions 14 on average, more than 27 with a chance below 1e-4.
CHUNKS, WIDTH = 14, 5
POSITIONS, DISTANCE = CHUNKS * WIDTH, 2 * CHUNKS - 1
GROUP_BLOCK = 1024
SHARD_KEYS = 1_000_000


NAMES = ["set_a", "set_b", "n_shingles"]


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 128-bit name of each set, and its size."""
    name_a = np.array([int(s.sum(dtype="uint64")) for s in sets], "uint64").view("int64")
    name_b = np.array([int(mix(s).sum(dtype="uint64")) for s in sets], "uint64").view("int64")
    return name_a, name_b, np.array([len(s) for s in sets], "int64")


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` (a 128-bit name of the set) and ``signature`` (null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(POSITIONS)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingle_sets(part.column(1), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                signatures: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signer.sign([sets[i] for i in full])):
                        signatures[i] = row.tobytes()
                name_a, name_b, sizes = _names(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(name_a), pa.array(name_b), pa.array(signatures, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return documents(docs, "text").select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``id, shingles`` (little-endian 64-bit hashes, sorted) of the sets of ``nodes`` (``id``, ``doc_id`` of a text that has the set, and its name).

    A doc_id may have several texts: those with another set than the node's are left out, and equal rows are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingle_sets(part.column(1), shingle)
                same = np.ones(len(sets), bool)
                for name, asked in zip(_names(sets), part.columns[2:]):
                    same &= name == asked.to_numpy()
                keep = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["id", "shingles"])

    # A merge join at every size: the nodes grow with the input, and one shuffle of the texts also puts repeated rows together.
    texts = documents(docs, "text").join(nodes.select("doc_id", "id", *NAMES).hint("merge"), "doc_id").withColumn("_same", F.xxhash64("text"))
    wanted = texts.dropDuplicates(["doc_id", "id", "_same"])
    return wanted.select("id", "text", *NAMES).mapInArrow(run, "id long, shingles binary")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature: for each chunk and each place in it that may differ, the other positions."""
    out = np.empty((len(signatures), CHUNKS * WIDTH), "uint64")
    wide = signatures.astype("uint64")
    for c in range(CHUNKS):
        for skip in range(WIDTH):
            key = np.zeros(len(signatures), "uint64")
            for p in range(WIDTH):
                if p != skip:
                    key = (key << np.uint64(16)) | wide[:, c * WIDTH + p]
            out[:, c * WIDTH + skip] = mix(key + np.uint64(c * WIDTH + skip) * np.uint64(0x9E3779B97F4A7C15))
    return out


def shared_keys(signatures: DataFrame, shards: int) -> DataFrame:
    """``pivot, id`` for every key that several signatures have; ``pivot`` is the smallest id with the key. A shard gives a pair once.

    Keys travel packed, one row per batch and shard, and each shard sorts its own.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys = chunk_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), "uint16").reshape(len(ids), POSITIONS)).ravel()
            owners = np.repeat(ids, CHUNKS * WIDTH)
            shard = (keys % np.uint64(shards)).astype("int64")
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            full = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
            packed = [np.stack([keys[o].view("int64"), owners[o]]).tobytes() for o in (order[bounds[s] : bounds[s + 1]] for s in full)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packed, pa.binary())], ["shard", "packed"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, "int64").reshape(2, -1) for b in table.column("packed").to_pylist()]
        keys, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(keys)]]))
        pivots = np.repeat(ids[starts], counts)
        pairs = np.unique(np.stack([pivots, ids])[:, pivots != ids], axis=1)
        return pa.table({"pivot": pairs[0], "id": pairs[1]})

    dealt = signatures.select("id", "signature").mapInArrow(deal, "shard long, packed binary").repartition(min(shards, MOST_PARTITIONS), "shard")
    return dealt.groupBy("shard").applyInArrow(meet, "pivot long, id long")


def _differing(a: str, b: str) -> F.Column:
    """Positions in which two binary signatures differ."""
    return F.expr(f"aggregate(sequence(1, {2 * POSITIONS - 1}, 2), 0, (n, i) -> n + IF(substring({a}, i, 2) = substring({b}, i, 2), 0, 1))")


def _in_cells(rows: DataFrame, columns: list[str], visit, schema: str) -> DataFrame:
    """Run ``visit`` on every (key, cell) of the rows, streaming through partitions sorted by cell."""
    names = ["key", "cell_a", "cell_b", "part", *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            marks = rows[["key", "cell_a", "cell_b"]].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1])
            held = rows.iloc[starts[-1] :]
            out = [visit(rows.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            if out := [o for o in out if o is not None]:
                yield pd.concat(out, ignore_index=True)
        if held is not None and len(held) and (o := visit(held)) is not None:
            yield o

    ordered = rows.select(*names).repartition("key", "cell_a", "cell_b").sortWithinPartitions("key", "cell_a", "cell_b", "part", "id")
    return ordered.mapInPandas(run, schema)


def _near(signatures: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return (signatures[others] != signatures[i]).sum(axis=1) <= DISTANCE


def _live(rows: pd.DataFrame) -> pd.DataFrame | None:
    """Rows of a cell that are within the signature distance of a row of another component in the other block (or in the own cell), where one of the two is
    a stray."""
    if not rows["stray"].any():
        return None
    signatures = np.frombuffer(b"".join(rows["signature"]), "uint16").reshape(len(rows), POSITIONS)
    stray, part, comps = rows["stray"].to_numpy(), rows["part"].to_numpy(), rows["component"].to_numpy()
    across = rows["cell_a"].iloc[0] != rows["cell_b"].iloc[0]
    live = np.zeros(len(rows), bool)
    everyone = np.arange(len(rows))
    for i in np.flatnonzero(stray):
        others = everyone[(comps != comps[i]) & (part != part[i])] if across else everyone[comps != comps[i]]
        near = others[_near(signatures, i, others)]
        if len(near):
            live[i] = True
            live[near] = True
    return rows.loc[live, ["key", "cell_a", "cell_b", "part", "id", "component"]] if live.any() else None


def _link(rows: pd.DataFrame, percent: int) -> pd.DataFrame | None:
    """Links between rows of different components, one for each pair of components that the links of the cell join."""
    comps = rows["component"].to_numpy()
    if (comps == comps[0]).all():
        return None
    ids, part = rows["id"].to_numpy(), rows["part"].to_numpy()
    across = rows["cell_a"].iloc[0] != rows["cell_b"].iloc[0]
    sets = [np.frombuffer(s, "uint64") for s in rows["shingles"]]
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(place, minlength=len(values)) > 1  # a shingle of one row alone is in no intersection
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(sets), len(sets)), "float32")
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(place, [low, low + 4096])
        m = np.zeros((len(sets), 4096), "float32")
        m[owner[a:b], place[a:b] - low] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= percent * union) & (comps[:, None] != comps[None, :])
    if across:
        linked &= part[:, None] != part[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(comps[a]), find(comps[b])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[a], ids[b]))
    return pd.DataFrame(out, columns=["a", "b"]) if out else None


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near-duplicate texts: ``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked if ``100 * |A & B| >= percent * |A | B|`` on their sets of distinct word shingles, confirmed on full sets; each distinct set
    is one node. ``component_id`` is the smallest doc_id reachable. A null or wordless text has an empty set and is linked with nothing. All texts of
    one doc_id are of one class; a row without doc_id has no component and isn't kept, its set takes no part.

    Every pair within the signature distance shares a key and so the smallest node of that key, its pivot. Each node is compared with its pivots on full
    sets, and those that this leaves outside their pivot's component with all nodes of that pivot, in cells of bounded size, so no such pair is lost.
    """
    base = written(signed(docs, shingle), "signed")
    named = base.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = named.groupBy(*NAMES).agg(F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    # One doc_id with several texts ties its sets together.
    repeated = base.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    owned = named.join(repeated, "doc_id").join(nodes.select(*NAMES, "id"), NAMES).select("doc_id", "id").distinct()
    least = owned.groupBy("doc_id").agg(F.min("id").alias("b"))
    ties = owned.join(least, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")

    shards = max(1, -(-nodes.count() * POSITIONS // SHARD_KEYS))
    signature = lambda name: nodes.select(F.col("id").alias(name), F.col("signature").alias(f"s_{name}"))
    pairs = shared_keys(nodes, shards).distinct()
    pairs = written(pairs.join(signature("pivot"), "pivot").join(signature("id"), "id").select("pivot", "id", (_differing("s_pivot", "s_id") <= DISTANCE).alias("near")), "pairs")

    near = pairs.where("near").select("pivot", "id")
    ids = near.select("id").unionByName(near.select(F.col("pivot").alias("id"))).distinct()
    sets = written(full_sets(docs, nodes.join(ids, "id", "left_semi"), shingle), "sets")
    held = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"h_{name}"))
    links = written(_confirmed(near.join(held("pivot"), "pivot").join(held("id"), "id"), percent).unionByName(ties), "links")
    first = connected_components(links, "first")

    # Ids that their links leave outside the component of their pivot are compared with all others of that pivot: two signatures that share a key share
    # its pivot too, so of a linked pair in different components at least one is such a stray.
    of = lambda name: first.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))
    met = pairs.join(of("pivot"), "pivot", "left").join(of("id"), "id", "left").select("pivot", "id", F.coalesce("c_pivot", "pivot").alias("c_pivot"), F.coalesce("c_id", "id").alias("component"))
    met = written(met.withColumn("stray", F.col("c_pivot") != F.col("component")), "met")
    sizes = met.groupBy(F.col("pivot").alias("key")).agg((F.count("*") + 1).alias("n_rows"), F.bool_or("stray").alias("strays"), F.first("c_pivot").alias("component")).where("n_rows > 2 AND strays")
    rows = met.select(F.col("pivot").alias("key"), "id", "component", "stray").unionByName(sizes.select("key", F.col("key").alias("id"), "component", F.lit(False).alias("stray")))
    rows = cells(rows, sizes.select("key", "n_rows"), "key", "id", GROUP_BLOCK)
    rows = rows.join(nodes.select("id", "signature"), "id")
    live = _in_cells(rows, ["id", "component", "stray", "signature"], _live, "key long, cell_a int, cell_b int, part int, id long, component long")
    live = written(live, "live")
    others = live.select("id").distinct().join(ids, "id", "left_anti")
    more_sets = written(full_sets(docs, nodes.join(others, "id", "left_semi"), shingle), "sets")
    sets = sets.unionByName(more_sets)

    open_cells = live.groupBy("key", "cell_a", "cell_b").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("low", "high")
    rows = live.join(open_cells, ["key", "cell_a", "cell_b"]).join(sets, "id")
    more = _in_cells(rows, ["id", "component", "shingles"], lambda r: _link(r, percent), "a long, b long")
    more = written(more.distinct(), "more")
    final = connected_components(links.unionByName(more), "final") if more.head(1) else first

    classes = nodes.select(*NAMES, "id", "doc_id").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = base.join(classes.join(smallest, "component").select(*NAMES, "component_id"), NAMES, "left")
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    # A text without words goes with the other texts of its doc_id.
    joined = found.join(repeated, "doc_id").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_of"))
    found = found.join(joined, F.col("doc_id") == F.col("_id"), "left").withColumn("component_id", F.coalesce("_of", "component_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough, as ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict = {}
            good = []
            for k, (p, x, hp, hx) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("pivot", "id", "h_pivot", "h_id")])):
                if p not in held:
                    held[p] = np.frombuffer(hp, "uint64")
                a, b = held[p], np.frombuffer(hx, "uint64")
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    good.append(k)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("pivot").take(take), batch.column("id").take(take)], ["a", "b"])

    return pairs.select("pivot", "id", "h_pivot", "h_id").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, all columns: the one with the smallest doc_id. Rows without words stay; of rows with the same doc_id one stays (the
    smallest text); rows without doc_id stay."""
    classes = near_duplicates(docs, **options).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(classes, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    named, bare = left.where(F.col("doc_id").isNotNull()), left.where(F.col("doc_id").isNull())
    first = named.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    single = named.join(first, F.col("doc_id") == F.col("_id"), "left_anti")
    several = named.join(first, F.col("doc_id") == F.col("_id"), "left_semi").orderBy("text").dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(bare)
