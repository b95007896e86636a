"""Vectors in shards: packed parts of a shard, and tasks in which queries stream past the index of a shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import written

PARTS = "shard int, dim int, ids binary, labels binary, vectors binary"
QUERIES = "id long, label long, dim int, body binary"
LONG = 2**63 - 1


def narrow(v: np.ndarray) -> bytes:
    """Numbers as bytes: a sign for the width, then 16-bit integers or 32-bit floats where they hold every value, else doubles."""
    if not v.size or (np.abs(v).max() < 2**15 and (v == np.floor(v)).all()):
        return b"h" + v.astype("<i2").tobytes()
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    return b"f" + single.tobytes() if (single == v).all() else b"d" + v.astype("<f8").tobytes()


WIDTHS = {b"h": 2, b"f": 4, b"d": 8}


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {b"h": "<i2", b"f": "<f4", b"d": "<f8"}[b[:1]], offset=1).astype("float64")


def packed(rows: DataFrame, prepare=None) -> DataFrame:
    """``PARTS`` of ``shard, dim, id, label, vector``: the rows of each shard, packed by the batch. Sorted by shard, a batch holds few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, dim, ids, labels = (batch.column(i).to_numpy() for i in range(4))
            vectors, at = batch.column(4).flatten().to_numpy(), np.concatenate([[0], np.cumsum(dim)])
            order = np.lexsort((dim, shard))
            out = []
            for group in np.split(order, np.flatnonzero(np.diff(shard[order]) | np.diff(dim[order])) + 1):
                if len(group):
                    body = np.concatenate([vectors[at[g] : at[g + 1]] for g in group])
                    out.append((int(shard[group[0]]), int(dim[group[0]]), ids[group].tobytes(), labels[group].tobytes(), narrow(prepare(body) if prepare else body)))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "dim", "ids", "labels", "vectors"])

    return rows.select("shard", "dim", "id", "label", "vector").mapInArrow(run, PARTS)


def unpacked(parts: DataFrame) -> DataFrame:
    """``QUERIES``: one row per packed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, dim, ids, labels, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels, mark = np.frombuffer(ids, "int64"), np.frombuffer(labels, "int64"), vectors[:1]
                width = dim * WIDTHS[mark]
                bodies = [mark + vectors[1 + i * width : 1 + (i + 1) * width] for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array([dim] * len(ids), pa.int32()), pa.array(bodies, pa.binary())], ["id", "label", "dim", "body"])

    return parts.mapInArrow(run, QUERIES)


def sharded(rows: DataFrame, condition: str, shard_rows: int, span: int, name: str, prepare=None) -> tuple[DataFrame, DataFrame, int, int]:
    """Written parts of all rows (``id, label, dim, vector``) in shards of about ``shard_rows``, the queries among them, the number of shards and of spans of
    about ``span`` queries. Shards are dealt by a hash of the id, so equal vectors or labels make no hot one."""
    n = rows.select(F.count("*"), F.count(F.when(F.expr(condition), 1))).first()
    shards, spans = max(1, -(-n[0] // shard_rows)), max(1, -(-n[1] // span))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")
    parts = written(packed(dealt, prepare), f"{name}-parts")
    asked = written(packed(rows.where(condition).withColumn("shard", F.lit(0)), prepare), f"{name}-queries")
    return parts, unpacked(asked), shards, spans


def visits(parts: DataFrame, queries: DataFrame, shards: int, spans: int, out: str, build, search, slice_rows: int = 64) -> DataFrame:
    """Every query meets every shard, in tasks of one shard and one span of queries: a task reads the parts of its shard, builds the index once and streams the
    queries past it.

    ``build(ids, labels, vectors)`` makes the index of one dimension; ``search(index, rows)`` gives the result rows of a slice of queries of that dimension,
    each ``(id, label, vector, more)``. The parts of a shard are copied once per span, the queries once per shard.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = parts.select(
        "shard", every(spans).alias("span"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), "dim",
        F.concat("ids", "labels").alias("body"), F.col("vectors").alias("more"))
    asked = queries.select(
        every(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(spans)).cast("int").alias("span"), F.lit(1).alias("kind"), "id", "label", "dim", "body", "more")
    session = parts.sparkSession
    width = min(shards * spans, max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism))
    rows = index.unionByName(asked).repartition(width, "shard", "span").sortWithinPartitions("shard", "span", "kind", "dim", "id")
    columns = [c.split() for c in out.split(", ")]
    types = [pa.float64() if t == "double" else pa.int64() for _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, indexes = None, {}, {}
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            at = 0
            while at < len(rows):
                shard, span, kind, _, _, dim, body, more = rows[at]
                if (shard, span) != place:
                    place, held, indexes = (shard, span), {}, {}
                if kind == 0:
                    held.setdefault(dim, []).append((body, more))
                    at += 1
                    continue
                if dim not in indexes:
                    mine = held.pop(dim, [])
                    ids = [np.frombuffer(b, "int64") for b, _ in mine]
                    indexes = {dim: build(
                        np.concatenate([i[: len(i) // 2] for i in ids]), np.concatenate([i[len(i) // 2 :] for i in ids]),
                        np.concatenate([wide(v).reshape(len(i) // 2, dim) for (_, v), i in zip(mine, ids)])) if mine else None}
                end = at
                while end < len(rows) and end < at + slice_rows and rows[end][:3] == (shard, span, 1) and rows[end][5] == dim:
                    end += 1
                if indexes[dim] is not None:
                    found = search(indexes[dim], [(i, label, wide(b), m) for _, _, _, i, label, _, b, m in rows[at:end]])
                    if found:
                        made = [[max(-LONG, min(LONG, x)) if t == pa.int64() else x for x in c] for c, t in zip(zip(*found), types)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], [c for c, _ in columns])
                at = end

    return rows.mapInArrow(run, out)
