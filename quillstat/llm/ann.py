"""Approximate nearest neighbours by collision counting on sorted projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.shards import sharded, visits

#: Projections; the share of a vector's mean collisions, in standard deviations below it, from which on it is verified; growth of the windows from level to
#: level; the first level, of the nearest of SAMPLE rows; rows of an index; queries that pass an index in one task.
PROJECTIONS, BELOW, GROWTH, FIRST, SAMPLE = 128, 0.6, 1.05, 0.65, 256
SHARD_ROWS, SPAN = 16384, 32768
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, vector, dim``: vectors that have an id, a component other than 0 and only finite ones; of rows with the same id the smallest vector."""
    d = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    sound = "id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vector, x -> x <> 0)"
    d = d.where(F.coalesce(F.expr(sound), F.lit(False)))
    return d.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors as rows, each brought near 1 by a power of two, which changes no digit of a cosine."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _collision_chance(dim: int) -> float:
    """Chance that a vector at distance R differs from the query by at most R / sqrt(dim) on one axis."""
    t = np.linspace(-1, 1, 200_001)[1:-1]
    density = (1 - t * t) ** ((dim - 3) / 2)
    return float(density[np.abs(t) <= 1 / np.sqrt(dim)].sum() / density.sum()) if dim > 1 else 1.0


class CollisionIndex:
    """Sorted projections of one shard on the axes of several random orthonormal bases.

    A level of radius R has windows of half width R / sqrt(dim) around the query on every axis; the next level's windows are wider, so only what they add is
    counted. A vector at distance R collides on ``p`` of the axes on average, a farther one on fewer: those that reach the threshold, a little below the mean,
    are verified. The search ends when all k verified distances lie within the level's radius.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 5):
        self.ids, self.vectors = ids, _scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = self.vectors / self.norms[:, None]
        dim = vectors.shape[1]
        r = np.random.default_rng(seed)
        self.axes = np.concatenate([np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))], axis=1)
        projected = (unit @ self.axes).astype("float32").T
        self.order = np.argsort(projected, axis=1, kind="stable").astype("int32")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        m, p = len(self.sorted), _collision_chance(dim)
        self.threshold = m * p - BELOW * np.sqrt(m * p * (1 - p))
        self.width = 1 / np.sqrt(dim)
        self.sample = unit[np.linspace(0, len(ids) - 1, min(SAMPLE, len(ids))).astype("int64")]
        self.verified = 0

    def _levels(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Radii of each query's levels, and the bounds of their windows on every axis (query, level, axis)."""
        far = np.sqrt(np.maximum(0, 2 - 2 * (queries @ self.sample.T)))
        first = FIRST * np.where(far > 1e-6, far, 2.0).min(axis=1)
        radii = [f * GROWTH ** np.arange(int(np.ceil(np.log(2.001 / f) / np.log(GROWTH))) + 1) for f in first]
        most = max(map(len, radii))
        reach = np.stack([np.pad(x, (0, most - len(x)), mode="edge") for x in radii]) * self.width
        centres = (queries @ self.axes).astype("float32")
        low, high = (np.empty((len(queries), most, len(self.sorted)), "int32") for _ in range(2))
        for i, s in enumerate(self.sorted):
            low[:, :, i] = np.searchsorted(s, centres[:, i, None] - reach, "left")
            high[:, :, i] = np.searchsorted(s, centres[:, i, None] + reach, "right")
        return radii, low, high

    def search(self, query_ids: list[int], queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        queries = _scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        radii, low, high = self._levels(queries / norms[:, None])
        out = []
        for q, own in enumerate(query_ids):
            counts, open_ = np.zeros(len(self.ids), "int64"), self.ids != own
            best = np.zeros(0, "int64")
            scores = np.zeros(0)

            def verify(rows: np.ndarray) -> None:
                nonlocal best, scores
                open_[rows] = False
                self.verified += len(rows)
                best = np.concatenate([best, rows])
                scores = np.concatenate([scores, (self.vectors[rows] * queries[q]).sum(axis=1) / (self.norms[rows] * norms[q])])
                top = np.lexsort((self.ids[best], -scores))[:k]
                best, scores = best[top], scores[top]

            for level, radius in enumerate(radii[q]):
                a, b = low[q, level], high[q, level]
                if level:
                    was_a, was_b = low[q, level - 1], high[q, level - 1]
                    new = [self.order[i, a[i] : was_a[i]] for i in np.flatnonzero(a < was_a)] + [self.order[i, was_b[i] : b[i]] for i in np.flatnonzero(b > was_b)]
                else:
                    new = [self.order[i, a[i] : b[i]] for i in np.flatnonzero(b > a)]
                if new:
                    counts += np.bincount(np.concatenate(new), minlength=len(counts))
                    found = np.flatnonzero((counts >= self.threshold) & open_)
                    if len(found):
                        verify(found)
                if len(best) >= k and np.sqrt(max(0.0, 2 - 2 * scores[-1])) <= radius:
                    break
            if len(best) < k:  # the shard has fewer near vectors than asked for: its others count as well
                verify(np.flatnonzero(open_))
            out += [(own, int(self.ids[t]), float(s)) for t, s in zip(best, scores)]
        return out


def nearest(vectors: DataFrame, query_condition: str, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each usable row of ``vectors`` (``vec_id, embedding``) that meets ``query_condition`` (over ``id``) its ``k``
    nearest other rows by cosine, ties to the smaller id; all others of its dimension if they are fewer.

    Rows are dealt evenly by a hash of the id into shards, whose index is built once per span of queries that stream past it; a shard gives each query
    ``k`` rows at most. Null, zero and non-finite vectors take no part; vectors of another dimension aren't compared; an empty table gives no rows.
    """
    d = usable(vectors).withColumn("label", F.lit(0).cast("long"))
    parts, queries, shards, spans = sharded(d, query_condition, SHARD_ROWS, SPAN, "nearest")

    def best(index: CollisionIndex, rows: list[tuple]) -> list[tuple]:
        return index.search([r[0] for r in rows], np.stack([r[2] for r in rows]), k)

    found = visits(parts, queries.withColumn("more", F.lit(None).cast("binary")), shards, spans, FOUND, CollisionIndex, best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
