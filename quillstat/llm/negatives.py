"""Hard negatives by exact search in inverted multi-indexes."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import written
from quillstat.llm.shards import sharded, visits

#: Rows of an index, centres of each of its two codebooks, rounds of fitting them, rows scored at a time, anchors that pass an index in one task.
SHARD_ROWS, CENTRES, ROUNDS, STEP, SPAN = 8192, 16, 6, 512, 32768
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``id, label, dim, vector``: rows that have an id, a label and finite components only, each component x as floor(256 x); of rows with the same id the
    one with the smallest label, then vector."""
    d = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    sound = "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    d = d.where(F.coalesce(F.expr(sound), F.lit(False))).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")
    # A scaled component may leave the range of doubles; such a value is as large as a double can be.
    whole = F.expr("transform(vector, x -> greatest(least(double(256) * x, double('1.7976931348623157E308')), double('-1.7976931348623157E308')))")
    return d.select("id", "label", F.size("vector").alias("dim"), whole.alias("vector"))


def _fit(half: np.ndarray) -> np.ndarray:
    """Centres of one half space: rounds of nearest centre and mean, from evenly spaced rows in the order of their projection on the widest axis."""
    if not half.shape[1]:
        return np.zeros((1, 0))
    order = np.argsort(half[:, int(np.argmax(half.var(axis=0)))], kind="stable")
    centres = half[order[np.linspace(0, len(half) - 1, min(CENTRES, len(half))).astype("int64")]].astype("float64")
    for _ in range(ROUNDS):
        near = _nearest(half, centres)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = half[near == c].mean(axis=0)
    return centres


def _nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (half @ centres.T), axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """The ``k`` highest scores as ``(-score, id)``, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:  # all that reach the k-th highest
        keep = np.flatnonzero(scores >= (np.partition(scores, len(scores) - k)[len(scores) - k]))
        scores, ids = scores[keep], ids[keep]
    return heapq.nsmallest(k, zip((-scores).tolist(), ids.tolist()))


class MultiIndex:
    """Rows of one shard in the cells of two half-space codebooks.

    A row's inner product with a query is at most the sum of the halves' bounds of its cell: the centre's product and the length of the query's half times
    the radius around the centre. A heap visits the cells from the highest sum down; a search ends when the next sum is below all it may still need.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.half = vectors.shape[1] // 2
        halves = (vectors[:, : self.half], vectors[:, self.half :])
        with np.errstate(over="ignore", invalid="ignore"):
            lengths = np.sqrt(np.square(vectors).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0))
        scale = max(1.0, float(np.abs(vectors).max(initial=0.0)) / 2**40)  # keeps the squares of very large values finite
        fitted = [_fit(h / scale) for h in halves]
        near = [_nearest(h / scale, c) for h, c in zip(halves, fitted)]
        self.centres = [c * scale for c in fitted]
        self.radii = []
        for h, c, n in zip(halves, fitted, near):
            far = np.sqrt(np.square(h / scale - c[n]).sum(axis=1)) * scale
            r = np.full(len(c), -1.0)
            np.maximum.at(r, n, far)
            self.radii.append(r)
        cell = near[0] * len(fitted[1]) + near[1]
        order = np.lexsort((ids, labels, cell))
        self.ids, self.labels, self.vectors, self.cell = ids[order], labels[order], vectors[order], cell[order]
        self.names, coded = np.unique(self.labels, return_inverse=True)
        self.key = self.cell * (len(self.names) + 1) + coded
        self.visited = 0

    def spans(self, label: int) -> tuple[np.ndarray, ...]:
        """Of each cell: its start, where the label starts and ends, its end."""
        cells = np.arange(len(self.centres[0]) * len(self.centres[1])) * (len(self.names) + 1)
        k = int(np.searchsorted(self.names, label))
        known = k < len(self.names) and self.names[k] == label
        start, end = np.searchsorted(self.key, cells), np.searchsorted(self.key, cells + len(self.names))
        return start, np.searchsorted(self.key, cells + k), np.searchsorted(self.key, cells + k + known), end

    def cells(self, query: np.ndarray, exact: bool) -> Iterator[tuple[float, float, int]]:
        """``(upper bound, lower bound, cell)`` from the highest upper bound down, by the multi-sequence walk over both sorted lists of half bounds; all
        cells, without bounds, where doubles can't hold them."""
        if not exact:
            yield from ((np.inf, -np.inf, c) for c in range(len(self.centres[0]) * len(self.centres[1])))
            return
        upper, lower = [], []
        for q, c, r in zip((query[: self.half], query[self.half :]), self.centres, self.radii):
            size = float(np.sqrt(np.square(q).sum()))
            slack = 1e-9 * size * (float(np.abs(c).max(initial=0.0)) * max(1, len(q)) + float(r.max(initial=0.0))) + 1e-6
            middle = c @ q
            upper.append(np.where(r < 0, -np.inf, middle + size * r + slack))
            lower.append(middle - size * r - slack)
        a, b = (np.argsort(-u, kind="stable") for u in upper)
        width = len(self.centres[1])
        ua, ub, la, lb = upper[0][a].tolist(), upper[1][b].tolist(), lower[0][a].tolist(), lower[1][b].tolist()
        heap = [(-(ua[0] + ub[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:
                return
            yield -bound, la[i] + lb[j], int(a[i]) * width + int(b[j])
            if j + 1 < len(ub):
                heapq.heappush(heap, (-(ua[i] + ub[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(ua):
                heapq.heappush(heap, (-(ua[i + 1] + ub[0]), i + 1, 0))

    def scores(self, rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        self.visited += len(rows)
        if exact:
            return self.vectors[rows] @ query
        q = [int(x) for x in query]  # sums beyond the exact range of doubles
        return np.array([sum(int(x) * y for x, y in zip(v, q)) for v in self.vectors[rows]], dtype=object)

    def exact(self, query: np.ndarray) -> bool:
        """Whether all products and their sums with the query are exact in doubles."""
        with np.errstate(over="ignore"):
            return self.longest * float(np.sqrt(np.square(query).sum())) < 2**52

    def positives(self, anchor: int, label: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` highest ``(score, id)`` of other rows with the label."""
        _, first, last, _ = self.spans(label)
        if not (last > first).any():
            return []
        exact, best, ranges, held = self.exact(query), [], [], 0

        def score() -> None:
            nonlocal best, held
            rows = np.concatenate(ranges)
            rows = rows[self.ids[rows] != anchor]
            best = heapq.nsmallest(k, best + _best(self.scores(rows, query, exact), self.ids[rows], k)) if len(rows) else best
            ranges.clear()
            held = 0

        for bound, _, cell in self.cells(query, exact):
            if len(best) == k and bound < -best[-1][0]:
                break
            if last[cell] > first[cell]:
                ranges.append(np.arange(first[cell], last[cell]))
                held += last[cell] - first[cell]
                if held >= (STEP if len(best) == k else 8 * k):
                    score()
        if ranges:
            score()
        return [(int(-s), i) for s, i in best]

    def negatives(self, label: int, query: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores (both ends included) its ``k`` highest ``(score, id)`` of rows with another label."""
        start, first, last, end = self.spans(label)
        exact, best = self.exact(query), [[] for _ in windows]
        ranges, held = [], 0

        def floor(w: int) -> float:
            """Below this no score matters to the window any more."""
            return max(windows[w][0], -best[w][-1][0]) if len(best[w]) == k else windows[w][0]

        def score() -> None:
            nonlocal held
            rows = np.concatenate(ranges)
            s = self.scores(rows, query, exact)
            for w, (_, high) in enumerate(windows):
                fit = np.flatnonzero((s <= high) & (s >= floor(w)))
                if len(fit):
                    best[w] = heapq.nsmallest(k, best[w] + _best(s[fit], self.ids[rows[fit]], k))
            ranges.clear()
            held = 0

        for bound, low, cell in self.cells(query, exact):
            live = [w for w, (a, b) in enumerate(windows) if a <= b and bound >= floor(w)]
            if not live:
                break
            if low > max(windows[w][1] for w in live):
                continue  # all rows of the cell lie above the windows
            for a, b in ((start[cell], first[cell]), (last[cell], end[cell])):
                if b > a:
                    ranges.append(np.arange(a, b))
                    held += b - a
            if held >= STEP:
                score()
        if ranges:
            score()
        return [[(int(-s), i) for s, i in b] for b in best]


def hard_negatives(vectors: DataFrame, anchor_condition: str, label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each usable row of ``vectors`` (``vec_id, embedding, label``) that meets
    ``anchor_condition`` and each of its ``positives`` nearest other rows of the same label the ``negatives`` nearest rows of other labels whose score lies
    between ``low`` and ``high`` percent of the positive's. A score is the inner product of the vectors of floor(256 x), exact; ties go to the smaller id.

    ``anchor_condition`` and ``label`` are SQL over ``id`` and ``label`` of the usable rows (see ``usable``: rows with a null id, label, vector or component or
    one that isn't finite take no part, repeated ids are one row). Vectors of another dimension aren't compared. Anchors without a positive, and positives
    without a negative in their window, give no rows; an empty table gives none. Scores beyond the range of a long are ordered exactly and returned as its end.

    Rows are dealt by a hash of the id to shards of about ``SHARD_ROWS`` with an inverted multi-index each, so neither a label nor equal vectors make a hot
    group. Anchors stream past every shard twice: for their positives, then, with the windows known, for the negatives.
    """
    d = usable(vectors).withColumn("label", F.expr(label))
    parts, anchors, shards, spans = sharded(d, anchor_condition, SHARD_ROWS, SPAN, "negatives", np.floor)

    def best_positives(index: MultiIndex, rows: list[tuple]) -> list[tuple]:
        return [(a, p, s) for a, own, query, _ in rows for s, p in index.positives(a, own, query, positives)]

    found = visits(parts, anchors.withColumn("more", F.lit(None).cast("binary")), shards, spans, POSITIVES, MultiIndex, best_positives)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = found.withColumn("rank", rank).where(F.col("rank") <= positives)
    chosen = chosen.groupBy("anchor_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score")))).cast("binary").alias("more"))
    ready = written(anchors.join(chosen.withColumnRenamed("anchor_id", "id"), "id"), "negatives-positives")

    def best_negatives(index: MultiIndex, rows: list[tuple]) -> list[tuple]:
        out = []
        for anchor, own, query, more in rows:
            mine = [(x["positive_id"], x["positive_score"]) for x in json.loads(more)]
            windows = [(-(-low * s // 100), high * s // 100) for _, s in mine]  # whole scores within the shares
            out += [(anchor, p, s, i, t) for (p, s), hits in zip(mine, index.negatives(own, query, windows, negatives)) for t, i in hits]
        return out

    found = visits(parts, ready, shards, spans, NEGATIVES, MultiIndex, best_negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
