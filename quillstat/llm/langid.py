"""Language identification by blended-spectrum string kernels on Nyström landmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import documents
from quillstat.llm.linededup import slices, text_bytes

ORDERS = (2, 3, 4)
SLOT_BITS = 20
#: Bounds of the fit: rows per language, characters of a row, landmarks (at least, and per language). Every language is learned; from ``LANGUAGES`` on
#: each has fewer rows, ``LEAST_ROWS`` at least.
SAMPLE_ROWS, SAMPLE_CHARS, LANDMARKS, LANDMARKS_EACH = 400, 20_000, 128, 2
LANGUAGES, LEAST_ROWS = 64, 16
#: Cells of the dense table of texts and features that is held at once.
KERNEL_CELLS = 1 << 25
RIDGE, JITTER, SHARPNESS = 1e-3, 1e-6, 4.0

_FOLD = np.arange(256, dtype="uint8")
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def gram_slots(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the text number and the hashed slot of every byte n-gram inside a text."""
    data, bounds = text_bytes(texts)
    folded = _FOLD[data].astype("uint32")
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    code = folded
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        code = (code[: len(data) - n + 1] << np.uint32(8)) | folded[n - 1 :]
        if n in ORDERS:
            inside = left[: len(code)] >= n
            slot = ((code[inside] + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - SLOT_BITS)
            yield row[: len(code)][inside], slot


class KernelModel:
    """One-versus-rest kernel ridge regression; ``k(x, y)`` is the cosine of the sets of n-grams that also occur in several landmarks."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS):
        self.names = sorted(set(languages))
        landmarks = max(landmarks, LANDMARKS_EACH * len(self.names))
        number = {x: c for c, x in enumerate(self.names)}
        target = np.array([number[x] for x in languages])
        array = pa.array(texts, pa.string())
        turn = np.empty(len(texts), "int64")  # landmarks take the languages in turn
        for c in range(len(self.names)):
            own = np.flatnonzero(target == c)
            turn[own] = np.arange(len(own))
        chosen = np.lexsort((target, turn))[:landmarks]
        slots = [np.unique(np.concatenate([s for _, s in gram_slots(array.slice(int(i), 1))] or [np.zeros(0, "uint32")])) for i in chosen]
        found, held = np.unique(np.concatenate(slots), return_counts=True)
        if (held > 1).any():
            found = found[held > 1]
        self.feature = np.full(1 << SLOT_BITS, -1, "int32")
        self.feature[found] = np.arange(len(found))
        self.landmarks = np.zeros((len(found), len(chosen)), "float32")
        for j, s in enumerate(slots):
            f = self.feature[s]
            self.landmarks[f[f >= 0], j] = 1
        self.landmarks /= np.sqrt(np.maximum(1, self.landmarks.sum(axis=0)))
        between = self.landmarks.T.astype("float64") @ self.landmarks
        values, vectors = np.linalg.eigh(between)
        root = vectors / np.sqrt(np.maximum(values, JITTER))  # the Nyström map is kernel row x root
        mapped = np.concatenate([self.kernel(array.slice(i, 64)) for i in range(0, len(texts), 64)]).astype("float64") @ root
        signs = np.where(target[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        weights = np.linalg.solve(mapped.T @ mapped + RIDGE * len(texts) * np.eye(mapped.shape[1]), mapped.T @ signs)
        self.scorer = (root @ weights).astype("float32")

    def kernel(self, texts: pa.Array) -> np.ndarray:
        """Kernel values of each text with each landmark."""
        step = max(1, KERNEL_CELLS // max(1, self.landmarks.shape[0]))
        if len(texts) > step:
            return np.concatenate([self.kernel(texts.slice(i, step)) for i in range(0, len(texts), step)])
        present = np.zeros((len(texts), self.landmarks.shape[0]), "float32")
        for row, slot in gram_slots(texts):
            f = self.feature[slot]
            known = f >= 0
            present[row[known], f[known]] = 1
        return (present @ self.landmarks) / np.sqrt(np.maximum(1, present.sum(axis=1)))[:, None]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language and a score from 0 to 1 (softmax over the regressions)."""
        s = SHARPNESS * (self.kernel(texts) @ self.scorer).astype("float64")
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def fit(labelled: DataFrame) -> KernelModel | None:
    """Fit on a bounded sample of ``doc_id, text, lang``: for each language the rows with a letter that come first in a hashed order, those of at most
    ``SAMPLE_CHARS`` characters before longer ones, of which that many characters from the first letter on count. Ties go by doc_id, then text.

    The rows of every language are counted first; only those whose hash is below four times the share that is needed are ranked, so what one task ranks
    doesn't grow with the corpus.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "lang", "text", (F.length("text") > SAMPLE_CHARS).alias("long"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("place"))
    sizes = rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n_short"), F.count_if("long").alias("n_long"))
    languages = sizes.count()
    if not languages:
        return None
    most = max(LEAST_ROWS, min(SAMPLE_ROWS, SAMPLE_ROWS * LANGUAGES // languages))
    below = lambda n: F.col("place") * F.col(n) < 4 * most * (1 << 32)
    few = rows.join(sizes, "lang").where(F.when(F.col("long"), (F.col("n_short") < most) & below("n_long")).otherwise(below("n_short")))
    start = F.when(F.col("long"), F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{SAMPLE_CHARS - 1}}}", 0)).otherwise(F.col("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("long", "place", "doc_id", "text"))
    sample = few.withColumn("text", start).withColumn("order", order).where(F.col("order") <= most).orderBy("lang", "order").collect()
    return KernelModel([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; a text that is null or has no letter is ``und`` with score 0, as is every text without a model.

    Texts of any length are scored whole, in batches of bounded size; equal scores go to the language first in order. Repeated rows each get a row; an
    empty table gives none.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    d = documents(docs, "text").select("doc_id", "text", letters.alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                names, scores = [], []
                for at in range(0, part.num_rows, 256):
                    best, score = model.predict(part.column(1).slice(at, 256))
                    names += [model.names[b] for b in best]
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(np.concatenate(scores)), part.column(2)], ["doc_id", "lang_pred", "score", "letters"])

    if model is None:
        return d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = d.mapInArrow(run, "doc_id long, lang_pred string, score double, letters boolean")
    return found.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
