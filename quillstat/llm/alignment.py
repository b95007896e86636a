"""Alignment of two tokenizers over the same bytes, with counts of linked ids over the whole corpus."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm import packing
from quillstat.llm.blobs import ragged
from quillstat.llm.common import documents, written

#: Bytes of text that are aligned at once, and that share a table of their linked pairs; rows of that table in one row.
SLICE_BYTES, BUNDLE_BYTES, PAIR_ROWS = 1 << 20, 8 << 20, 1 << 16

BUNDLES = (
    "bundle long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def vocabularies() -> tuple[str, str]:
    """Places of the two public vocabularies: byte-level and pieces."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    """Bytes and decimal digits of every id."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.fromiter(map(len, tokens), "int64", len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), "uint8")
        width = len(str(len(tokens) - 1))
        self.digits = np.zeros((len(tokens), width), "uint8")
        for i in range(len(tokens)):
            name = str(i).encode()
            self.digits[i, : len(name)] = np.frombuffer(name, "uint8")

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids])


def _byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers of a worker and the alignment of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = packing.encoder(path_a, plain_specials=True)
        of = _byte_characters()
        entries = [(i, t) for t, i in self.encoder.tokenizer.get_vocab(with_added_tokens=True).items()]
        bytes_a = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for i, t in entries}
        self.a = Vocabulary([bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)])
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)])

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their number in each text, the same of B, and the length in bytes of each text with its leading space (0: without tokens)."""
        a = self.encoder.encode(texts, lead=" ")
        values = [t or "" for t in texts.to_pylist()]
        b = self.pieces.encode(values, num_threads=1)
        raw = [b" " + v.encode() if v else b"" for v in values]
        n_a = np.fromiter((len(x) // 4 for x in a), "int64", len(a))
        n_b = np.fromiter(map(len, b), "int64", len(b))
        ids_a = np.frombuffer(b"".join(a), "<u4").astype("int64")
        ids_b = np.fromiter(itertools.chain.from_iterable(b), "int64", int(n_b.sum()))
        length = np.fromiter(map(len, raw), "int64", len(raw))
        sound = length > 0
        for vocabulary, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            ends = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])[np.cumsum(n)]
            bounds = np.concatenate([[0], ends]).tolist()
            data = vocabulary.joined(ids).tobytes()
            sound &= np.fromiter((data[x:y] == r for x, y, r in zip(bounds[:-1], bounds[1:], raw)), bool, len(raw))
        ids_a, ids_b = ids_a[np.repeat(sound, n_a)], ids_b[np.repeat(sound, n_b)]
        return ids_a, n_a * sound, ids_b, n_b * sound, length * sound

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Per text the tokens of A and B, the groups and their digest; and ``a * size of B + b`` of all links in order, one per group.

        Tokens of both sides are sorted by start and their ends accumulated; a group breaks where a start reaches the highest end so far. Both sides cover
        the same bytes, so two tokens end together exactly where a group ends, and the last of either side are its link.
        """
        ids_a, n_a, ids_b, n_b, length = self.tokens(texts)
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        starts = np.concatenate([ends_a - self.a.lengths[ids_a], ends_b - self.b.lengths[ids_b]])
        ends = np.concatenate([ends_a, ends_b])
        order = np.lexsort((starts,))
        reached = np.maximum.accumulate(ends[order])
        breaks = np.ones(len(order), bool)
        breaks[1:] = starts[order][1:] >= reached[:-1]
        group = np.empty(len(order), "int64")
        group[order] = np.cumsum(breaks) - 1
        of_a, of_b = group[: len(ids_a)], group[len(ids_a) :]
        last_a, last_b = (np.flatnonzero(np.diff(g, append=-1)) for g in (of_a, of_b))
        links = ids_a[last_a] * self.b.size + ids_b[last_b]
        # Places in the text of groups: a group's tokens of A come before its tokens of B.
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b[:-1] + 1])[of_a] if len(ids_a) else np.zeros(0, "int64")
        place_b = np.arange(len(ids_b)) + (last_a + 1)[of_b] if len(ids_b) else np.zeros(0, "int64")
        width = max(self.a.digits.shape[1], self.b.digits.shape[1])
        text = np.zeros((len(order), width + 1), "uint8")
        text[place_a, : self.a.digits.shape[1]] = self.a.digits[ids_a]
        text[place_b, : self.b.digits.shape[1]] = self.b.digits[ids_b]
        text[:, width] = ord(",")
        text[place_a[last_a], width] = ord("|")
        text[place_b[last_b], width] = ord(";")
        tokens = np.cumsum(n_a + n_b)
        text[tokens[n_a > 0] - 1, width] = 0
        flat = text.ravel()
        used = flat != 0
        bounds = [0, *np.concatenate([[0], np.cumsum(used.reshape(text.shape).sum(axis=1))])[tokens].tolist()]
        data = flat[used].tobytes()
        digests = [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:])]
        groups = np.concatenate([[0], np.searchsorted(np.cumsum(self.a.lengths[ids_a])[last_a], np.cumsum(length), side="right")])
        return n_a, n_b, np.diff(groups), digests, links


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two vocabulary files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """``[start, end)`` of runs of rows of at most ``most`` bytes, or of one row."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start = i
            held = 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def _bundle(number: int, rows: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of the documents of one bundle, then rows of its table of linked pairs; a document's links are places in that table."""
    each = np.concatenate(links) if links else np.zeros(0, "int64")
    pairs, place, counts = np.unique(each, return_inverse=True, return_counts=True)
    place, at, docs = place.astype("<u4"), 0, []
    for row in rows:
        docs.append((*row, place[at : at + row[4]].tobytes()))
        at += row[4]
    cuts = list(range(0, len(pairs), PAIR_ROWS))
    columns = [list(c) for c in zip(*docs)] if docs else [[] for _ in range(7)]
    types = [pa.int64()] * 5 + [pa.string(), pa.binary()]
    arrays = [pa.array([number] * (len(docs) + len(cuts)), pa.int64())] + [pa.array(c + [None] * len(cuts), t) for c, t in zip(columns, types)]
    arrays += [pa.array([None] * len(docs) + [v[c : c + PAIR_ROWS] for c in cuts], pa.list_(pa.int64())) for v in (pairs, counts)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BUNDLES.split(", ")])


def _aligned_bundles(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = aligner(path_a, path_b)
        number, held = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        links: list[np.ndarray] = []
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for start, end in _slices(sizes, SLICE_BYTES):
                part = batch.slice(start, end - start)
                n_a, n_b, groups, digests, found = both.align(part.column(1))
                rows += zip(part.column(0).to_pylist(), n_a.tolist(), n_b.tolist(), groups.tolist(), groups.tolist(), digests)
                links.append(found)
                held += sum(sizes[start:end])
                if held >= BUNDLE_BYTES:
                    yield _bundle(number, rows, links)
                    number, held, rows, links = number + 1, 0, [], []
        if rows:
            yield _bundle(number, rows, links)

    return documents(docs, "text").select("doc_id", "text").mapInArrow(run, BUNDLES)


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one bundle with the sums over their links."""
    order = np.argsort(pairs["pair"].to_numpy(), kind="stable")
    total, best = pairs["total"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order].astype("int64")
    places = [np.frombuffer(b, "<u4") for b in docs["links"].to_pylist()]
    sums = [(int(best[p].sum()), int(total[p].sum())) if len(p) else (0, 0) for p in places]
    kept = [docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    added = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
    return pa.Table.from_arrays([*kept, *added, docs["groups_sha256"]], [c.split()[0] for c in ALIGNED.split(", ")])


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs`` (``doc_id, text``).

    A space and the text are encoded by the byte-level vocabulary ``path_a``, the text by the piece vocabulary ``path_b``, which puts the space itself; strings of
    special tokens are plain text. A link is a pair of tokens whose bytes end together; its count is the number of links of the whole corpus with the same
    ids. A null or empty text, and one that either side doesn't give back byte by byte, has no tokens: zeros and the digest ''. Repeated rows are rows like any
    other, and their links count each; an empty table gives no rows; other columns are left aside.

    Texts of about ``BUNDLE_BYTES`` share a table of their distinct pairs, so a pair takes a row per bundle on its way through the shuffles, however often it
    occurs. A long text is aligned as a whole and is a bundle of its own.
    """
    aligned = written(_aligned_bundles(docs, path_a, path_b), "aligned")
    size = aligner(path_a, path_b).b.size
    rows = aligned.where("pairs IS NOT NULL").select("bundle", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    rows = rows.select("bundle", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = rows.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % size)
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    scores = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = rows.select(F.col("bundle").alias("of_bundle"), "pair").join(scores, "pair")
    members = aligned.where("pairs IS NULL").drop("pairs", "counts")
    return members.groupBy("bundle").cogroup(answers.groupBy("of_bundle")).applyInArrow(_scored, ALIGNED)
