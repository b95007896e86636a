"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import documents, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts with one cached encoding per distinct word.

    The byte-level pre-tokenizer always starts a token at a single space, and around a single line break, between two other
    characters. Texts are cut there, and each distinct word is encoded once; a text with any other white space beside a
    space or line break is encoded whole, and so is one that holds the string of a special token, which has its own id
    unless ``plain_specials``.
    """

    CACHE = 250_000  # words in each half of a worker's cache; memory, not results, depends on it

    def __init__(self, path: str, plain_specials: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_break = self._whole(["\n"])[0]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode words without line breaks, many at a time with a line break after each."""
        mark = int(np.frombuffer(self.line_break, "<u4")[0])
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            ids = np.frombuffer(self._whole(["\n".join(part)])[0], "<u4")
            ends = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
            start = 0
            for word, end in zip(part, ends, strict=True):
                self.known[word] = ids[start:end].tobytes()
                start = end + 1

    def _words(self, words: list[str]) -> list[bytes]:
        """Encodings of words that neither start with white space (but for one space) nor end with it."""
        if len(self.known) > self.CACHE:  # words not met since the last turnover are forgotten
            self.older, self.known = self.known, {}
        known = self.known
        known.update((w, self.older[w]) for w in words if w not in known and w in self.older)
        broken = [w for w in words if w not in known and "\n" in w]
        lines = {x for w in broken for x in w.split("\n")}
        plain = {w for w in words if w not in known and "\n" not in w} | {x for x in lines if x and not x[-1].isspace() and not x.lstrip(" ")[:1].isspace() and x not in known}
        self._learn(list(plain))
        for w in broken:
            rows = w.split("\n")
            if all(x in known for x in rows) and not any(x[0].isspace() for x in rows[1:]):
                known[w] = self.line_break.join([known[x] for x in rows])
            else:
                known[w] = self._whole([w])[0]
        return [known[w] for w in words]

    def encode(self, texts: pa.Array, lead: str = "") -> list[bytes]:
        """Little-endian 32-bit ids of each text, after ``lead`` (nothing or one space); a null is an empty text."""
        cut = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), " ")
        bounds = cut.offsets.to_numpy()
        flat = cut.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in words), bool, len(words))
        index = flat.indices.to_numpy()
        bounds = bounds - bounds[0]
        ends = np.concatenate([[0], np.cumsum(odd[index])])
        whole = (ends[bounds[1:]] - ends[bounds[:-1]]) > 0
        for special in self.specials:
            whole |= pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)
        encoded = np.empty(len(words), dtype=object)
        encoded[~odd] = self._words([" " + w for w, o in zip(words, odd) if not o])
        firsts = np.unique(index[bounds[:-1][~whole]]).tolist()
        at_start = dict(zip(firsts, self._words([lead + words[i] for i in firsts])))
        out: list[bytes] = []
        rest = iter(self._whole([lead + (texts[int(i)].as_py() or "") for i in np.flatnonzero(whole)]))
        for k in range(len(whole)):
            if whole[k]:
                out.append(next(rest))
            else:
                a, b = bounds[k], bounds[k + 1]
                out.append(at_start[int(index[a])] + b"".join(encoded[index[a + 1 : b]]))
        return out


def vocabulary() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    key = (path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, plain_specials)
    return _ENCODERS[key]


def token_pieces(docs: DataFrame, vocabulary: str, max_tokens: int, separator: int, with_ids: bool) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids; the first piece of a longer document is the shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.asarray([separator], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows: list[list] = [[] for _ in range(6)]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1))):
                    ids += end
                    n, start = len(ids) // 4, 0
                    length, piece = n % max_tokens or max_tokens, 0
                    while start < n:
                        body = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(rows, (doc, piece, start, length, zlib.crc32(body), body if with_ids else None)):
                            column.append(value)
                        start, piece, length = start + length, piece + 1, max_tokens
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return documents(docs, "text").select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], room: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length in order. Bit ``f`` of the bitset says that an open bin has ``f`` free places; at most
    ``open_bins`` bins stay open, and the fullest one closes first."""
    bits, count, opened = 0, 0, 0
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets = [], []
    for n in lengths:
        fitting = bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
            count -= 1
        else:
            free, b, opened = room, opened, opened + 1
        bins.append(b)
        offsets.append(room - free)
        left = free - n
        if left:
            if count == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                count -= 1
            by_free[left].append(b)
            bits |= 1 << left
            count += 1
    return bins, offsets


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, separator: int = 0, open_bins: int = 4096, group_rows: int = 8192, with_ids: bool = True) -> DataFrame:
    """Place every document's tokens in sequences of at most ``max_tokens``: one row per piece with its sequence and offset.

    Full pieces are sequences of their own. The others are dealt evenly into groups of about ``group_rows`` by a hash of the row
    and its place in the written table, so equal rows spread as well, and packed there longest first, so groups grow in number with the input, not in size. Every row of ``docs`` is packed, repeated
    ones as often as they occur; a null text is empty and gives the separator alone; an empty table gives no rows.
    ``ids`` holds the piece's little-endian 32-bit ids (null without ``with_ids``).
    """
    pieces = written(token_pieces(docs, vocabulary, max_tokens, separator, with_ids), "pieces")
    short = pieces.where(F.col("length") < max_tokens)
    groups = max(1, -(-short.count() // group_rows))

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(rows["length"].tolist(), max_tokens, open_bins)
        return rows.assign(sequence_id=2 * ((key[0] << 32) + np.asarray(bins, dtype="int64")), offset=offsets).drop(columns="part")

    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    packed = short.withColumn("part", part).groupBy("part").applyInPandas(pack, PLACED)
    full = pieces.where(F.col("length") == max_tokens)
    full = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
