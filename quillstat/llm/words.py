"""Word hashes, shingle sets and signatures of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits of the input reach all bits of the output."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (parted by ASCII white space) and the bounds of each text; a null text has none."""
    texts = pc.fill_null(texts, "")
    for space in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, space, " ")
    cut = pc.split_pattern(texts, " ")
    bounds = np.asarray(cut.offsets.to_numpy(), dtype="int64")
    bounds = bounds - bounds[0]
    flat = cut.flatten().dictionary_encode()
    values = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in values), "uint64", len(values))
    index = flat.indices.to_numpy()
    out = hashes[index] if len(values) else np.zeros(0, "uint64")
    if "" in values:  # white space at an end or in a row leaves empty words
        real = index != values.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        out = out[real]
    return out, bounds


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in lower case (A-Z); a text of fewer words is one shingle, without words it has none."""
    words, bounds = word_hashes(pc.ascii_lower(texts))
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _STEP + words[k : len(words) - size + 1 + k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = whole * _STEP + w
            out.append(mix(np.array([whole], "uint64")))
        else:
            out.append(np.zeros(0, "uint64"))
    return out


class Signer:
    """b-bit minwise signatures: ``positions`` values of 16 bits."""

    def __init__(self, positions: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.factor = r.integers(1, 2**63, positions, dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.flip = r.integers(0, 2**63, positions, dtype="uint64")

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 16-bit values per non-empty set."""
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), len(self.factor)), "uint16")
        for p, (f, x) in enumerate(zip(self.factor, self.flip)):
            v = (flat ^ x) * f
            v ^= v >> np.uint64(32)
            out[:, p] = (mix(np.minimum.reduceat(v * _M1, starts)) & np.uint64(0xFFFF)).astype("uint16")
        return out
