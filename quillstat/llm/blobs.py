"""Columns packed into one binary value per batch and shard, for work that numpy does on whole shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

Columns = dict[str, np.ndarray]


def pack(columns: Columns, layout: list, extra: bytes = b"") -> bytes:
    """Columns by byte planes, then compressed: the high bytes of numbers are alike."""
    n = len(columns[layout[0][0]])
    planes = [np.ascontiguousarray(columns[c].astype(t).view("uint8").reshape(n, -1)[:, :width].T).tobytes() for c, t, width in layout]
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(planes) + extra, 1)


def unpack(blob: bytes, layout: list) -> tuple[Columns, bytes]:
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
    for c, t, width in layout:
        whole = np.zeros((n, np.dtype(t).itemsize), "uint8")
        whole[:, :width] = np.frombuffer(raw, "uint8", n * width, at).reshape(width, n).T
        out[c] = whole.view(t).ravel()
        at += n * width
    return out, raw[at:]


def joined(parts: list[Columns], layout: list) -> Columns:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t, _ in layout}


def taken(columns: Columns, rows: np.ndarray) -> Columns:
    return {c: v[rows] for c, v in columns.items()}


def dealt(columns: Columns, shard: np.ndarray, layout: list, kind: int, shards: int, text: np.ndarray | None = None, offsets: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """``(shard, kind, blob)`` of rows by their shard; with ``text`` the bytes at ``offsets`` of each row go along."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    out = []
    for s in np.flatnonzero(np.diff(cut)):
        o = order[cut[s] : cut[s + 1]]
        extra = ragged(text, offsets[o], columns["length"][o].astype("int64")).tobytes() if text is not None else b""
        out.append((int(s), kind, pack(taken(columns, o), layout, extra)))
    return out


def ragged(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``data[start : start + length]`` of all rows in a row."""
    at = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))]


def blob_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    s, k, b = zip(*rows) if rows else ((), (), ())
    return pa.table({"shard": pa.array(s, pa.int64()), "kind": pa.array(k, pa.int32()), "packed": pa.array(b, pa.binary())})


BLOBS = "shard long, kind int, packed binary"
