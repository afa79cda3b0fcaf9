"""Shared pieces of the training-data operators: durable storage, size-checked joins, token hashing."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.sources.shared import BROADCAST_ROWS
from termloom.sources.shared import drop_table as dropped
from termloom.sources.shared import shared_path as shared_dir
from termloom.sources.shared import table as stored

__all__ = ["BROADCAST_ROWS", "WORD", "dropped", "free_name", "join_ids", "mix", "quoted", "shared_dir", "stored", "token_hashes"]

#: A word is a run of ASCII letters and digits and of characters from U+00C0 on, but for the signs and punctuation
#: blocks among these; case is ignored wherever words are compared. token_hashes() finds the same words.
WORD = re.compile("[0-9a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u1fff\u2070-\u2fff\u3040-\U0010ffff]+")


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join of df with a stored table of ids: broadcast after counting it, shuffled when it is larger."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids.hint("merge"), on, how)


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores when df already has such a column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
#: Bytes of words, before _inside() takes out those of the signs beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, n.bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64) for b in (_BASE, _BASE_INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _inside(buf: np.ndarray) -> np.ndarray:
    inside = _IN_WORD[buf]
    if buf.max() < 128:
        return inside
    a, b = buf[:-1], buf[1:]
    two = np.flatnonzero((a == 0xC2) | ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))))
    three = np.flatnonzero(((a == 0xE2) & (b == 0x80)) | ((a == 0xE3) & (b == 0x80)) | ((a == 0xE2) & (b == 0x81)))
    three = three[(buf[three + 1] != 0x81) | (buf[three + 2] < 0xB0)]
    for at, n in ((two, 2), (three, 3)):
        for j in range(n):
            inside[at + j] = False
    return inside


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, end to end, and the number of words of each text.

    Works on the bytes of all texts at once: a polynomial prefix sum gives any word's hash by one
    subtraction. Null and blank texts have no words.
    """
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    counts = np.zeros(len(parts), np.int64)
    out, at = [], 0
    while at < len(parts):  # bounded pieces of whole texts
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) < _CHUNK):
            size += len(parts[end]) + 1
            end += 1
        buf = np.frombuffer(b" ".join(parts[at:end]) + b" ", np.uint8)
        inside = _inside(buf)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            power, inverse = _powers(len(buf))
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
            out.append(mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64))
        stops = np.cumsum([len(p) + 1 for p in parts[at:end]])
        counts[at:end] = np.diff(np.concatenate(([0], np.searchsorted(starts, stops))))
        at = end
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts
