"""Words of whole texts as 64-bit hashes, for a batch at a time."""

from __future__ import annotations

import numpy as np

from textlake.llm.blocks import mix, worker_cache

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Bytes between words, after lower-casing A-Z: white space only, or all ASCII but letters and digits.
SEPARATORS = {"space": _SPACE, "punctuation": _PUNCTUATION}

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; the worker keeps them until it releases what it holds."""
    held = worker_cache.setdefault("powers", {})
    if base not in held or len(held[base]) < n:
        values = np.full(max(n, 1 << 20), base, np.uint64)
        values[0] = 1
        held[base] = np.cumprod(values, dtype=np.uint64)
    return held[base][:n]


def span_hash(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end); spans may overlap."""
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_BYTE[code] * powers(_STEP, len(code)), dtype=np.uint64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_BACK, len(code) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = LOWER[data] if lower else data
    gap = SEPARATORS[kind][code]
    edge = np.zeros(len(code) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(code), bool), np.ones(len(code), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return span_hash(code, starts, ends), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, n + 1 offsets of the words of each text)."""
    value, starts, _ = word_spans(data, offsets, kind)
    return value, np.searchsorted(starts, offsets)


def one_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hash(LOWER[raw], np.array([0]), np.array([len(raw)]))[0]


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, distinct and ascending: (hashes, n + 1 offsets).

    A text of fewer words gives its whole sequence as one; one without words gives none.
    """
    n, lengths = len(words), np.diff(at)
    factor = powers(0x2545F4914F6CDD1D, size + 1)
    total = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        total += words[k:n - size + 1 + k] * factor[k + 1]
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - size + 1, 0))
    first = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(lengths - size + 1, 0)) - np.maximum(lengths - size + 1, 0), np.maximum(lengths - size + 1, 0)) + at[:-1][doc]
    value = mix(total[first]) if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        extra = np.array([(words[at[i]:at[i + 1]] * factor[1:lengths[i] + 1]).sum(dtype=np.uint64) + np.uint64(lengths[i]) for i in short], np.uint64)
        value, doc = np.concatenate([value, mix(extra ^ np.uint64(0x5851F42D4C957F2D))]), np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(lengths) + 1))
