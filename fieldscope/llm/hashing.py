"""Hashed byte n-grams of whole texts, in pieces of bounded size."""

from __future__ import annotations

import numpy as np

from fieldscope.llm.common import LOWER, WORK_BYTES

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD6E8FEB9], dtype=np.uint32)
_STEPS = np.arange(1, 257, dtype=np.uint32)[None, :] * _FACTORS[:, None]


def fold_letters(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters in UTF-8; ASCII that is no letter becomes a space."""
    out = LOWER[data]
    out[(data < 128) & ~((out >= 97) & (out <= 122))] = 32
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[wide] += 32
    return out


def gram_codes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes from each place on; the last n - 1 places have none."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    code = _STEPS[0][data[:m]]
    for j in range(1, n):
        code += _STEPS[j][data[j : j + m]]
    code += np.uint32(n * int(_FACTORS[-1]) & 0xFFFFFFFF)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    code >>= np.uint32(32 - bits)
    return code


def pieces(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int):
    """(n, first row, row bounds, buckets): pieces of the buffer, for each n-gram size; no gram crosses a row's end."""
    reach = max(sizes)
    for begin in range(0, len(data), WORK_BYTES):
        end = min(begin + WORK_BYTES, len(data))
        lo, hi = int(np.searchsorted(offsets, begin, side="right")) - 1, int(np.searchsorted(offsets, end, side="left"))
        starts, stops = offsets[lo:hi], offsets[lo + 1 : hi + 1]
        part = data[begin : min(end + reach - 1, len(data))]
        for n in sizes:
            code = gram_codes(part, n, bits)[: end - begin]
            first = np.clip(starts - begin, 0, len(code))
            last = np.clip(np.minimum(stops - n + 1, end) - begin, first, len(code))
            yield n, lo, first, last, code


def gram_sums(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the sum of weights[bucket] over its grams (one column per column of weights), and the number of grams."""
    rows = len(offsets) - 1
    total, count = np.zeros((rows, weights.shape[1])), np.zeros(rows)
    for _, lo, first, last, code in pieces(data, offsets, sizes, bits):
        values = weights[code] if weights.shape[1] > 1 else weights[:, 0][code][:, None]
        for i, (s, e) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            if e > s:
                total[lo + i] += values[s:e].sum(axis=0)
        count[lo : lo + len(first)] += last - first
    return total, count


def gram_counts(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text's grams and how often each occurs; at most 2**bits of them."""
    dense = np.zeros(1 << bits, np.int64)
    for _, _, first, last, code in pieces(data, np.array([0, len(data)]), sizes, bits):
        dense += np.bincount(code[first[0] : last[0]], minlength=1 << bits)
    at = np.flatnonzero(dense)
    return at, dense[at]
