"""Word shingles as 64-bit numbers, computed for whole texts at once."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

#: Multipliers of the words of a shingle and of the final mixing; any odd numbers do.
_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words(text: str) -> list[bytes]:
    """Runs of characters other than space and the bytes 9 to 13, in UTF-8."""
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode("utf-8", "surrogatepass")) if w]


def word_numbers(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_numbers(numbers: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of size words, in order."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += mix(numbers[k : k + n] * _ODD[k])
    return mix(total)


def shingle_set(numbers: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text of fewer words has one of all its words, one without words none."""
    return np.unique(shingle_numbers(numbers, min(size, len(numbers)))) if len(numbers) else np.empty(0, np.uint64)
