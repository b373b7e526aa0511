"""Word windows that repeat, by backward search in compressed FM-indexes.

Contexts of equal anchors (see repeats) meet in a shard, some megabytes of distinct contexts. The words of a shard's contexts are one sequence, of which the index holds the
Burrows-Wheeler transform in a wavelet matrix of packed bits with counts for each 64 of them. The contexts are streamed against it: from an end the search goes back word by
word, which gives the matching statistic of that end, the longest match that occurs twice; a context that is there twice counts so. Matches of a window or more are
intervals of repeated windows; where a match ends, the next search begins left of what is settled.

Null texts have no words; texts of fewer words than a window keep all. Rows that repeat, or differ only in white space, are copies, all of which lose what they share.
A null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import SPACE_CLASS, spread_join, texts
from convolake.llm.repeats import Kind, repeated
from convolake.llm.shingles import shingle_numbers, word_numbers
from convolake.llm.suffix_dedup import all_or_told


class Bits:
    """Packed bits with counts before each 64."""

    def __init__(self, flags: np.ndarray):
        raw = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class Index:
    """FM-index of a sequence of numbers from 0 on."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        self.order = order = suffixes(sequence, depth)
        moved = sequence[order - 1]
        self.levels = max(1, int(sequence.max()).bit_length()) if n else 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=1 << self.levels))]).astype(np.int64)
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            flags = (moved >> level & 1).astype(bool)
            self.bits.append(Bits(flags))
            self.zeros.append(int(n - flags.sum()))
            moved = np.concatenate([moved[~flags], moved[flags]])
        self.base = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the matches after one more symbol on their left."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high])).reshape(2, -1)
        first = self.start[symbol] - self.base[symbol]
        return first + both[0], first + both[1]


def suffixes(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by what follows them, as far as depth symbols: the ranks of some stretches that follow one another make the rank of a longer one."""
    n, rank, h = len(sequence), sequence.astype(np.int64), 1
    while True:
        bits = int(rank.max(initial=0) + 1).bit_length()
        key = np.zeros(n, np.int64)
        for k in range(max(2, 62 // bits)):
            later = rank[k * h :] + 1  # 0 is the end
            key <<= bits
            key[: len(later)] |= later
        h *= max(2, 62 // bits)
        order = np.argsort(key)
        if h >= depth or n == 0:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        if rank[order[-1]] == n - 1:
            return order


def statistics(index: Index, sequence: np.ndarray, begins: np.ndarray, ends: np.ndarray, times: np.ndarray, window: int, short: int = 8) -> np.ndarray:
    """The places of sequence at which a window starts that occurs twice, of the stretches from begins to ends, all of which are streamed against the index at once.

    times: how often each place counts. From the end of a stretch the search goes back as long as what it has read occurs twice, which may cover many windows. Where it stops, no window
    that holds the place and all read so far occurs twice; a short search about the place then tells whether that is so of any window that holds it, and the next search begins
    left of all windows that are settled.
    """
    weight = np.concatenate([[0], np.cumsum(times[index.order])])
    change = np.zeros(len(sequence) + 1, np.int64)
    live = np.flatnonzero(ends - begins >= window)
    begin, end = begins[live], ends[live]
    at, low, high = end - 1, np.zeros(len(live), np.int64), np.full(len(live), len(sequence))
    after = np.full(len(live), -1)  # of a short search: where the next one ends if it comes through
    while len(begin):
        low, high = index.back(sequence[at], low, high)
        twice = weight[high] - weight[low] > 1
        at = at - twice
        probe = after >= 0
        over = np.flatnonzero(~twice | (at < begin) | probe & (end - at > short))
        if not len(over):
            continue
        found = over[~probe[over]]
        some = found[end[found] - at[found] > window]
        np.add.at(change, at[some] + 1, 1)
        np.add.at(change, end[some] - window + 1, -1)
        stop, last = at[over], end[over]
        right = np.minimum(stop, last - window - 1) + window  # windows up to here are open
        right = np.where(probe[over], np.where(twice[over], after[over], last - 1), right)
        test = ~probe[over] & (stop + short < right)
        after[over] = np.where(test, right, -1)
        end[over] = np.where(test, stop + short, right)
        at[over], low[over], high[over] = end[over] - 1, 0, len(sequence)
        gone = over[np.where(test, right, end[over]) - begin[over] < window]
        if len(gone):
            stay = np.ones(len(begin), bool)
            stay[gone] = False
            begin, end, at, low, high, after = (x[stay] for x in (begin, end, at, low, high, after))
    return np.cumsum(change[:-1]) > 0


def engine_for(window: int):
    def engine(cuts: list[bytes], times: np.ndarray) -> list[np.ndarray]:
        """Of each context the places whose window repeats."""
        said = (b"  ".join(cuts) + b" ").split(b" ")  # an empty word parts the contexts
        number = dict.fromkeys(said)
        number |= zip(sorted(number), range(len(number)))
        sequence = np.fromiter(map(number.__getitem__, said), np.int64, len(said))
        ends = np.flatnonzero(sequence == 0)
        sizes = np.diff(ends, prepend=-1) - 1
        found = statistics(Index(sequence, 2 * window), sequence, ends - sizes, ends, np.repeat(times, sizes + 1), window)
        return [found[e - s : e - window + 1] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]

    return engine


def _read(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b" ") if text else []


def remove_repeated_words(docs: DataFrame, window: int = 35, q: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, after removing each word of a window of so many words that also starts elsewhere."""

    def finish(text: str, covered: list[tuple[int, int]]) -> tuple[int, str]:
        words, kept, at = _read(text), [], 0
        for a, b in covered:
            kept += words[at:a]
            at = b
        return sum(b - a for a, b in covered), hashlib.sha256(b" ".join(kept + words[at:])).hexdigest()

    rows = texts(docs, id_col, text_col).select("doc_id", F.btrim(F.regexp_replace("text", SPACE_CLASS + "+", " ")).alias("text"))
    kind = Kind(window, min(q, window), _read, lambda units: shingle_numbers(word_numbers(units), min(q, window)), lambda units, a, b: b" ".join(units[a:b]), engine_for(window), 4_000_000)
    owners, told = repeated(rows, kind, finish, "n_removed long, kept_sha256 string")
    return all_or_told(spread_join(owners, told, "sha", "copies", owners.count()), window, "n_words", [])
