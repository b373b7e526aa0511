"""Token counts of a SentencePiece BPE model, by merging over a heap and a linked list.

Each distinct marked word is merged once in a task: the pair of adjacent symbols with the lowest rank is popped until none is left, and the number of tokens
is that of the initial symbols less that of the merges; no identifier is ever made. A character outside the vocabulary counts as its UTF-8 bytes.
Counts of words are kept in a table of bounded size.

Null and empty texts have no token. Rows that repeat stay rows of their own, in no order; a null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from convolake.llm.common import texts, without_collector
from convolake.llm.pieces import MARK, Pieces, chunks, marked_words, model_bytes


#: An entry of the heap is rank * places + place, which sorts by rank and then from the left; longer words have more places.
PLACES = 1 << 20
#: After the last symbol; no piece holds it.
END = "\0\0"


def merged_count(word: str, pieces: Pieces) -> int:
    """Tokens of one marked word."""
    n = len(word)
    count = n if pieces.single.issuperset(word) else sum(map(pieces.size, word))
    if n < 2:
        return count
    rank, places = pieces.rank.get, PLACES if n < PLACES else 2 * n
    heap = [r * places + i for i, r in enumerate(map(rank, map(add, word, word[1:]))) if r is not None]
    if not heap:
        return count
    heapify(heap)
    symbols: list[str | None] = [*word, END]
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while heap:
        r, i = divmod(heappop(heap), places)
        left = symbols[i]
        if left is None or rank(both := left + symbols[j := after[i]]) != r:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = both, None
        count -= 1
        after[i] = k = after[j]
        before[k] = i
        if (r := rank(both + symbols[k])) is not None:
            heappush(heap, r * places + i)
        if i and (r := rank(symbols[h := before[i]] + both)) is not None:
            heappush(heap, r * places + h)
    return count


class WordCounts(dict):
    """Tokens of a word after one space, by the word without its mark; a bounded table that begins anew when it is full."""

    def __init__(self, pieces: Pieces, limit: int):
        super().__init__()
        self.pieces, self.limit = pieces, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        k, n = len(word), 0
        while k > 1 and word[k - 2 : k] not in self.pieces.pairs:  # no merge takes the last character
            k -= 1
            n += self.pieces.size(word[k])
        n += self[word[:k]] if k < len(word) else merged_count(MARK + word, self.pieces)
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(text: str, known: WordCounts) -> int:
    """Tokens of a whole text."""
    if not text:
        return 0
    pieces = known.pieces
    text = text.replace(MARK, " ")
    total = 0
    for k, (begins, stretch) in enumerate(chunks(text, pieces.cuts)):
        if k:
            total += pieces.size(pieces.cuts[0])
        if not begins and stretch[:1] != " ":
            head, _, stretch = stretch.partition(" ") if " " in stretch else (stretch, "", None)
            total += merged_count(head, pieces) if head else 0
            if stretch is None:
                continue
        elif not begins:
            stretch = stretch[1:]
        if not stretch or stretch[0] == " " or stretch[-1] == " " or "  " in stretch:
            total += sum(merged_count(w, pieces) if w.startswith(MARK * 2) or len(w) == 1 else known[w[1:]] for w in marked_words(stretch, True))
        else:
            total += sum(map(known.__getitem__, stretch.split(" ")))
    return total


def token_counts(docs: DataFrame, model: bytes | None = None, limit: int = 4096, known_words: int = 800_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    model = model or model_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCounts(Pieces(model), known_words)
        for batch in batches:
            values = batch.column(1).to_pylist()
            n = [count_tokens(t, known) for t in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8")) for t in values], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(without_collector(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
