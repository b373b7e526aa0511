"""SentencePiece encoding and decoding, by forward scores shared along common prefixes.

The distinct marked words of a block of texts are sorted and walked as a trie, depth first: a word keeps the forward states of the prefix that it shares
with the word before and computes the others. The state of a prefix is its last token and the number of tokens up to there. A BPE vocabulary is not scored
by sums, as the highest sum of scores is another segmentation than that of the merges; here a token may end a prefix if it and the last token before it stay
as they are when the two are merged on their own. For each prefix one token does, and following the links back gives the identifiers that the merges give.
A character outside the vocabulary is spelled in bytes and parts the tokens on its two sides.

Null and empty texts have no identifiers and decode to the empty text. A mark in a text is read as a space, as the format does, and decodes to one; all else
comes back exactly. Rows that repeat stay rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import blocks, texts, without_collector
from convolake.llm.pieces import MARK, Pieces, chunks, marked_words, model_bytes


def last_merges(pieces: Pieces) -> dict[str, tuple[str, str]]:
    """The two symbols of which the last merge makes each piece of two characters or more; a piece that its own merges don't make is left out."""
    rank, out = pieces.rank, {}
    for piece in rank:
        symbols = list(piece)
        while len(symbols) > 2:
            best = min(((r, i) for i in range(len(symbols) - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        if len(symbols) == 2:
            out[piece] = symbols[0], symbols[1]
    return out


#: Begins the key of a word without a mark; no text has it.
HEAD = "\udfff"


def key_of(word: str) -> str:
    """A marked word as a key: without its mark if that is one that a space gives, as most have; a run of marks, or a lone one, stays, and a word without a mark has a sign in its place."""
    if not word.startswith(MARK):
        return HEAD + word
    return word if len(word) == 1 or word[1] == MARK else word[1:]


def word_of(key: str) -> str:
    """The marked word of a key."""
    return key[1:] if key[0] == HEAD else key if key[0] == MARK else MARK + key


def spelled(keys: list[str]) -> str:
    """The text of keys."""
    text = " ".join(keys).replace(" " + HEAD, "").replace(" " + MARK, MARK).replace(MARK, " ")
    return text[1:] if keys and keys[0][0] == MARK else text


class Codec:
    """Encodes and decodes whole texts. known and older hold the identifiers of words by their keys as little-endian 32-bit integers, at most limit of them: when known is full it becomes older, and a word that is met again moves back."""

    def __init__(self, pieces: Pieces, limit: int = 300_000, splits: dict[str, tuple[str, str]] | None = None):
        self.pieces, self.limit = pieces, limit
        self.splits = last_merges(pieces) if splits is None else splits
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words that do not come back from their identifiers
        self.stands: dict[int, bool] = {}  # by the identifiers of two tokens
        self.alone = {p: pieces.ids[p] for p in pieces.ids if len(p) == 1 or p in self.splits}
        self.ends: dict[str, list[int]] = {}  # lengths of the pieces that a text may end with, by its last three characters, or fewer; longest first
        for p in sorted(self.alone, key=len, reverse=True):
            if len(p) not in (sizes := self.ends.setdefault(p[-3:], [])):
                sizes.append(len(p))
        for key, sizes in self.ends.items():  # every shorter ending of a key, be that ending a key or not
            sizes.extend(n for n in range(len(key) - 1, 0, -1) if key[-n:] in self.alone)
        self.byte_of = {i: b for b, i in pieces.byte_id.items()}
        self.say = pieces.text | {i: chr(b) for i, b in self.byte_of.items() if b < 128} | {pieces.unk: "\N{REPLACEMENT CHARACTER}"}

    def holds(self, pair: int, left: str, right: str) -> bool:
        """Whether merging the two on their own leaves them as they are: the later of their merges is undone, again and again, and none across their border may have come before it."""
        if len(self.stands) > 2_000_000:
            self.stands.clear()
        known = self.stands[pair] = self._holds(left, right)
        return known

    def _holds(self, left: str, right: str) -> bool:
        rank, limit = self.pieces.rank.get, float("inf")
        while True:
            if (r := rank(left + right)) is not None and r < limit:
                return False
            a, b = rank(left, -1), rank(right, -1)
            if a > b:
                limit, left = a, self.splits[left][1]
            elif b >= 0:
                limit, right = b + 1, self.splits[right][0]  # of equal merges the left one comes first
            else:
                return True

    def learn(self, keys: Iterable[str]) -> None:
        """Adds the identifiers of words to the table. A word whose last character no piece has after the one before it, such as a sign after letters, is the word without it, and that character."""
        pairs, alone = self.pieces.pairs, self.alone
        parted = [k for k in keys if len(k) > 2 and k[-2:] not in pairs and k[-1] in alone and k[-2] not in (HEAD, MARK)]
        whole = {k[:-1] for k in parted}
        whole.update(keys)
        whole.difference_update(parted)
        whole.difference_update(self.known)
        again = whole & self.older.keys()
        self.known.update((k, self.older[k]) for k in again)
        self.walk(whole - again)
        last = {c: array("i", [i]).tobytes() for c, i in alone.items() if len(c) == 1}
        rest = []
        for k in parted:
            if (ids := self.known.get(k[:-1])) is None or k[:-1] in self.odd:
                rest.append(k)  # what is left of it is parted itself
            else:
                self.known[k] = ids + last[k[-1]]
        self.walk(rest)

    def walk(self, keys: Iterable[str]) -> None:
        """Adds the identifiers of words, walking the marked words as a trie."""
        words = {word_of(k): k for k in keys}
        sizes, tokens = [0], [0]  # of each prefix of the word before its last token: length and identifier; no length for a character outside the vocabulary
        before = ""
        alone, ends, stands, spell, none = self.alone, self.ends, self.stands, self.pieces.spell, ()
        for word in sorted(words):
            n = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                n += 1
            del sizes[n + 1 :], tokens[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                found = token = 0
                near = ends.get(word[i - 3 : i]) if i > 2 else None
                if near is None and (near := ends.get(word[i - 2 : i]) if i > 1 else None) is None:
                    near = ends.get(word[i - 1], none)
                for size in near:
                    j = i - size
                    if j < 0 or (token := alone.get(word[j:i])) is None:
                        continue
                    if not (k := sizes[j]) or ((known := stands.get(pair := tokens[j] << 32 | token)) is None and self.holds(pair, word[j - k : j], word[j:i])) or known:
                        found = size
                        break
                sizes.append(found)
                tokens.append(token)
            out: list[int] = []
            i = len(word)
            while i:
                if size := sizes[i]:
                    out.append(tokens[i])
                    i -= size
                else:
                    out.extend(reversed(spell(word[i - 1])))
                    i -= 1
            out.reverse()
            self.known[words[word]] = array("i", out).tobytes()
            if self.said(out) != word:
                self.odd.add(words[word])
            before = word

    def keys(self, text: str) -> list[str]:
        """Keys of the marked words of a text in order, and of the cut characters between its stretches."""
        if not text:
            return []
        out: list[str] = []
        for k, (begins, stretch) in enumerate(chunks(text.replace(MARK, " "), self.pieces.cuts)):
            if k:
                out.append(HEAD + self.pieces.cuts[0])
            if not stretch or stretch[-1] == " " or "  " in stretch or begins and stretch[0] == " ":
                out.extend(map(key_of, marked_words(stretch, begins)))
            elif begins:
                out.extend(stretch.split(" "))
            elif stretch[0] == " ":
                out.extend(stretch[1:].split(" "))
            else:
                out.extend((HEAD + stretch).split(" "))
        return out

    def encode(self, block: list[str]) -> list[np.ndarray]:
        """Identifiers of each text of a block."""
        return [ids for ids, _ in self.encode_and_check(block)]

    def encode_and_check(self, block: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Of each text of a block its identifiers and whether they decode to it. Words decode apart from each other, so each word is decoded when it is learnt, and the words in their order must spell the text."""
        split = [self.keys(t) for t in block]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.limit // 2:
            self.older, self.known = self.known, {}
            self.odd &= self.older.keys()
            new = set().union(*split)
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.learn(new - again)
        for text, words in zip(block, split, strict=True):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
            yield ids, (not self.odd or self.odd.isdisjoint(words)) and spelled(words) == text.replace(MARK, " ")

    def said(self, ids: list[int]) -> str:
        """The marked text of identifiers; bytes that are no UTF-8 become replacement characters."""
        try:
            return "".join([self.say[i] for i in ids])
        except KeyError:  # bytes beyond ASCII, or unknown identifiers
            parts, run = [], bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                parts += [run.decode("utf-8", "replace"), self.say.get(i, "")]
                run = bytearray()
            return "".join(parts) + run.decode("utf-8", "replace")

    def decode(self, ids: np.ndarray) -> str:
        """The text of identifiers."""
        return self.said(ids.tolist()).replace(MARK, " ").removeprefix(" ")


def encode(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids array<int>, n_tokens, ids_sha256 (of the identifiers as little-endian 32-bit integers), round_trip (decoding gives the text)."""
    model = model or model_bytes()
    splits = last_merges(Pieces(model))  # as many as the vocabulary has pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces(model), splits=splits)
        for batch in batches:
            values = batch.column(1).to_pylist()
            for start, end in blocks(values):
                block = values[start:end]
                ids, same = zip(*codec.encode_and_check(block), strict=True)
                sizes = np.array([0, *map(len, ids)], np.int64).cumsum()
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids)))
                digests = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(block)), lists, pa.array(np.diff(sizes)), pa.array(digests), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "ids_sha256", "round_trip"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(without_collector(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean")


def decode(tokens: DataFrame, model: bytes | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its identifiers; null identifiers give the empty text, unknown ones nothing."""
    model = model or model_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces(model), splits={})
        for batch in batches:
            out = [codec.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(f"`{id_col}`").alias("doc_id"), F.filter(F.col(f"`{ids_col}`"), lambda x: x.isNotNull()).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
