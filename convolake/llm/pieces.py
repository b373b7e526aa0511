"""The vocabulary of a SentencePiece BPE model, and what its encoder does around the merges.

The library reads the file; merging, counting and segmenting are done here. The texts of such models are marked words: a run of marks, which stand for spaces,
and what follows up to the next mark. No piece holds a mark after another character, so no merge crosses the start of a marked word; the same holds for
characters that no longer piece contains, such as line ends.
"""

from __future__ import annotations

#: Stands for a space. A fixed value of the format.
MARK = "▁"


def model_bytes(path: str | None = None) -> bytes:
    """The model file, by default piece_bpe_32k.model of the public tokenizers; it is of a fixed size (about 0.5 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """rank: place of each piece in the order of merges. ids: identifier of each piece. pairs: adjacent characters of any piece."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = range(sp.get_piece_size())
        self.unk = sp.unk_id()
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in kinds if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in kinds if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        levels = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: levels[s] for p, s in scores.items() if len(p) > 1}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark inside, so that words cannot be cut at spaces")
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        self.pairs = frozenset(p[i : i + 2] for p in self.rank for i in range(len(p) - 1))
        joined = set("".join(self.rank))
        self.cuts = [c for c in "\n" if c not in joined]  # of the characters that no merge takes, the most frequent
        self.text = {i: p for p, i in self.ids.items()}

    def size(self, char: str) -> int:
        """Symbols of one character: itself, or its bytes if the vocabulary lacks it."""
        return 1 if char in self.ids else len(char.encode("utf-8", "surrogatepass")) if self.byte_id else 1

    def spell(self, char: str) -> list[int]:
        """Identifiers of a character that no piece takes."""
        if char in self.ids:
            return [self.ids[char]]
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unk]


def chunks(text: str, cuts: list[str]):
    """Stretches between cut characters: (whether the text begins here, the stretch); the cut characters are told apart by the caller's count."""
    stretches = [text]
    for c in cuts:
        stretches = [y for x in stretches for y in x.split(c)]
    for k, x in enumerate(stretches):
        yield k == 0, x


def marked_words(stretch: str, begins: bool) -> list[str]:
    """The marked words of a stretch; one that begins the text gets the mark that every text begins with."""
    words = ("" if begins else "\0").join(("", stretch)).split(" ")
    out, run = [], 0
    first = True
    for w in words:
        if first:
            first = False
            if begins:
                if w:
                    out.append(MARK + w)
                else:
                    run = 1
            elif len(w) > 1:
                out.append(w[1:])
            continue
        run += 1
        if w:
            out.append(MARK * run + w)
            run = 0
    if run:
        out.append(MARK * run)
    return out
