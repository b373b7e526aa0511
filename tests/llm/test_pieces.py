import os
import random

import numpy as np
import pytest

from convolake.llm import piece_codec, token_counts
from convolake.llm.pieces import MARK, Pieces, model_bytes

sentencepiece = pytest.importorskip("sentencepiece")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"
ODD = ["", " ", "  ", "a", "a  b ", " \n ", "\n\n", "▁x", "<s></s><unk><0x0A>", "日本語🙂é\x00\r\n", "x" * 3000, "the " * 3000, "ﬁ Å\xa0x", "a\tb"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes())


def cases():
    deal = random.Random(7)
    return ODD + [" " * k + "x" + " " * (k // 2) for k in range(70)] + ["".join(deal.choice("abthe  \n\t▁é日🙂x.,1\r") for _ in range(deal.randint(0, 40))) for _ in range(1500)]


def test_counts_equal_the_library(library):
    known = token_counts.WordCounts(Pieces(model_bytes()), 50)
    for t in cases():
        assert token_counts.count_tokens(t, known) == len(library.encode(t)), repr(t)


@pytest.mark.parametrize("run", ["0", "12", "123456789", "日", "中文字符", "ก", "日本語テキスト"])
def test_counts_of_long_runs(library, run):
    known, said = token_counts.WordCounts(Pieces(model_bytes()), 50), run * 5000
    for t in (said, f"a {said}", f"{said[:5000]}. b"):
        assert token_counts.count_tokens(t, known) == len(library.encode(t))


def test_identifiers_equal_the_library_and_come_back(library):
    codec = piece_codec.Codec(Pieces(model_bytes()), 400)
    every = cases()
    for t, got in zip(every, codec.encode(every), strict=True):
        assert list(got) == library.encode(t), repr(t)
        assert codec.decode(np.array(got, np.int32)) == t.replace(MARK, " ")


def test_every_ending_is_tried(library):
    pieces = Pieces(model_bytes())
    codec = piece_codec.Codec(pieces)
    for key, sizes in codec.ends.items():
        assert sizes == sorted(set(sizes), reverse=True)
        assert {n for n in sizes if n < len(key)} == {n for n in range(1, len(key)) if key[-n:] in codec.alone}
        assert all(n >= len(key) or key[-n:] in codec.alone for n in sizes)


def test_identifiers_of_pieces_and_their_pairs(library):
    pieces = Pieces(model_bytes())
    codec, deal = piece_codec.Codec(pieces), random.Random(3)
    every = sorted(p for p in pieces.ids if MARK not in p)
    endings = {}
    for p in every:
        endings.setdefault(p[-2:], []).append(p)
    words = every + [a + b for a in deal.sample(every, 4000) for b in deal.sample(endings[a[-2:]], min(3, len(endings[a[-2:]])))]
    words += [deal.choice(every) + deal.choice(every) + deal.choice(every) for _ in range(20000)]
    blocks = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    for t, got in zip(blocks, codec.encode(blocks), strict=True):
        assert list(got) == library.encode(t), t


def test_queries_over_texts(spark, library):
    rows = [(i, t, "c", 0) for i, t in enumerate(ODD)] + [(None, None, "c", 0), (1, " ", "c", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for r in token_counts.token_counts(df, limit=2).collect():
        t = dict((a, b or "") for a, b, _, _ in rows)[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 2)
    encoded = piece_codec.encode(df)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    back = {r.doc_id: r.text for r in piece_codec.decode(encoded).collect()}
    assert back == {a: (b or "").replace(MARK, " ") for a, b, _, _ in rows}
    assert token_counts.token_counts(df.limit(0)).collect() == [] == piece_codec.encode(df.limit(0)).collect()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_table_equals_the_library(spark, sf_dir, library, size):
    docs = spark.read.parquet(f"{os.path.dirname(sf_dir)}/{size}/documents.parquet")
    want = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {k: len(v) for k, v in want.items()}
    assert {r.doc_id: r.ids for r in piece_codec.encode(docs).collect()} == want
