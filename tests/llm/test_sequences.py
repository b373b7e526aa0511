import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convolake.llm import sequences

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
SCHEMA = "doc_id long, text string, start string, n_tokens string"
ODD = ["", None, " ", "a", "A.B,c. ", "it's IT'S don't. x,, y.. z.,", "<|endoftext|> a<|startoftext|>b <|endoftext|>. <|ENDOFTEXT|>", "日本語🙂é\x00\r\n", "x" * 3000, "The " * 3000, "ﬁ Å\xa0x y　z\x1cq\x85w", "a\tb\vc\fd", "İI ΑΣ ΑΣ. Σ, ẞß", "é é ́x á. 1,2.3, 4.", "3. b2. 3, ., , . ,."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_buffer(sequences.tokenizer_bytes())


def cases():
    deal = random.Random(11)
    return ODD + ["".join(deal.choice("abtheTHE'sS.,!  \n\té日🙂İΣ12|<>́\xa0") for _ in range(deal.randint(0, 40))) for _ in range(3000)]


def test_words_by_themselves_give_the_library_s_identifiers(library):
    known = sequences.WordIds(sequences.tokenizer_bytes(), "I", 300)
    every = [t or "" for t in cases()] + ["Straße! ÀÉ,. x--- a'b' c' 'd d's DON'T! Ÿ Ÿ, µ ª² ×÷ a× b÷. ſ K", "a<|endoftext|>, b,<|endoftext|> <|endoftext|"]
    every += [" ".join(chr(c) * 3 + "x" for c in range(0xC0, 0x100)), " ".join(map(chr, range(0x21, 0x250)))]
    for t in every:
        assert np.frombuffer(known.of(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_only_tokenizers_that_drop_white_space_and_case_are_cut_into_words():
    import public_tokenizers

    assert sequences.words_apart(sequences.tokenizer_bytes())
    assert not sequences.words_apart(sequences.tokenizer_bytes(public_tokenizers.path("byte_bpe_50k.json")))


def rows_of(library, docs):
    """What must come back, by encoding one document after the other."""
    start, out = 0, []
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = rows_of(library, sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    for shard_bytes in (1 << 17, 1 << 26):
        shards = sequences.write_sequences(docs, shard_bytes=shard_bytes, length=512, batch_rows=7, known_words=3000)
        assert sorted(map(tuple, sequences.read_documents(shards).collect())) == want
        assert shards.agg(F.sum("n_docs"), F.sum("n_ids")).first() == (len(want), want[-1][1] + want[-1][2])
    assert shards.count() == 1


def test_rows_are_views_of_the_file_and_masks_end_where_identifiers_do(spark, tmp_path, library):
    docs = spark.createDataFrame([(k, f"document number {k} says " + "word " * (k % 50)) for k in range(200)], "doc_id long, text string")
    shards = sequences.write_sequences(docs, f"file://{tmp_path}/out", length=64, batch_rows=4, shard_bytes=1 << 12).orderBy("shard").collect()
    every, held = [], 0
    for s in shards:
        shard = sequences.Shard(s.path)
        assert len(shard) == s.n_rows and shard.reader.schema.field("ids").type == pa.list_(pa.field("item", pa.uint16(), False), 64)
        for i in range(len(shard)):
            ids, mask = shard.row(i)
            mask = mask.to_numpy(zero_copy_only=False)
            assert len(ids) == 64 == len(mask) and mask.all() if i + 1 < len(shard) else (mask[: mask.sum()].all() and (ids[mask.sum() :] == 0).all())
            every += ids[mask].tolist()
        before = pa.total_allocated_bytes()
        ids, _ = shard.row(0)
        assert not ids.flags.owndata and not ids.flags.writeable and pa.total_allocated_bytes() == before
        held += s.n_ids
    assert len(shards) > 1 and len(every) == held
    assert every == [x for k in range(200) for x in [*library.encode(f"document number {k} says " + "word " * (k % 50), add_special_tokens=False).ids, 1]]
    ids = {r.doc_id: r.ids for r in sequences.read_documents(spark.createDataFrame(shards), with_ids=True).collect()}
    assert [x for k in range(200) for x in ids[k]] == every


def test_odd_rows_and_leftover_files(spark, library):
    rows = [(deal, t, "clash", "clash") for deal, t in zip([3, 3, None, 7, 1, 2, 9, 8, 3, 11, -5, None, 12, 13, 14], ODD)] + [(3, "a", "c", "c"), (3, "a", "c", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    shards = sequences.write_sequences(df, length=16, batch_rows=2, shard_bytes=1 << 12)
    folder = os.path.dirname(shards.first().path)
    with open(f"{folder.removeprefix('file://')}/shard-000000-999.arrow", "w") as f:
        f.write("of a task that was lost")
    got = sorted(map(tuple, sequences.read_documents(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    ends = 0
    for r in got:
        assert r[1] == ends
        ends += r[2]
    one = lambda d, t: (d, *rows_of(library, [(d, t)])[0][2:])
    assert sorted(((r[0], *r[2:]) for r in got), key=str) == sorted((one(*r[:2]) for r in rows), key=str)
    none = sequences.write_sequences(df.limit(0))
    assert none.collect() == [] == sequences.read_documents(none).collect()


def test_sums_before_cross_blocks(spark):
    n = [random.Random(4).randint(0, 9) for _ in range(2500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(n) if k % 7], "shard long, n long").repartition(5)
    for r in sequences.sums_before(df, "shard", "n", 100).collect():
        assert r.start == sum(v for k, v in enumerate(n[: r.shard]) if k % 7)
