"""Token identifiers as files of equal-length sequences with masks, in Arrow's file format, and their reading back.

Documents are dealt out by ranges of doc_id, so that the shards in their order hold all of them in ascending order; a task encodes its range from one end to the other and writes it as it
goes. A shard is two Arrow files: one of record batches with two fixed-size lists a row, the identifiers and the mask, which packs the documents one after the other and fills the last row up
(mask false); and one of the documents, with the place of their first identifier in the shard and their number. Buffers are not compressed, so a mapped file gives any row, or any document
within a batch, as a view of its bytes: place p is row p / length.

The library encodes; as white space parts words for it, each distinct word of a task is encoded once, and words of Latin letters that differ in case, or in the signs at their end, only once together, by the library's model alone. Files carry the task attempt in their names, and the table of shards, which Spark commits, has those of the attempts that count: a task that is run again
leaves files that nobody reads.

Null and empty texts have the end identifier only. Null doc_ids come first. Rows that repeat a doc_id stay rows of their own, ordered by a hash of their text. A range with no
document has no shard; an empty table gives an empty result, and no file. Columns but the two named are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import blocks, saved, scratch, texts, without_collector

#: Bytes of text of a shard, about.
SHARD_BYTES = 64 << 20
#: White space at which a text is cut before the library sees it; all of it is white space to the library. A fixed value.
BREAKS = "\n\t\r\v\f"


def tokenizer_bytes(path: str | None = None) -> bytes:
    """The tokenizer's file, by default word_bpe_49k.json of the public tokenizers; it is of a fixed size (about 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


#: A word of letters that lower-case one by one, alone or before signs that the library parts from it. Letters and signs are fixed values.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """What stands for the UTF-8 bytes of the letters from À on in a vocabulary of bytes: a byte that prints as itself in Latin-1 does so, and the others come after them from 256 on, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    said = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(said[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordIds(dict):
    """Identifiers of words as bytes of a type, by the word. This and older hold at most limit of them: when this is full it becomes older, and a word that is met again moves back."""

    def __init__(self, tokenizer: bytes, kind: str, limit: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.library, self.kind, self.limit = Tokenizer.from_buffer(tokenizer), kind, limit
        self.model, self.letters = self.library.model, byte_letters()
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """A whole text by the library."""
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit // 2:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.made(word)
        self[word] = ids
        return ids

    def made(self, word: str) -> bytes:
        """A word of letters goes to the library's model as its lower-cased bytes, which is all that the library does before; signs after it come apart; any other word takes the library's whole way."""
        plain = PLAIN.fullmatch(word)
        if not plain:
            return self.encode(word)
        letters, signs = plain.groups()
        low = letters.lower()
        if signs:
            return self[low] + self[signs]
        if low != letters:
            return self[low]
        return array(self.kind, [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))]).tobytes()

    def of(self, text: str) -> bytes:
        """Identifiers of a whole text, by its words."""
        for c in BREAKS:
            if c in text:
                text = text.replace(c, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def words_apart(tokenizer: bytes) -> bool:
    """Whether the library's encoding of a text is that of its words one after the other, whatever white space is between them: that it composes, lower-cases, cuts at a known pattern and maps bytes, and does nothing else."""
    import json

    said = json.loads(tokenizer)
    kinds = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
    parts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"] or said["model"].get("type") != "BPE":
        return False
    split, mapped = parts
    pattern = split["pattern"].get("Regex", "")
    return split["behavior"] == "Removed" and split["invert"] and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not (mapped["add_prefix_space"] or mapped["use_regex"])


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that Spark names, and the folder's name in it."""
    for other in ("s3a://", "s3n://"):
        path = path.replace(other, "s3://", 1) if path.startswith(other) else path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard: rows of length identifiers, rows of them a batch."""

    def __init__(self, folder: str, name: str, length: int, rows: int, kind: str, id_type: pa.DataType):
        self.fs, base = _open(folder)
        self.length, self.size, self.kind = length, length * rows, np.dtype(kind)
        self.paths = [f"{base}/{name}.arrow", f"{base}/{name}.docs.arrow"]
        item = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", item, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.doc_schema = pa.schema([pa.field("doc_id", id_type), pa.field("start", pa.int64(), False), pa.field("n_tokens", pa.int64(), False)])
        self.files = [self.fs.open_output_stream(p) for p in self.paths]
        self.ids, self.docs = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.doc_schema), strict=True))
        self.held, self.n_held, self.n_ids, self.n_docs = [], 0, 0, 0

    def write(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        """Adds documents, with their identifiers as bytes."""
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        starts = self.n_ids + np.cumsum(n) - n
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(n)], schema=self.doc_schema))
        self.n_ids += int(n.sum())
        self.n_docs += len(ids)
        self.held.append(np.frombuffer(b"".join(ids), self.kind))
        self.n_held += len(self.held[-1])
        if self.n_held >= self.size:
            every = np.concatenate(self.held)
            full = self.n_held // self.size * self.size
            for k in range(0, full, self.size):
                self._batch(every[k : k + self.size], self.size)
            self.held, self.n_held = [every[full:]], self.n_held - full

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((ids, mask), self.schema, strict=True)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            fill = np.zeros(-self.n_held % self.length, self.kind)
            self._batch(np.concatenate([*self.held, fill]), self.n_held)
        for w in (self.ids, self.docs, *self.files):
            w.close()


class Shard:
    """A shard's file, mapped: rows and stretches of identifiers are views of its bytes."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.file = pa.memory_map(self.path) if isinstance(self.fs, pyarrow.fs.LocalFileSystem) else self.fs.open_input_file(self.path)
        self.reader = pa.ipc.open_file(self.file)
        self.length = self.reader.schema.field("ids").type.list_size
        self.kind = self.reader.schema.field("ids").type.value_type.to_pandas_dtype()
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self._at, self._batch = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.reader.get_batch(k)
        return self._batch

    def __len__(self) -> int:
        """Rows."""
        n = self.reader.num_record_batches
        return (n - 1) * self.rows + self.batch(n - 1).num_rows if n else 0

    def row(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Identifiers and mask of one sequence."""
        batch, k = self.batch(i // self.rows), i % self.rows
        return batch.column(0).values.to_numpy()[k * self.length : (k + 1) * self.length], batch.column(1).values.slice(k * self.length, self.length)

    def stretch(self, start: int, n: int) -> np.ndarray:
        """n identifiers from a place of the shard; a view if one batch has them all."""
        size, parts = self.rows * self.length, []
        while n > 0:
            k, at = divmod(start, size)
            parts.append(self.batch(k).column(0).values.to_numpy()[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """(doc_id, start, n_tokens) in their order."""
        with self.fs.open_input_file(self.path.removesuffix(".arrow") + ".docs.arrow") as f:
            reader = pa.ipc.open_file(f)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k)


def write_sequences(docs: DataFrame, folder: str | None = None, tokenizer: bytes | None = None, length: int = 2048, end_id: int = 1, shard_bytes: int = SHARD_BYTES, batch_rows: int = 256, known_words: int = 800_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of docs to a folder that all executors and the driver share (by default one of this session) and returns a row for each: shard (its place in their order), path, n_docs, n_ids, n_rows."""
    tokenizer = tokenizer or tokenizer_bytes()
    apart = words_apart(tokenizer)
    from tokenizers import Tokenizer

    small = Tokenizer.from_buffer(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16
    code, kind = ("H", "<u2") if small else ("I", "<u4")
    end = np.array([end_id], kind).tobytes()
    rows = texts(docs, id_col, text_col)
    spark = rows.sparkSession
    folder = folder or f"{scratch(spark)}/sequences-{uuid.uuid4().hex[:12]}"
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    ordered = rows.repartitionByRange(total // shard_bytes + 1, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task = TaskContext.get()
        known, out = WordIds(tokenizer, code, known_words), None
        encode = known.of if apart else known.encode
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = ShardWriter(folder, f"shard-{task.partitionId():06d}-{task.taskAttemptId()}", length, batch_rows, kind, batch.schema.field(0).type)
            values = batch.column(1).to_pylist()
            for i, j in blocks(values):
                out.write(batch.column(0).slice(i, j - i), [encode(t) + end for t in values[i:j]])
        if out is not None:
            out.close()
            said = (task.partitionId(), f"{folder}/{os.path.basename(out.paths[0])}", out.n_docs, out.n_ids, -(-out.n_ids // length))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(said, (pa.int64(), pa.string(), *[pa.int64()] * 3), strict=True)], ["shard", "path", "n_docs", "n_ids", "n_rows"])

    return saved(ordered.mapInArrow(without_collector(run), "shard long, path string, n_docs long, n_ids long, n_rows long"), "sequence-shards")


def sums_before(rows: DataFrame, place: str, value: str, block: int = 1000) -> DataFrame:
    """rows with start: the sum of value over all rows of smaller place. Blocks of places are summed first, so that no task orders more than one block, or one row for each."""
    blocked = rows.withColumn("__block", F.floor(F.col(place) / block))
    before = lambda *part: Window.partitionBy(*part).orderBy(part and place or "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("__block").agg(F.sum(value).alias("__sum")).withColumn("__ahead", F.coalesce(F.sum("__sum").over(before()), F.lit(0)))
    within = blocked.withColumn("__within", F.coalesce(F.sum(value).over(before("__block")), F.lit(0)))
    return within.join(blocks, "__block").withColumn("start", F.col("__ahead") + F.col("__within")).select(*rows.columns, "start")


def read_documents(shards: DataFrame, doc_type: str = "long", with_ids: bool = False) -> DataFrame:
    """Per document of a table of shards, from their files: doc_id, start (identifiers of all documents before it), n_tokens, ids_crc32 (of the identifiers as little-endian unsigned 32-bit integers), and with_ids also ids."""
    placed = sums_before(shards, "shard", "n_ids").select("shard", "path", "start")
    tasks = placed.repartitionByRange(max(1, shards.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path, first in zip(paths.column(1).to_pylist(), paths.column(2).to_pylist(), strict=True):
                shard = Shard(path)
                for docs in shard.documents():
                    places = [shard.stretch(a, n).astype("<u4") for a, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True)]
                    columns = {"doc_id": docs.column(0), "start": pa.array(docs.column(1).to_numpy() + first), "n_tokens": docs.column(2), "ids_crc32": pa.array([zlib.crc32(x) for x in places], pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int32) for x in places], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    return tasks.mapInArrow(run, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
