"""Token ids as files of fixed-width bit-packed blocks (operator 3).

A file is a row of records, each followed by one line feed:

* blocks: ``TKB1``, bits per id (u8, three bytes of padding), number of ids
  (u32), number of documents that begin in the block (u32), position of the
  block's first id in the file (u64), length of the packed ids (u64); then for
  those documents their ids (i64), whether the id is null (u8), and where each
  begins in the block (u32); then the packed ids.
* a footer: ``TKF1``, number of blocks (u32), number of ids (u64), the blocks'
  byte offsets and first positions (u64 each), the footer's length (u32) and
  ``TKE1``.

All numbers are little-endian.  Every id takes the bits that the largest id of
the vocabulary needs, so an id's place in its block is known without reading
others: the footer's offsets and one block give any range of ids.  Files hold
ranges of ascending document ids, in the order of the numbers in their names.

Spark's own text writer stores the records, so the files land on whatever file
system the path names, a task's file appears only when the task has succeeded,
and a lost task is simply run again.

Null texts count as empty: a document then has only its end id.  A null
document id sorts first.  Repeated ids keep one entry per row, by text within a file and by its hash across files.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab as vocabs
from .common import frees, saved, scratch, table, text_column, text_steps
from .trie_codec import WordCache

BLOCK_IDS = 65_536
#: Text that one file takes, about.
FILE_BYTES = 48_000_000
END_ID = 0
#: Words that the library encodes as one text, and the characters of a word that is encoded alone.
TOGETHER, LONG_WORD = 256, 1_000
_BLOCK = struct.Struct("<4sB3xIIQQ")
_FOOT = struct.Struct("<4sIQ")
_TAIL = struct.Struct("<I4s")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, low bits first, without gaps."""
    groups = -(-len(ids) // 8)
    padded = np.zeros(groups * 8, dtype=np.uint64)
    padded[: len(ids)] = ids
    lanes = padded.reshape(groups, 8).T  # eight ids make a group of ``bits`` bytes
    out = np.zeros((groups, bits), dtype=np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of packed ``data``."""
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, dtype=np.uint8)
    raw[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    raw = raw.reshape(groups, bits)
    out = np.empty((groups, 8), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, dtype=np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.ravel()[:n]


class FileWriter:
    """The records of one file, block by block as documents come in."""

    def __init__(self, bits: int):
        self.bits = bits
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.done = self.offset = 0
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        """Adds a document; yields the blocks that are full."""
        self.docs.append((doc_id, self.done + self.n_waiting))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            everything = np.concatenate(self.waiting)
            full = len(everything) // BLOCK_IDS * BLOCK_IDS
            for at in range(0, full, BLOCK_IDS):
                yield self._block(everything[at : at + BLOCK_IDS])
            self.waiting, self.n_waiting = [everything[full:]], len(everything) - full

    def _block(self, ids: np.ndarray) -> bytes:
        end = self.done + len(ids)
        here = sum(1 for _, at in self.docs if at < end) if self.docs and self.docs[-1][1] >= end else len(self.docs)
        docs, self.docs = self.docs[:here], self.docs[here:]
        packed = pack(ids, self.bits)
        record = b"".join(
            [
                _BLOCK.pack(b"TKB1", self.bits, len(ids), len(docs), self.done, len(packed)),
                np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes(),
                np.array([d is None for d, _ in docs], dtype=np.uint8).tobytes(),
                np.array([at - self.done for _, at in docs], dtype="<u4").tobytes(),
                packed,
            ]
        )
        self.blocks.append((self.offset, self.done))
        self.offset += len(record) + 1
        self.done = end
        return record

    def close(self) -> Iterator[bytes]:
        """The last block and the footer."""
        if self.n_waiting:
            yield self._block(np.concatenate(self.waiting))
        if self.blocks:
            body = _FOOT.pack(b"TKF1", len(self.blocks), self.done) + np.array(self.blocks, dtype="<u8").T.tobytes()
            yield body + _TAIL.pack(len(body), b"TKE1")


def footer(content: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Byte offsets and first positions of a file's blocks, and its number of ids."""
    length, mark = _TAIL.unpack_from(content, len(content) - 1 - _TAIL.size)
    if mark != b"TKE1":
        raise ValueError("not a file of token blocks, or one that was cut short")
    at = len(content) - 1 - _TAIL.size - length
    _, n, total = _FOOT.unpack_from(content, at)
    both = np.frombuffer(content, dtype="<u8", count=2 * n, offset=at + _FOOT.size).reshape(2, n)
    return both[0].astype(np.int64), both[1].astype(np.int64), total


def block(content: bytes, offset: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents that begin in a block, where they begin in it, and the block's ids."""
    mark, bits, n, n_docs, _, size = _BLOCK.unpack_from(content, offset)
    if mark != b"TKB1":
        raise ValueError("no block begins here")
    at = offset + _BLOCK.size
    doc_ids = np.frombuffer(content, dtype="<i8", count=n_docs, offset=at).tolist()
    nulls = np.frombuffer(content, dtype=np.uint8, count=n_docs, offset=at + 8 * n_docs)
    begins = np.frombuffer(content, dtype="<u4", count=n_docs, offset=at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    for k in np.flatnonzero(nulls):
        doc_ids[k] = None
    return doc_ids, begins, unpack(content[at : at + size], n, bits)


def ids_at(content: bytes, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a file; only the blocks that hold them are unpacked."""
    offsets, firsts, total = footer(content)
    stop = min(start + n, total)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    a, b = np.searchsorted(firsts, [start, stop - 1], side="right") - 1
    parts = [block(content, int(offsets[k]))[2] for k in range(a, b + 1)]
    return np.concatenate(parts)[start - firsts[a] : stop - firsts[a]]


@functools.cache
def library_encoder(path: str) -> WordCache:
    """Pieces encoded by the tokenizers library, each distinct piece of a batch once and many of them in one text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    vocab = vocabs.load(path)
    specials = vocab.specials
    lengths = np.fromiter(map(len, vocab.bytes_of), dtype=np.int64)

    def one_by_one(words: list[str]) -> Iterator[tuple[bytes, bytes]]:
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            for word, found in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                yield word.encode(), np.array(found.ids, dtype="<u4").tobytes()

    def together(words: list[str], between: str, alone: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of words that the library cuts apart where they meet; those of a text that it cuts otherwise go to ``alone``."""
        parts = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        texts = [between.join(p) for p in parts]
        for at in range(0, len(parts), 16):
            for part, text, found in zip(parts[at : at + 16], texts[at : at + 16], tokenizer.encode_batch_fast(texts[at : at + 16], add_special_tokens=False)):
                known = [word.encode() for word in part]
                ends = np.cumsum(np.fromiter(map(len, known), dtype=np.int64, count=len(part)) + len(between)) - len(between)
                ids = np.array(found.ids, dtype="<u4")
                # Tokens end where words end, seen by the bytes that tokens stand for.
                after = np.cumsum(lengths[ids])
                stop = np.minimum(np.searchsorted(after, ends), len(ids) - 1)
                if (after[stop] != ends).any() or any(s in text for s in specials):
                    alone += part
                    continue
                start = np.append(0, stop[:-1] + 1 + len(between))
                raw = ids.tobytes()
                for word, a, b in zip(known, (4 * start).tolist(), (4 * stop + 4).tolist()):
                    yield word, raw[a:b]

    def encode(words: list[bytes]) -> dict[bytes, bytes]:
        # A word without white space ends where white space comes, so words that begin with a space
        # can follow one another in one text, and others with line feeds (words of their own) between them.
        spaced, bare, alone = [], [], []
        for word in map(bytes.decode, words):
            core = word.split()
            if len(core) == 1 and len(word) <= LONG_WORD and core[0] == word:
                bare.append(word)
            elif len(core) == 1 and len(word) <= LONG_WORD and word[0] == " " and core[0] == word[1:]:
                spaced.append(word)
            else:
                alone.append(word)
        out = dict(together(spaced, "", alone))
        out.update(together(bare, "\n", alone))
        out.update(one_by_one(alone))
        return out

    return WordCache(encode, specials)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Encodes every text, appends ``end_id`` and writes the ids in ascending order of ``doc_id``."""
    bits = max(1, (vocabs.load(tokenizer).size - 1).bit_length())
    spark = docs.sparkSession
    rows = text_column(docs)
    size = rows.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = FileWriter(bits)
        end = end_id.to_bytes(4, "little")
        for ids, texts in text_steps(batches):
            records: list[bytes] = []
            for doc_id, found in zip(ids.to_pylist(), library_encoder(tokenizer).texts(texts)):
                records += out.add(doc_id, np.frombuffer(found + end, dtype="<u4"))
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])
        if records := list(out.close()):
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    (
        rows.repartitionByRange(files, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .text(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: id, file, place in the file, number of ids and their CRC-32."""
    schema = "doc_id long, file string, place long, n_tokens long, ids_crc32 long"

    def documents(name: str, content: bytes) -> Iterator[tuple]:
        offsets, firsts, _ = footer(content)
        current: tuple[int | None, int] | None = None
        n = crc = 0
        for offset, first in zip(offsets.tolist(), firsts.tolist()):
            doc_ids, begins, ids = block(content, offset)
            raw = memoryview(ids.astype("<u4").tobytes())
            borders = [*begins.tolist(), len(ids)]
            if current and borders[0]:
                n, crc = n + borders[0], zlib.crc32(raw[: 4 * borders[0]], crc)
            for doc_id, a, b in zip(doc_ids, borders, borders[1:]):
                if current:
                    yield current[0], name, current[1], n, crc
                current, n, crc = (doc_id, first + a), b - a, zlib.crc32(raw[4 * a : 4 * b])
        if current:
            yield current[0], name, current[1], n, crc

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = list(documents(name.as_py(), content.as_py()))
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(columns)],
                        names=["doc_id", "file", "place", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


def global_places(read: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids in all documents before, over all files."""
    read = saved(read, "token-index")
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row for each file: a running sum over far fewer rows than documents.  Numbers in names
    # have five digits and more beyond, so as text they would not be in order.
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = totals.select("file", (F.sum("n").over(Window.orderBy(number, "file")) - F.col("n")).alias("before"))
    return read.join(before, "file").withColumn("start", F.col("before") + F.col("place"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids to packed files, reads them back and returns each document's entry."""
    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return global_places(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
