"""Byte-pair encoding by depth-first walks over a trie of distinct words, and decoding (operator 9).

The pieces of a text (``pretokens``) repeat a lot.  Pieces not met before go
into a trie; a depth-first walk carries, for every prefix, the last token of
the prefix's encoding and where that token begins.  A child needs only its
parents' states, so the encoding of a prefix that many words share is computed
once.  A text's ids are its pieces' ids one after the other.

Decoding puts the tokens' bytes together; bytes that are no UTF-8 become the
replacement character.  Null and empty texts give no ids and decode to the
empty text.  Rows are independent; repeated rows, null ids and further columns
do not matter.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as vocabs
from .common import frees, range_hashes, table, text_column, text_steps
from .pretokens import pieces

#: Words kept between batches; a cache only.
MAX_WORDS = 250_000
#: Words put into one trie.
TRIE_WORDS = 20_000
_WORD = -1


def encode_words(vocab: vocabs.Vocab, words: list[bytes]) -> dict[bytes, bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers."""
    out: dict[bytes, bytes] = {}
    for at in range(0, len(words), TRIE_WORDS):
        root: dict = {}
        for word in words[at : at + TRIE_WORDS]:
            node = root
            for byte in word:
                node = node.setdefault(byte, {})
            node[_WORD] = word
        _walk(vocab, root, out)
    return out


def _walk(vocab: vocabs.Vocab, root: dict, out: dict[bytes, bytes]) -> None:
    known, fits = vocab.beginnings, vocab.fits
    path = bytearray()
    # By depth: the last token, where it begins, and where tokens may begin that are not yet complete.
    last, begins, live = [-1], [0], [(0,)]
    todo = [(child, byte, 1) for byte, child in root.items() if byte != _WORD]
    if _WORD in root:
        out[b""] = b""
    while todo:
        node, byte, depth = todo.pop()
        del path[depth - 1 :], last[depth:], begins[depth:], live[depth:]
        path.append(byte)
        token, still = -1, []
        for start in live[-1]:  # the longest first
            mark = known.get(bytes(path[start:]), 0)
            if mark:
                if token < 0 and mark > 1 and (not start or fits(last[start], (mark >> 1) - 1)):
                    token = (mark >> 1) - 1
                    begin = start
                if mark & 1:
                    still.append(start)
        if token < 0:
            raise ValueError("no token fits: not a byte-level vocabulary")
        still.append(depth)
        last.append(token)
        begins.append(begin)
        live.append(still)
        for key, child in node.items():
            if key == _WORD:
                ids, end = [], depth
                while end:
                    ids.append(last[end])
                    end = begins[end]
                out[child] = pack_ids[len(ids)](*ids[::-1]) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids[::-1])
            else:
                todo.append((child, key, depth + 1))


pack_ids = [struct.Struct(f"<{n}I").pack for n in range(16)]


class WordCache:
    """Encodes texts piece by piece; ``encode`` gets the pieces not met before."""

    def __init__(self, encode: Callable[[list[bytes]], dict[bytes, bytes]], specials: dict[str, int]):
        self.encode = encode
        self.specials = specials
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not any(s in t for t in texts for s in self.specials):
            return self._plain(texts)
        segments, after = vocabs.split_special(texts, self.specials)
        parts: list[list[bytes]] = [[] for _ in texts]
        for ids, (k, special) in zip(self._plain(segments), after):
            parts[k].append(ids if special < 0 else ids + special.to_bytes(4, "little"))
        return [b"".join(p) for p in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        cut = pieces(texts)
        data, starts, ends = cut.data, cut.starts, cut.ends
        if not len(starts):
            return [b""] * len(texts)
        # Equal pieces of the batch meet by hash (their lengths are compared as well), so that
        # Python handles each distinct piece once.
        size = ends - starts
        _, first, which = np.unique(range_hashes(np.frombuffer(data, dtype=np.uint8), starts, ends), return_index=True, return_inverse=True)
        if (size[first][which] != size).any():
            raise ValueError("two different pieces have one hash")
        words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) > MAX_WORDS:  # what has not been met since the last time goes
            self.known, self.older = {}, self.known
        if fresh := [w for w in words if w not in self.known]:
            again = {w: self.older[w] for w in fresh if w in self.older}
            self.known.update(again)
            self.known.update(self.encode(sorted(w for w in fresh if w not in again)))
        found = list(map(self.known.__getitem__, words))
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        begin = (np.cumsum(n) - n)[which]
        n = n[which]
        after = np.cumsum(n)
        ids = flat[np.repeat(begin - (after - n), n) + np.arange(after[-1])]
        border = np.append(0, after)[np.searchsorted(cut.text, np.arange(len(texts) + 1))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(border, border[1:])]


@functools.cache
def encoder(path: str) -> WordCache:
    """One cache of words for each Python process."""
    vocab = vocabs.load(path)
    return WordCache(lambda words: encode_words(vocab, words), vocab.specials)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``, the token ids as little-endian unsigned 32-bit integers."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_steps(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(encoder(tokenizer).texts(texts), pa.binary())], names=["doc_id", "ids"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decoded_texts(encoded: list[bytes], tokenizer: str) -> list[str]:
    """The text that each run of ids stands for."""
    bytes_of = vocabs.load(tokenizer).bytes_of
    return [b"".join(map(bytes_of.__getitem__, np.frombuffer(x, dtype="<u4").tolist())).decode("utf-8", "replace") for x in encoded]


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the text that the ids stand for."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = decoded_texts(part.column(1).to_pylist(), tokenizer)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that a task holds the vocabulary once."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_steps(batches):
            encoded = encoder(tokenizer).texts(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(encoded, pa.binary()), pa.array(decoded_texts(encoded, tokenizer), pa.string())], names=["doc_id", "ids", "decoded"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Round trip of every text: number of ids, and digests of the ids and of the decoded text."""
    return round_trip(docs, tokenizer).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the 50k byte-level vocabulary."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
