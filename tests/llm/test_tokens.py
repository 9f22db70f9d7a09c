"""Operators 3, 4 and 9 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tilewright.llm import token_counts, token_files, trie_codec
from tilewright.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows_of(small):
    return pq.read_table(f"{small}/documents.parquet").to_pylist()


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def odd_texts():
    rng = random.Random(3)
    out = ["", "'", "''s", " 's", "a's're'll 've", "\n\n a\t\tb  ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " " * 700 + "x", "ab" * 900, "-" * 999]
    out += ["".join(rng.choice("ab's rell \n\t1é½!'-日　") for _ in range(rng.randint(0, 700))) for _ in range(80)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1F9FF)])) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    return out


def test_counts_equal_the_library(library):
    texts = odd_texts()
    assert token_counts.count_texts(texts, PATH).tolist() == [len(ids_of(library, t)) for t in texts]


def test_counts_do_not_depend_on_the_size_of_the_cache(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    texts = odd_texts()[:30]
    assert token_counts.count_texts(texts, PATH).tolist() == [len(ids_of(library, t)) for t in texts]


def test_trie_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(trie_codec, "MAX_WORDS", 50)
    monkeypatch.setattr(trie_codec, "TRIE_WORDS", 7)
    texts = odd_texts()
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        assert trie_codec.encoder(PATH).texts(part) == [ids_of(library, t).tobytes() for t in part]


def test_op4(spark, small, empty, library):
    got = Counter(map(tuple, token_counts.op4_token_counts(spark, small).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    want = Counter()
    for r in rows_of(small):
        n = len(ids_of(library, r["text"]))
        want[r["doc_id"], len((r["text"] or "").encode()), n, n > 512] += 1
    assert got == want
    assert token_counts.op4_token_counts(spark, empty).count() == 0


def test_op9(spark, small, empty, library):
    got = Counter(map(tuple, trie_codec.op9_bpe_codec(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    want = Counter()
    for r in rows_of(small):
        ids = ids_of(library, r["text"])
        text = library.decode(ids.tolist(), skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert trie_codec.op9_bpe_codec(spark, empty).count() == 0


def test_encode_then_decode_is_the_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    two = trie_codec.decode(trie_codec.encode(docs, PATH), PATH)
    assert Counter(map(tuple, two.collect())) == Counter(map(tuple, trie_codec.round_trip(docs, PATH).collect()))


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        packed = token_files.pack(ids, bits)
        assert len(packed) == -(-n * bits // 8)
        assert (token_files.unpack(packed, n, bits) == ids).all()


@pytest.mark.parametrize("together", [1, 3, 256])
def test_words_encoded_as_one_text_equal_the_library(library, monkeypatch, together):
    monkeypatch.setattr(token_files, "TOGETHER", together)
    rng = random.Random(together)
    signs = ["'s", "'", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\u180e", "ab", "Zürich", "漢字", "12", "?!", "<|endoftext|>", "<|", "endoftext", "|>", "\U0001f600"]
    texts = ["", " ", "''s 's", "it's 'twas ''ll", "<|endoftext|> a<|endoftext|>", "é" * 3_000, " " + "x" * 3_000, "\x00 \x00"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(400)]
    encoder = token_files.library_encoder.__wrapped__(PATH)
    assert encoder.texts(texts) == [ids_of(library, t).tobytes() for t in texts]


def test_file_and_random_access(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    rng = np.random.default_rng(1)
    out, parts = token_files.FileWriter(11), []
    docs = [rng.integers(0, 2048, n) for n in (1, 63, 64, 1, 500, 2, 0, 7)]
    for k, d in enumerate(docs):
        parts += out.add(None if k == 2 else k, d)
    parts += out.close()
    content = b"".join(p + b"\n" for p in parts)
    everything = np.concatenate(docs)
    for start, n in ((0, 5), (60, 10), (0, 10_000), (600, 50), (10_000, 3)):
        assert (token_files.ids_at(content, start, n) == everything[start : start + n]).all()
    with pytest.raises(ValueError):
        token_files.footer(content[:-9])


def test_op3(spark, small, empty, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    got = [tuple(r) for r in token_files.op3_token_files(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    rows = sorted(rows_of(small), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r in rows:
        ids = np.append(ids_of(library, r["text"]), 0).astype("<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.op3_token_files(spark, empty).count() == 0


def test_files_hold_ids_in_the_fewest_bits(spark, small, library):
    path = scratch(spark, "bits")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    token_files.write_tokens(docs, path, PATH)
    total = sum(len(ids_of(library, r["text"])) + 1 for r in rows_of(small))
    size = sum(r.length for r in spark.read.format("binaryFile").load(path).select("length").collect())
    assert 2 * total <= size < 2 * total + 13 * 200 + 100 * 40


def test_files_are_in_the_order_of_their_numbers(spark):
    rows = [(k, f"part-{n}-x.txt", 0, 10 * k + 1, 0) for k, n in enumerate(("00007", "99999", "100000", "100001"))]
    read = spark.createDataFrame(rows, "doc_id long, file string, place long, n_tokens long, ids_crc32 long")
    assert {r.doc_id: r.start for r in token_files.global_places(read).collect()} == {0: 0, 1: 1, 2: 12, 3: 33}


def test_long_pieces_are_counted_by_chunk_maps():
    rng = random.Random(1)
    texts = ["x" * 5000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)), "ab" * 900, "é" * 700, "-" * 600 + "=" * 333, "".join(rng.choice("ACGT") for _ in range(3000)), "abc" * 70 + " x", "", "a" * 97, "b" * 160]
    library = Tokenizer.from_file(PATH)
    assert token_counts.count_texts(texts, PATH).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
