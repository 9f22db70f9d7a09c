"""Operator 13 against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tilewright.llm import collocations

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("gram", pa.string()), ("k", pa.int64()), ("salt", pa.int64())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, best):
    n, f = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r["text"] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(la == lang and len(q) > len(p) and inside(q) and 100 * b >= 100 * a for (la, q), b in cand.items()):
            continue
        score, _, x, y = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), x, y))
    rows, rank = [], Counter()
    for lang, score, a, phrase, x, y in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            rows.append((lang, rank[lang], phrase.decode(), -a, x, y, n[lang], -score))
    return rows


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    rng = random.Random(8)
    words = ["the", "of", "naïve", "日本", "x", "Silver", "\x1cmark", "río"]
    out = []
    for k in range(1600):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if k % 3 == 0:
            parts += ["Over", "the", "green", "hill", "far", "away"]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", " \t ", ", ", ".\n", "\r\n", "\x0b", " ; "] if k % 2 else [" "]) for p in parts)
        out.append({"text": text, "lang": [None, "en", "fr", "und", ""][k % 5]})
    out += [{"text": None, "lang": "en"}, {"text": "", "lang": None}, {"text": " .,\n ", "lang": "de"}, {"text": "a " * 3000, "lang": "en"}, {"text": "w" * 50_000, "lang": "en"}, out[1], out[1]]
    path = tmp_path_factory.mktemp("collocations")
    for name, rows in (("some", out), ("none", [])):
        (path / name).mkdir()
        rows = [{"doc_id": k, "phrase": "p", "n": 1, "gram": "g", "k": 2, "salt": 3} | r for k, r in enumerate(rows)]
        pq.write_table(pa.Table.from_pylist(rows, schema=SCHEMA), path / name / "documents.parquet", row_group_size=97)
    return path


def test_op13(spark, texts):
    got = collocations.op13_collocations(spark, str(texts / "some"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = pq.read_table(texts / "some" / "documents.parquet").to_pylist()
    want = brute(rows, 100, 5, 2000)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5
    assert collocations.op13_collocations(spark, str(texts / "none")).collect() == []


def test_op13_beyond_the_broadcast_bounds(spark, texts, monkeypatch):
    for name, value in (("MAX_BROADCAST", 3), ("MAP_BITS", 128), ("MAX_LOOKUP", 1), ("COUNT_BYTES", 500), ("HASH_BITS", 9)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.read.parquet(str(texts / "some" / "documents.parquet"))
    rows = pq.read_table(texts / "some" / "documents.parquet").to_pylist()
    assert sorted(map(tuple, collocations.phrases(docs, 20, 4, 30).collect())) == sorted(brute(rows, 20, 4, 30))


def test_op13_counts_only_what_two_frequent_parts_allow(spark, texts):
    docs = spark.read.parquet(str(texts / "some" / "documents.parquet"))
    rows = pq.read_table(texts / "some" / "documents.parquet").to_pylist()
    words = {(r.lang, r.phrase) for r in collocations.counted_words(docs).where("n >= 800 AND phrase IS NOT NULL").collect()}
    pairs = Counter()
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r["text"] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if r["lang"] is None else r["lang"]
            pairs.update((lang, a, b) for a, b in zip(w, w[1:]) if {(lang, a), (lang, b)} <= words)
    known = collocations.frequent(collocations.counted_words(docs).where("n >= 800 AND phrase IS NOT NULL"))
    assert sorted(r.n for r in collocations.counted(docs, 2, known).collect()) == sorted(pairs.values()) and len(pairs) > 5


def test_op13_scores_pass_64_bits(spark):
    a, n, l, r = 10**12 + 7, 10**15 + 1, 10**13 + 9, 10**12 + 11
    assert spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(collocations.SCORE).first()[0] == 1000 * a * n // (l * r)
