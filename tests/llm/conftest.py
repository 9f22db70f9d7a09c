"""A small directory of tables with every awkward case, and an empty one."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and in to a is that river stone light under over before after green slow quick paper window garden winter morning letter bridge market silver copper village harbour".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]))
        if k % 11 == 10:
            out[-1] += ".\n" if k % 33 == 32 else "."
    return " ".join(out)


def documents() -> list[dict]:
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(60)]
    rows = list(texts)
    for k in range(12):  # near copies: one or two words changed
        words = texts[k].split(" ")
        for _ in range(1 + k % 2):
            words[rng.randrange(len(words))] = "changed"
        rows.append(" ".join(words))
    rows += [texts[20]] * 4 + [texts[21].upper()]  # exact copies, and one up to case
    rows += [" ".join(t + rng.choice(["$$$", "%%%", "***"]) for t in prose(rng, 80).split()) for _ in range(8)]  # junk
    rows += ["Und " * 70, prose(rng, 4000), "x" * 30_000, "one", "two words", "", "  \n\t ", None, "it's they're 'll\x1c<|endoftext|> naïve 日本語 ½ 　  end", "é" * 70]
    rows.append(texts[30] + " " + QUOTED)
    rows.append(texts[31] + " " + QUOTED.replace("harbour", "port").replace("silver ", ""))
    out = [{"doc_id": k * 3 - 5, "text": t, "lang": ["en", "fr", None][k % 3] if k % 7 else "en", "source": "s", "n_chars": len(t or "")} for k, t in enumerate(rows)]
    out.append(dict(out[3]))  # a repeated row
    out.append(dict(out[4], doc_id=None))  # without an id
    for row in out:  # names that the operators use themselves
        row |= {"node": 1, "key": "k", "score": None, "seed": 2, "text_hash": "h", "base_failed": "no", "token": 3, "gone_id": 1}
    return out


QUOTED = "Seven silver letters crossed the winter harbour before morning; paper windows under copper bridges answered slowly."

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("node", pa.int64()), ("key", pa.string()), ("score", pa.float64()), ("seed", pa.int64()), ("text_hash", pa.string()), ("base_failed", pa.string()), ("token", pa.int64()), ("gone_id", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("size", pa.string()), ("block", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
BENCH = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def write(path, rows, schema):
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), path)


def pages() -> list[dict]:
    big, small = "<p>" + "same page " * 200, "<p>short"
    html = [big, small, big, small, big, None, "", "é" * 600, "é" * 600, "x\r\n\r\nWARC/1.1\r\n" * 100, "a" * 1000, "a" * 1000, "a" * 999, "a" * 999]
    urls = [
        "http://A.Example.com/en/7?x=1", "https://example.com/en/81#f", "no scheme", None, "http://net/de/1", "http://b.example.net/de/81/", "http://org/es/", "http://xorg/es/", "://h/p",
        "http://www.ads-track.example.com/a/?utm_source=feed&b=2&a=1", "http://ads-track.example.com/a?a=1&b=2", "http://m.ads-track.org:80/q\n q?c=1", "http://example.org/en?://x", "http://",
    ]
    rows = [{"page_id": k * 2 + 1, "url": u, "html": h} for k, (u, h) in enumerate(zip(urls, html))]
    rows.append(dict(rows[0]))
    rows += [dict(rows[2], url="http://other.test/"), dict(rows[2], page_id=None), dict(rows[2], page_id=None)]
    for r in rows:
        r |= {"size": "s", "block": "b"}
    return rows


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    path = tmp_path_factory.mktemp("small")
    docs = documents()
    write(path / "documents.parquet", docs, DOCS)
    write(path / "pages.parquet", pages(), PAGES)
    marks = [{"doc_id": d["doc_id"], "quality": 0 if d["text"] and any(c in d["text"] for c in "$%*") else 1, "toxic": 0} for d in docs if d["text"] and d["doc_id"] is not None]
    write(path / "labels.parquet", marks + [{"doc_id": None, "quality": 1, "toxic": 0}, {"doc_id": 4, "quality": None, "toxic": None}], LABELS)
    write(path / "benchmark.parquet", [{"item_id": 7, "text": QUOTED}, {"item_id": 8, "text": None}, {"item_id": 9, "text": "unheard words"}, {"item_id": 10, "text": QUOTED}], BENCH)
    return str(path)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("pages", PAGES), ("labels", LABELS), ("benchmark", BENCH)):
        write(path / f"{name}.parquet", [], schema)
    return str(path)
