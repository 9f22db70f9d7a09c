"""Operators 11 and 12 against plain Python integers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilewright.llm import histogram_topk, sort_means

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("cluster", pa.string()), ("score", pa.string()), ("n", pa.int64())])


def vectors() -> list[dict]:
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 0.2, (5, 64))
    out = [(k, (middles[k % 5] + rng.normal(0, 0.05, 64)).tolist()) for k in range(260)]
    out += [(300 + k, out[7][1]) for k in range(40)]  # many ties
    out += [(50, out[50][1]), (50, out[51][1]), (7, out[7][1]), (7, out[7][1])]  # repeated rows, and an id with two vectors
    out += [(None, out[3][1]), (None, out[7][1]), (400, None), (450, []), (500, []), (401, [1.0] * 63), (402, [0.5] * 63 + [None]), (403, [math.nan] + [0.1] * 63), (404, [math.inf] + [0.1] * 63)]
    out += [(600, [0.25] * 3), (601, [0.25] * 3), (602, [-0.001] * 3), (603, [0.0] * 64)]
    return [{"vec_id": i, "embedding": v, "label": 1, "cluster": "c", "score": "s", "n": 1} for i, v in out]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = tmp_path_factory.mktemp("vectors")
    for name, rows in (("some", vectors()), ("few", vectors()[:3]), ("none", []), ("bad", [{"vec_id": 50, "embedding": None}])):
        (path / name).mkdir()
        pq.write_table(pa.Table.from_pylist(rows, schema=SCHEMA), path / name / "embeddings.parquet", row_group_size=50)
    return path


def integers(path, scale):
    """(vec_id, integer components) of the vectors that take part, from what is stored."""
    rows = pq.read_table(f"{path}/embeddings.parquet").to_pylist()
    whole = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    return [(i, [math.floor(scale * float(x)) for x in v]) for i, v in whole]


def brute_means(rows):
    rows = [(i, v) for i, v in rows if len(v) == 64]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in rows if i is not None)
    places = [v for _, _, v in named[:8]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(11):
        found = [min((apart(v, c), k) for k, c in enumerate(places)) for _, v in rows]
        if r < 10:
            for k in range(len(places)):
                mine = [v for (_, v), (_, a) in zip(rows, found) if a == k]
                if mine:
                    places[k] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _), (d, k) in zip(rows, found))


@pytest.mark.parametrize("name", ["some", "few"])
def test_op11(spark, tables, name):
    got = sort_means.op11_sort_means(spark, str(tables / name))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_means(integers(tables / name, 1024))


@pytest.mark.parametrize("name", ["none", "bad"])
def test_op11_and_op12_without_vectors(spark, tables, name):
    assert sort_means.op11_sort_means(spark, str(tables / name)).collect() == []
    assert histogram_topk.op12_histogram_topk(spark, str(tables / name)).collect() == []


def test_scan_is_exact_with_ties_and_stops_early():
    rng = np.random.default_rng(1)
    places = rng.integers(-3, 4, (6, 4))
    places[4] = places[1]  # two centroids in one place
    x = rng.integers(-4, 5, (4000, 4))
    every = ((x[:, None] - places[None]) ** 2).sum(axis=2)
    for before in (np.zeros(len(x), dtype=np.int64), rng.integers(0, 6, len(x))):
        cluster, distance = sort_means.Centroids(places).nearest(x, before)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    far = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    held = sort_means.Centroids(far)
    held.nearest(far.repeat(50, axis=0) + 3, np.arange(4).repeat(50))
    assert held.looked_at == 200  # each looked only at its own


def test_a_component_beyond_the_bound_is_an_error(spark):
    big = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds"):
        sort_means.cluster(big)


def brute_top(rows, k, is_query):
    out = Counter()
    for q, (i, v) in enumerate(rows):
        if i is not None and is_query(i):
            scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w in rows if j != i and len(w) == len(v)]
            for rank, (s, unknown, j) in enumerate(sorted(scored)[:k], start=1):
                out[i, rank, None if unknown else j, -s] += 1
    return out


@pytest.mark.parametrize(("block", "bins", "few"), [(16_384, 256, 64), (3, 4, 0)])
def test_op12(spark, tables, monkeypatch, block, bins, few):
    for name, value in (("BLOCK", block), ("BINS", bins), ("FEW", few), ("TILE_QUERIES", 2), ("TILE_ROWS", 7), ("HELD", 20)):
        monkeypatch.setattr(histogram_topk, name, value)
    got = histogram_topk.op12_histogram_topk(spark, str(tables / "some"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_top(integers(tables / "some", 256), 5, lambda i: i % 50 == 0)


def test_op12_scores_over_a_refined_range_are_counted_once(spark, tmp_path):
    # close vectors: more than FEW scores in the bin of the k-th, and some just above that bin
    rng = np.random.default_rng(0)
    middles = rng.normal(0, 1, (8, 64))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    rows = [{"vec_id": k, "embedding": (middles[k % 8] + rng.normal(0, 0.003, 64)).tolist(), "label": 1, "cluster": "c", "score": "s", "n": 1} for k in range(4000)]
    pq.write_table(pa.Table.from_pylist(rows, schema=SCHEMA), tmp_path / "embeddings.parquet")
    got = histogram_topk.op12_histogram_topk(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == brute_top(integers(tmp_path, 256), 5, lambda i: i % 50 == 0)


def test_op12_every_row_a_query_and_more_wanted_than_there_are(spark, tables):
    rows = spark.read.parquet(str(tables / "some" / "embeddings.parquet"))
    got = histogram_topk.top_k(rows, F.col("vec_id") >= 255, k=1000)
    assert Counter(map(tuple, got.collect())) == brute_top(integers(tables / "some", 256), 1000, lambda i: i >= 255)


@pytest.mark.parametrize("size", [100, 50_000, 2**30])
def test_products_are_exact_at_every_size(size):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-size, size, (6, 3)).astype(np.float64) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert histogram_topk.product(a, b).tolist() == want
