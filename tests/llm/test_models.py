"""The models' results, recomputed one by one in plain Python, and how well they do on what they did not see."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilewright.llm import additive_classifier, decontaminate, maxent_lm, perplexity_rules

from .conftest import prose

DATA = "/root/testdata/sf0.01"


def test_op2_ranks_held_out_labels(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = additive_classifier.op2_additive_classifier(spark, DATA).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.label == 1], [r.score for r in got if r.label == 0]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.label for r in got]) > 0.9


def test_op2_scores_one_by_one(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    # several labels for an id, and columns of the operator's own names
    more = labels.withColumns({"text": F.lit("x"), "label_id": F.lit(1), "score": F.lit(2)})
    more = more.unionByName(more.where("quality = 1").withColumn("quality", F.lit(0)))
    model = additive_classifier.fit(docs, more)
    assert model.tables and model.pairs
    rows = pq.read_table(f"{small}/documents.parquet").to_pylist()
    want = Counter()
    for r in rows:
        x = additive_classifier.features([r["text"] or ""])[0]
        bins = [int((e <= v).sum()) for e, v in zip(model.edges, x)]
        total = model.constant + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(t[len_(model, i, bins), len_(model, j, bins)] for i, j, t in model.pairs)
        want[r["doc_id"], round(1 / (1 + np.exp(-np.clip(total, -30, 30))), 9)] += 1
    assert Counter((r.doc_id, round(r.score, 9)) for r in additive_classifier.score(docs, model).collect()) == want
    kept = additive_classifier.keep(docs, more)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k: n for (k, s), n in want.items() if s >= 0.3})


def len_(model, feature, bins):
    return bins[feature] * additive_classifier.PAIR_BINS // len(model.tables[feature])


def test_op7_scores_one_by_one(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, prose(rng, 60)) for k in range(40)] + [(90, None), (91, "new words only")], "doc_id long, text string")
    counts, model = maxent_lm.fit(docs)
    of = {np.uint64(r.token & (2**64 - 1)): r.n for r in counts.collect()}
    assert np.any(model.weights)
    mine = dict(zip(model.own.tolist(), model.own_slot.tolist()))
    shared_n, shared_v = Counter(), Counter()
    for token, n in of.items():
        if int(token) not in mine:
            slot = int(np.int64(np.array(token).view(np.int64)) % maxent_lm.SHARED)
            shared_n[slot] += n
            shared_v[slot] += 1

    def factor(table, rows, bias, answer):
        x = sum(table[r].astype(np.float64) for r in rows) + bias
        return x[answer] - np.log(np.exp(x - x.max()).sum()) - x.max()

    got = {r.doc_id: r.score for r in maxent_lm.score(docs, counts, model).collect()}
    for row in docs.collect():
        tokens, begins = maxent_lm.sequence([row.text or ""])
        features, total = maxent_lm.contexts(tokens, begins), 0.0
        for k, token in enumerate(tokens):
            at = int(np.array(token).view(np.int64) % maxent_lm.SHARED)
            slot = mine.get(int(token), maxent_lm.OWN + at)
            group, size = slot // maxent_lm.SLOTS, model.weights.shape[1]
            total += factor(model.weights[0], [int(f) % size for f in features[:, k]], model.class_bias, group)
            keyed = maxent_lm.mix64(features[:, k] + np.uint64(group * 0x9E3779B97F4A7C15 % 2**64))
            total += factor(model.weights[1], [int(f) % size for f in keyed], model.slot_bias[group], slot % maxent_lm.SLOTS)
            if int(token) not in mine:
                total += np.log((of.get(token, 0) + 1) / (shared_n[at] + shared_v[at] + 1))
        assert got[row.doc_id] == pytest.approx(total / np.log(10), rel=1e-4)


def test_op7_means_weigh_tasks_by_what_they_saw(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "FAN", 2)
    rng = np.random.default_rng(0)
    parts = []
    for part in range(5):
        rows = np.sort(rng.choice(1024, 300, replace=False))
        parts.append((rows, rng.random(300).astype(np.float32), rng.normal(size=(300, 32)).astype(np.float16)))
    packed = [(3, k, *(bytearray(x.tobytes()) for x in (r.astype(np.uint16), e, w))) for k, (r, e, w) in enumerate(parts)]
    (got,) = maxent_lm.means(spark.createDataFrame(packed, maxent_lm.PACKED), 5).collect()
    total, n = np.zeros((1024, 32)), np.zeros(1024)
    for r, e, w in parts:
        total[r] += w * e[:, None].astype(float)
        n[r] += e
    rows = np.flatnonzero(n)
    assert np.frombuffer(got.rows, np.uint16).tolist() == rows.tolist()
    assert np.allclose(np.frombuffer(got.weights, np.float16).reshape(-1, 32), total[rows] / n[rows, None], atol=0.01)
    assert np.allclose(np.frombuffer(got.evidence, np.float32), n[rows], rtol=1e-5)


def test_op8_verdicts_follow_the_bands(spark):
    rng = random.Random(4)
    mixed = lambda t: "".join(rng.sample(t, len(t)))
    texts = [prose(rng, 120) for _ in range(120)]
    noise, endless = [mixed(texts[k]) for k in range(5)], ["aaaa aaab aaac aaad aaae aaaf aaag " * 12 + f"aaah{k} " * 9 for k in range(3)]
    rows = [(k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts + noise + endless)]
    got = {r.doc_id: r for r in perplexity_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    passing = [r for r in got.values() if not r.base_failed]
    lower = lambda x, q: sorted(x)[max(0, int(np.ceil(q * len(x))) - 1)]
    middle = {g: lower([r.surprise for r in passing if r.lang == g], 0.5) for g in ("en", "fr")}
    robust = lambda x: (lower(x, 0.75) - lower(x, 0.25)) / 1.349
    common = robust([r.surprise - middle[r.lang] for r in passing])
    for g in ("en", "fr"):
        own = [r.surprise for r in passing if r.lang == g]
        spread = max(0.03, (len(own) * robust(own) + 20 * common) / (len(own) + 20))
        for r in got.values():
            if r.lang == g:
                assert r.kept == (not r.base_failed and abs(r.surprise - middle[g]) <= 6 * spread)
    assert all(got[k].kept for k in range(120)) and not any(got[k].kept for k in range(120, 128))


def test_op10_against_all_pairs(spark):
    rng = random.Random(9)
    items = [prose(rng, n).replace("\n", " ") for n in (8, 15, 30, 60, 25, 40)]

    def edited(text, share):
        out = []
        for w in text.split():
            kind = rng.random()
            if kind < share / 3:
                continue
            out.append("other" if kind < 2 * share / 3 else w)
            if kind > 1 - share / 3:
                out.append("more")
        return " ".join(out)

    texts = [prose(rng, 40) + " " + edited(rng.choice(items), share) + " " + prose(rng, 40) for share in (0, 0.1, 0.2, 0.3, 0.5) for _ in range(16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id int, score string")
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a = decontaminate.words(item)
            score = decontaminate.align(a, decontaminate.words(text))[0] / (2 * len(a))
            if score >= decontaminate.THRESHOLD:
                want[d, i] = score
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, bench).collect()}
    assert len(want) > 60 and all(got[k] == pytest.approx(want[k]) for k in got if k in want) and set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)


def test_op10_null_and_repeated_ids(spark):
    item = "seven silver letters crossed the winter harbour before morning"
    text = "it says: " + item + " again"
    docs = spark.createDataFrame([(0, text), (None, text), (None, text), (1, "clean words"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == Counter([(0, 7), (0, None), (None, 7), (None, None)])
    assert Counter(r.doc_id for r in decontaminate.keep(docs, bench).collect()) == Counter([1, 2])




def test_op7_means_in_levels(spark, monkeypatch):
    """Groups that share a task, and levels of groups, give each row's weighed mean."""
    rng = np.random.default_rng(5)
    rows, total, n = [], np.zeros((3, maxent_lm.BLOCK_ROWS, maxent_lm.CLASSES)), np.zeros((3, maxent_lm.BLOCK_ROWS))
    for part in range(9):
        for block in range(3):
            of = np.sort(rng.choice(maxent_lm.BLOCK_ROWS, 40, replace=False))
            evidence, weights = rng.integers(1, 9, 40).astype(np.float32), rng.normal(size=(40, maxent_lm.CLASSES)).astype(np.float16)
            rows.append((block, part, of.astype(np.uint16).tobytes(), evidence.tobytes(), weights.tobytes()))
            total[block, of] += weights.astype(np.float64) * evidence[:, None]
            n[block, of] += evidence
    monkeypatch.setattr(maxent_lm, "FAN", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = maxent_lm.means(spark.createDataFrame(rows, maxent_lm.PACKED), 9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.block for r in got) == [0, 1, 2]
    for r in got:
        of = np.frombuffer(r.rows, np.uint16)
        assert of.tolist() == np.flatnonzero(n[r.block]).tolist()
        assert np.allclose(np.frombuffer(r.evidence, np.float32), n[r.block, of])
        assert np.allclose(np.frombuffer(r.weights, np.float16).reshape(-1, maxent_lm.CLASSES), total[r.block, of] / n[r.block, of, None], atol=0.01)
