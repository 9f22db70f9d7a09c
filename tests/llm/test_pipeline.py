"""The pipeline against a stage-by-stage account in plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tilewright.llm import additive_classifier, decontaminate, perplexity_rules

from .test_texts import GAP, brute_components, rows_of


def test_pipeline(spark, small, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = rows_of(small)
    same = lambda r: (r["doc_id"], r["text"])
    words = lambda r: re.findall(GAP, r["text"])
    verdict = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in perplexity_rules.verdicts(docs).collect()}
    rows = [r for r in rows if r["text"] and verdict[r["doc_id"], len(words(r)), sum(map(len, words(r)))]]
    assert 40 < len(rows) < len(rows_of(small))
    left = spark.createDataFrame([same(r) for r in rows], "doc_id long, text string")
    model = additive_classifier.fit(left, labels)
    rows = [r for r in rows if model.scores(additive_classifier.features([r["text"]]))[0] >= 0.3]
    # one row of each component: that of the least id
    names = {}
    for doc_id, _, component in brute_components(rows, 5, 80):
        names[doc_id] = component
    rows = list({names[r["doc_id"]]: r for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0), reverse=True)}.values())
    bench = [decontaminate.words(t) for t in spark.read.parquet(f"{small}/benchmark.parquet").where("text IS NOT NULL").toPandas()["text"]]
    rows = [r for r in rows if all(decontaminate.align(b, decontaminate.words(r["text"]))[0] < len(b) for b in bench)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == want and len(want) > 30
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_keep_the_columns(spark, small, empty):
    for path in (small, empty):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.dtypes == docs.dtypes
            assert path == small or out.count() == 0
