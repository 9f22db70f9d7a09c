"""Quality classifier: a generalised additive model with pairwise interactions (operator 2).

A text becomes a row of shape features.  Each feature is cut into quantile bins
and learns a table with one value per bin: cyclic boosting visits the features
in turn, fits a shallow tree to the gradient summed by bin, and adds a fraction
of its leaves to the table.  The pairs of features that explain most of what is
left get two-dimensional tables in the same way.  A score is the sigmoid of a
constant plus one look-up per feature and pair, for all rows of a batch at once.

The model is fitted on at most ``MAX_TRAIN`` labelled documents, those with the
smallest hash of their id; scoring covers every document.  Labels, language,
source and id are no features.

A null text counts as empty and is scored like any other; documents without a
label are only scored; a label outside 0 and 1 or a null one is ignored, and of
several labels for an id the larger counts.  With no labels of both kinds every
score is the share of label 1 (0.5 with none).  Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, table, text_column, text_steps, with_text_columns, words_of
from .perplexity_rules import base_counts

#: Labelled documents that the fit takes at most.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.1, 1.0
THRESHOLD = 0.3
FEATURES = [
    "log_words", "word_length", "symbols", "capitals", "digits", "punctuation", "distinct_words", "repeated_words", "repeated_lines",
    "line_words", "bars", "exclamations", "spaces", "not_ascii", "longest_run", "letter_entropy", "full_stops", "longest_word",
]


def features(texts: list[str]) -> np.ndarray:
    """The shape features of each text, one row each."""
    n = len(texts)
    base = base_counts(texts)
    data = [t.encode("utf-8", "replace") for t in texts]
    byte = np.stack([np.bincount(np.frombuffer(d, dtype=np.uint8), minlength=256) for d in data]).astype(np.float64) if n else np.zeros((0, 256))
    hashed, starts, ends = words_of(b"\n".join(data), lower=False)
    owner = np.searchsorted(np.cumsum([0] + [len(d) + 1 for d in data]), starts, side="right") - 1
    distinct = np.unique(np.stack([owner.astype(np.uint64), hashed]), axis=1)[0].astype(np.int64) if len(hashed) else np.zeros(0, np.int64)
    same = np.append(False, (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])) if len(hashed) else np.zeros(0, bool)
    run = np.zeros(n)
    if same.any():
        index = np.arange(len(same))
        since = index - np.maximum.accumulate(np.where(same, 0, index))
        np.maximum.at(run, owner, since)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, ends - starts)
    words = np.maximum(base["n_words"], 1).astype(np.float64)
    size = np.maximum(byte.sum(1), 1)
    upper, lower, digit = byte[:, 65:91].sum(1), byte[:, 97:123].sum(1), byte[:, 48:58].sum(1)
    gap = byte[:, 9:14].sum(1) + byte[:, 32]
    high = byte[:, 128:].sum(1)
    folded = byte[:, 97:123] + byte[:, 65:91]
    share = folded / np.maximum(folded.sum(1, keepdims=True), 1)
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    lines = byte[:, 10] + 1
    return np.column_stack(
        [
            np.log1p(base["n_words"]), base["word_chars"] / words, base["n_symbols"] / words, upper / np.maximum(upper + lower, 1), digit / size,
            (size - upper - lower - digit - gap - high) / size, np.bincount(distinct, minlength=n) / words, base["n_repeat_words"] / words, base["n_dup_lines"] / lines,
            np.log1p(words / lines), byte[:, 124] / words, byte[:, 33] / words, gap / size, high / size, run / words, entropy, byte[:, 46] / words, np.log1p(longest),
        ]
    )


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over ordered bins with gradient sums ``g`` and curvature sums ``h``."""

    def cut(a: int, b: int) -> int | None:
        if b - a < 2:
            return None
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left, right = gs[:-1] ** 2 / (hs[:-1] + RIDGE), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE)
        return a + 1 + int(np.argmax(left + right))

    edges = {0, len(g)}
    if middle := cut(0, len(g)):
        edges |= {middle, cut(0, middle) or 0, cut(middle, len(g)) or len(g)}
    out = np.empty(len(g))
    for a, b in zip(sorted(edges), sorted(edges)[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _leaves_2d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that cuts the first axis once and each part's second axis once."""
    gs, hs = np.cumsum(g.sum(1)), np.cumsum(h.sum(1))
    at = 1 + int(np.argmax(gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE)))
    out = np.empty_like(g)
    for rows in (slice(0, at), slice(at, None)):
        gr, hr = g[rows].sum(0), h[rows].sum(0)
        gs, hs = np.cumsum(gr), np.cumsum(hr)
        to = 1 + int(np.argmax(gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE)))
        for columns in (slice(0, to), slice(to, None)):
            out[rows, columns] = gr[columns].sum() / (hr[columns].sum() + RIDGE)
    return out


@dataclass
class Additive:
    """The constant, the bins' edges, and the tables of features and pairs."""

    constant: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        bins = self.bins(x) if self.edges else []
        for b, t in zip(bins, self.tables):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits the tables by cyclic boosting."""
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    model = Additive(float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    bins = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables):
            g, h = slopes()
            step = RATE * _leaves(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += step
            total += step[b]
    model.coarse = [(np.arange(len(t)) * PAIR_BINS // len(t)) for t in model.tables]
    small = [c[b] for c, b in zip(model.coarse, bins)]
    g, h = slopes()
    gains = []
    sums = lambda i, j, w: np.bincount(small[i] * PAIR_BINS + small[j], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    for i in range(len(bins)):
        for j in range(i):
            gains.append((float((sums(i, j, g) ** 2 / (sums(i, j, h) + RIDGE)).sum()), i, j))
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = RATE * _leaves_2d(sums(i, j, g), sums(i, j, h))
            t += step
            total += step[small[i], small[j]]
    return model


def held_out(id_col: Column) -> Column:
    """Whether a document's label is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Additive:
    """Fits on at most ``max_train`` labelled documents that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = chosen.select(F.col("doc_id").alias("label_id"), "quality")

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, quality = 0, batch.column(2)
            for ids, texts in text_steps(iter([batch])):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([ids, quality.slice(at, len(ids)), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])
                at += len(ids)

    # ``chosen`` has at most ``max_train`` rows of two numbers, so it is broadcast.
    rows = text_column(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_train).toPandas()
    if not len(found):
        return Additive()
    return boost(np.stack(found["x"].to_numpy()), found["quality"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """Per row of ``docs``: id and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_steps(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(held.value.scores(features(texts)))], names=["doc_id", "score"])

    return text_column(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    name = "quality_score"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    scored = with_text_columns(docs, lambda texts: [pa.array(held.value.scores(features(texts)))], f"{name} double")
    return scored.where(F.col(name) >= threshold).drop(name)


def op2_additive_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's quality."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
