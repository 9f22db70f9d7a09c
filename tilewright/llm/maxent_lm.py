"""Language-model scoring with a hashed maximum-entropy model (operator 7).

The next token's probability has three factors:

    P(class | context) * P(slot | class, context) * P(token | slot)

There are 32 classes of 32 slots.  The most frequent tokens have a slot of
their own; the others share slots by hash, and within a slot have add-one
unigram probabilities.  Both softmax factors are log-linear in hashed features
of the context: the token before, the two tokens before, and the token before
that (a skip).  The weights have a row for each distinct context that Spark counts, as
far as the limits go: from ``ROWS`` to ``MAX_ROWS`` rows, shared by hash.

Spark counts all tokens of all training documents, and their distinct contexts by
those whose hash falls in a fixed share.  Training goes over every
training document: in each of ``ROUNDS`` rounds tasks of a bounded number of tokens
start from the shared weights, take gradient steps over their documents, and send the
rows that they have changed as blocks, so what is gathered grows with the input.
Spark's shuffle brings the blocks together; a row's mean weighs each task by what it
has seen of the row's contexts, and a tree of means keeps groups small.  Only the mean
(``MAX_ROWS`` rows a factor at most) reaches the driver.

Scoring looks counts of the ``HEAD`` most frequent tokens up in sorted arrays
of bounded size; the counts of all other tokens come from a join with the full
table of counts.

Tokens are lower-cased words and one end token for each document.  A null text
counts as empty: it has the end token alone.  A null id is not held out.
Repeated rows train and score as rows of their own.  With no training
documents every count is 0 and the model is uniform over its slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, mix64, saved, table, text_column, text_steps, words_of

CLASSES = SLOTS = 32
OWN = 15 * SLOTS  # tokens with a slot of their own
SHARED = CLASSES * SLOTS - OWN
#: Least and most rows for hashed features of each of the two factors; 16 bits number the most.
ROWS, MAX_ROWS = 1 << 14, 1 << 16
#: One in so many contexts, chosen by hash, is counted.
CONTEXT_SHARE = 64
#: Rows of a block of weights, parts of it that one group holds, and tokens that a training task takes, about.
BLOCK_ROWS, FAN, TASK_TOKENS = 1024, 64, 2_000_000
PACKED = "block int, part int, rows binary, evidence binary, weights binary"
ROUNDS, RATE, BATCH = 2, 0.25, 8192
#: Rows of gradients that are added place by place; longer runs of rows are summed one run at a time.
LONG = 16
#: Tokens whose counts are broadcast at most: two numbers each.
HEAD = 1 << 18
#: Words that one task counts before it sends the sums on.
COUNT_WORDS = 6_000_000
END_HASH, START_HASH = np.uint64(0x5EED0E0D), np.uint64(0x5EED57A7)


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of the texts, an end token after each text, and where each text begins."""
    data = [t.encode("utf-8", "replace") for t in texts]
    hashed, starts, _ = words_of(b"\n".join(data))
    owner = np.searchsorted(np.cumsum([0] + [len(d) + 1 for d in data]), starts, side="right") - 1
    n = np.bincount(owner, minlength=len(texts)) + 1
    begins = np.cumsum(n) - n
    out = np.full(int(n.sum()), END_HASH, dtype=np.uint64)
    out[np.arange(len(hashed)) + owner] = hashed
    return out, begins


def held_out(id_col: Column) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def count_tokens(docs: DataFrame) -> DataFrame:
    """Token hashes and counts over all documents, and likewise contexts of a fixed share (``context`` is true)."""

    def sums(parts: list[np.ndarray], shares: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for context, hashes in ((False, parts), (True, shares)):
            found, n = np.unique(np.concatenate(hashes), return_counts=True)
            for at in range(0, len(found), 200_000):
                part = found[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), context)), pa.array(part.view(np.int64)), pa.array(n[at : at + 200_000].astype(np.int64))], names=["context", "token", "n"])

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shares, size = [], [], 0
        for _, texts in text_steps(batches):
            tokens, begins = sequence(texts)
            features = contexts(tokens, begins).ravel()
            parts.append(tokens)
            shares.append(features[features % np.uint64(CONTEXT_SHARE) == 0])
            size += len(tokens)
            if size > COUNT_WORDS:
                yield from sums(parts, shares)
                parts, shares, size = [], [], 0
        if parts:
            yield from sums(parts, shares)

    return text_column(docs).mapInArrow(run, "context boolean, token long, n long").groupBy("context", "token").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Token statistics of bounded size, and the weights."""

    n_tokens: int
    n_distinct: int
    head: np.ndarray  # sorted hashes of frequent tokens
    head_n: np.ndarray
    own: np.ndarray  # sorted hashes of tokens with a slot of their own
    own_slot: np.ndarray
    slot_mass: np.ndarray  # log10 of what counts in a shared slot are divided by
    class_bias: np.ndarray
    slot_bias: np.ndarray
    weights: np.ndarray  # two tables of rows: for classes, for slots

    def slots(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each token, and whether it shares it."""
        slot = OWN + (tokens.view(np.int64) % SHARED)
        if not len(self.own):
            return slot, np.ones(len(tokens), dtype=bool)
        at = np.minimum(np.searchsorted(self.own, tokens), len(self.own) - 1)
        mine = self.own[at] == tokens
        return np.where(mine, self.own_slot[at], slot), ~mine


def contexts(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hashed features of each position: one token back, two together, the second alone."""
    one = np.empty_like(tokens)
    one[1:] = tokens[:-1]
    one[begins] = START_HASH
    two = np.empty_like(tokens)
    two[1:] = one[:-1]
    two[begins] = START_HASH
    features = np.stack([mix64(one + np.uint64(11)), mix64(one * np.uint64(3) + mix64(two)), mix64(two + np.uint64(23))])
    return features


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _factors(model: Model, weights: np.ndarray, features: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For classes and then slots: rows of features, probabilities, and the right answer."""
    group = slot // SLOTS
    for which, bias, answer in ((0, model.class_bias[None, :], group), (1, model.slot_bias[group], slot % SLOTS)):
        keyed = features if not which else mix64(features + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows = (keyed & np.uint64(weights.shape[1] - 1)).astype(np.int32)
        logits = weights[which].take(rows[0], axis=0)
        logits += weights[which].take(rows[1], axis=0)
        logits += weights[which].take(rows[2], axis=0)
        logits += bias
        yield rows, _softmax(logits), answer, which


def _sums(x: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the rows ``x[index[first[k] : first[k + 1]]]`` for each k."""
    sizes = np.diff(first, append=len(index))
    out = x.take(index[first], axis=0)
    short = sizes <= LONG
    for place in range(1, LONG):
        there = np.flatnonzero(short & (sizes > place))
        if not len(there):
            break
        out[there] += x.take(index[first[there] + place], axis=0)
    for k in np.flatnonzero(~short):
        out[k] = x.take(index[first[k] : first[k] + sizes[k]], axis=0).sum(axis=0)
    return out


def learn(model: Model, weights: np.ndarray, scale: np.ndarray, tokens: np.ndarray, begins: np.ndarray) -> None:
    """Gradient steps over a run of tokens; changes ``weights`` and the rows' step scales."""
    features = contexts(tokens, begins)
    slot, _ = model.slots(tokens)
    for at in range(0, len(tokens), BATCH):
        part = slice(at, at + BATCH)
        for rows, p, answer, which in _factors(model, weights, features[:, part], slot[part]):
            p[np.arange(len(answer)), answer] -= 1
            flat = rows.ravel()
            order = np.argsort(flat.astype(np.uint16), kind="stable")  # MAX_ROWS fit 16 bits, which numpy sorts by radix
            ordered = flat[order]
            first = np.flatnonzero(np.diff(ordered, prepend=-1))
            step = _sums(p, order % p.shape[0], first)
            row = ordered[first]
            scale[which][row] += np.einsum("ij,ij->i", step, step)
            weights[which][row] -= RATE * step / np.sqrt(scale[which][row] + 1e-6)[:, None]


def log10_p(model: Model, tokens: np.ndarray, begins: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """log10 of the first two factors at each position."""
    features = contexts(tokens, begins)
    out = np.empty(len(tokens))
    for at in range(0, len(tokens), BATCH):
        part = slice(at, at + BATCH)
        total = 0.0
        for _, p, answer, _ in _factors(model, model.weights, features[:, part], slot[part]):
            total = total + np.log10(np.maximum(p[np.arange(len(answer)), answer], 1e-30))
        out[part] = total
    return out


def rows_for(n_contexts: int) -> int:
    """The rows of a factor for so many contexts: a power of two within the limits."""
    return min(MAX_ROWS, max(ROWS, 1 << max(0, n_contexts - 1).bit_length()))


def statistics(counts: DataFrame, n_contexts: int = 0) -> Model:
    """What the model takes from the table of counts: sums, and the most frequent tokens; and the contexts' rows."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least count such that no more than HEAD tokens reach it, from a histogram by eighths of powers of two.
    level = F.floor(F.log2("n") * 8).cast("int")
    left, least = HEAD, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if (left := left - row["count"]) < 0:
            break
        least = row.level
    head = counts.where(level >= least).toPandas() if least is not None else None  # HEAD rows at most
    tokens = head["token"].to_numpy().view(np.uint64) if head is not None else np.zeros(0, np.uint64)
    n = head["n"].to_numpy() if head is not None else np.zeros(0, np.int64)
    by_count = np.lexsort([tokens, -n])[:OWN]
    order, own_order = np.argsort(tokens), np.argsort(tokens[by_count])
    own = tokens[by_count]
    shared = F.when(F.col("token").isin([int(t) for t in own.view(np.int64)]), None).otherwise(F.pmod("token", F.lit(SHARED)))
    slot_n, slot_v = np.zeros(SHARED), np.zeros(SHARED)
    for row in counts.groupBy(shared.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).where("slot IS NOT NULL").collect():
        slot_n[row.slot], slot_v[row.slot] = row.n, row.v
    mass = np.concatenate([np.append(n[by_count], np.zeros(OWN - len(own))), slot_n]) + 1.0
    mass = mass.reshape(CLASSES, SLOTS)
    return Model(
        int(total.n), int(total.v), tokens[order], n[order], own[own_order], own_order.astype(np.int64), np.log10(slot_n + slot_v + 1),
        np.log(mass.sum(1) / mass.sum()).astype(np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32), np.zeros((2, rows_for(n_contexts), CLASSES), dtype=np.float32),
    )


def _packed(block: int, part: int, rows: np.ndarray, evidence: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([block], pa.int32()), pa.array([part], pa.int32())]
    values += [pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.uint16), evidence.astype(np.float32), weights.astype(np.float16))]
    return pa.RecordBatch.from_arrays(values, names=["block", "part", "rows", "evidence", "weights"])


def means(blocks: DataFrame, parts: int) -> DataFrame:
    """Per block the mean of its tasks' rows, each weighed by the task's evidence for it; and the summed evidence.

    Beyond ``FAN`` tasks the means are taken in levels, so that no group holds more than ``FAN`` parts of a block.
    A task holds one group at a time, however many come to it.
    """

    @frees
    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BLOCK_ROWS, CLASSES)), np.zeros(BLOCK_ROWS)
        group = None  # rows come sorted, so one group is held at a time
        for batch in batches:
            for block, part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if group not in (None, (block, part)):
                    rows = np.flatnonzero(n)
                    yield _packed(*group, rows, n[rows], total[rows] / n[rows, None])
                    total[:], n[:] = 0, 0
                group = block, part
                rows, evidence, weights = (np.frombuffer(x, dtype=t) for x, t in zip(packed, (np.uint16, np.float32, np.float16)))
                total[rows] += weights.reshape(-1, CLASSES).astype(np.float64) * evidence[:, None]
                n[rows] += evidence
        if group is not None:
            rows = np.flatnonzero(n)
            yield _packed(*group, rows, n[rows], total[rows] / n[rows, None])

    while True:
        last = parts <= FAN
        grouped = blocks.withColumn("part", F.lit(0) if last else F.floor(F.col("part") / FAN).cast("int"))
        parts = 1 if last else -(-parts // FAN)
        blocks = grouped.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(mean, PACKED)
        if last:
            return blocks


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Rounds of gradient steps over all documents, each round over its share of them.

    A task takes about ``TASK_TOKENS`` tokens (a scan's partition at least), however large
    the cluster is, and sends the rows that it has changed.
    """
    spark = docs.sparkSession
    tasks = max(1, -(-model.n_tokens // (rounds * TASK_TOKENS)))
    n_blocks = 2 * model.weights.shape[1] // BLOCK_ROWS
    scale = np.zeros(model.weights.shape[:2], dtype=np.float32)
    for k in range(rounds):
        held = spark.sparkContext.broadcast((model, scale))

        @frees
        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start: Model
            start, before = held.value
            weights, scale, part = start.weights.copy(), before.copy(), TaskContext.get().partitionId()
            for _, texts in text_steps(batches):
                learn(start, weights, scale, *sequence(texts))
            evidence = (scale - before).reshape(-1, BLOCK_ROWS)
            for b, block in enumerate(weights.reshape(-1, BLOCK_ROWS, CLASSES)):
                rows = np.flatnonzero(evidence[b] > 0)
                if len(rows):
                    yield _packed(b, part, rows, evidence[b, rows], block[rows])

        share = text_column(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k)).coalesce(tasks)
        blocks = means(share.mapInArrow(steps, PACKED), tasks)
        weights, scale = model.weights.reshape(n_blocks, BLOCK_ROWS, CLASSES).copy(), scale.reshape(n_blocks, BLOCK_ROWS).copy()
        for row in blocks.collect():  # a row for each of n_blocks
            rows = np.frombuffer(row.rows, dtype=np.uint16)
            weights[row.block, rows] = np.frombuffer(row.weights, dtype=np.float16).reshape(-1, CLASSES)
            scale[row.block, rows] += np.frombuffer(row.evidence, dtype=np.float32) / tasks  # what one task has seen
        model, scale = Model(**{**model.__dict__, "weights": weights.reshape(model.weights.shape)}), scale.reshape(2, -1)
        held.unpersist()
    return model


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Per row: id, tokens, known tokens, base score and the model's score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, n_tokens long, n_known long, logs double, partial double, rest array<long>, shares array<int>"

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        row = TaskContext.get().partitionId() << 40
        for ids, texts in text_steps(batches):
            tokens, begins = sequence(texts)
            owner = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, len(tokens))))
            slot, shared = m.slots(tokens)
            partial = log10_p(m, tokens, begins, slot)
            partial[shared] -= m.slot_mass[slot[shared] - OWN]
            logs = np.zeros(len(tokens))
            if len(m.head):
                at = np.minimum(np.searchsorted(m.head, tokens), len(m.head) - 1)
                known = m.head[at] == tokens
                logs[known] = np.log10(m.head_n[at[known]] + 1)
            else:
                known = np.zeros(len(tokens), dtype=bool)
            partial += np.where(shared, logs, 0)
            rest = np.flatnonzero(~known)
            order = rest[np.lexsort([tokens[rest], owner[rest]])]
            new = np.flatnonzero(np.append(True, (tokens[order][1:] != tokens[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(order)])
            n = np.diff(np.append(new, len(order)))
            offsets = pa.array(np.searchsorted(owner[order][new], np.arange(len(texts) + 1)).astype(np.int32))
            total = lambda x: np.bincount(owner, weights=x, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(texts))), ids, pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int64)), pa.array(total(known).astype(np.int64)),
                    pa.array(total(logs)), pa.array(total(partial)),
                    pa.ListArray.from_arrays(offsets, pa.array(tokens[order][new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "logs", "partial", "rest", "shares"],
            )
            row += len(texts)

    rows = saved(text_column(docs).mapInArrow(run, schema), "token-scores")
    # Tokens outside the head, each with how often the document has it; all of them share slots.
    asked = rows.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "shares")).alias("t")).select("row", F.col("t.rest").alias("asked_token"), F.col("t.shares").alias("times"))
    known = asked.join(counts, F.col("asked_token") == F.col("token"))
    more = known.groupBy(F.col("row").alias("of_row")).agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unit = F.log10(F.lit(float(model.n_tokens + model.n_distinct + 1)))
    return rows.join(more, F.col("row") == F.col("of_row"), "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more_logs") - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("partial") + zero("more_logs")).alias("score"),
    )


def fit(docs: DataFrame) -> tuple[DataFrame, Model]:
    """The table of counts and the trained model of all ``docs``."""
    counted = saved(count_tokens(docs), "token-counts")
    counts = counted.where("NOT context").drop("context")
    model = statistics(counts, CONTEXT_SHARE * counted.where("context").count())
    return counts, train(docs, model) if model.n_tokens else model


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document with a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts, model = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, counts, model).withColumn("held_out", held_out(F.col("doc_id")))
