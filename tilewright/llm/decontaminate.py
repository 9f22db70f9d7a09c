"""Benchmark decontamination: n-gram seeds, then local alignment (operator 10).

* Texts and test items are lower-cased and cut into words at white space and
  ASCII punctuation.  An item's seeds are its three-word sequences (all its
  words, if it has fewer).
* One scan cuts the passages around seeds out of the documents: a passage reaches
  as far as an alignment of the threshold can, and near ones are one.  They are
  written to the shared folder; all later steps read them, not the texts.
* Spark counts the passages of each seed.  Rare seeds are the keys of a join of
  passages with items.  A seed is rare if its key makes at most a thousandth of the
  join's rows (``MIN_KEY`` of them at least, ``MAX_KEY`` at most), so no key is hot.
* Frequent seeds are no keys: the tasks hold the items, and look these seeds up where
  they stand.  So every seed counts, and a copy with any intact seed is found whatever
  else quotes the item.
* A pair goes on if the passage has enough of the item's words to reach the
  threshold by matches alone.
* A Smith-Waterman alignment of the words scores what is left: a match counts 2,
  a substitution -1, a gap -1, over twice the item's words.  So edited and
  paraphrased copies score by what they keep.  Pairs of ``THRESHOLD`` or more are
  leaks.  A task aligns the same passage and item once.

A copy without one intact seed is not looked for.  The items travel to the tasks
in arrays of about ``MAX_SEEDS`` seeds at a time; a larger benchmark takes
several passes over the documents.

Null and empty texts and items leak nothing.  Repeated documents give the same
pairs; a pair is returned once for each id and distinct text.  Repeated items
count as items of their own.  Null ids stay null.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, mix64, saved, table, text_steps, without, words_of

GRAM = 3
THRESHOLD = 0.5
MAX_SEEDS = 4_000_000
#: Rows of the join with items that one seed makes at most: SHARE of all, within these bounds.
SHARE, MIN_KEY, MAX_KEY = 0.001, 1_000, 200_000
#: Words of items that are looked up at once, and alignments that a task remembers.
LOOKUP, REMEMBERED = 1_000_000, 50_000
#: Pairs whose ids are broadcast at most.
MAX_BROADCAST = 1_000_000
_SPACED = bytes(0x20 if chr(b) in string.punctuation else b for b in range(256))


def words(text: str) -> np.ndarray:
    """The hashes of a text's words."""
    return words_of(text.lower().encode("utf-8", "replace").translate(_SPACED), lower=False)[0]


def grams(found: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all ``n``-word sequences."""
    if len(found) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(found) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + found[k : k + len(out)])
    return out


def item_seeds(items: DataFrame) -> DataFrame:
    """Per item: its words' hashes, and the seed at each position with its length."""
    schema = "item_id long, item binary, n_words int, gram int, seeds array<long>"

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_steps(batches):
            found = [words(t) for t in texts]
            sizes = [min(GRAM, len(w)) for w in found]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([w.tobytes() for w in found], pa.binary()), pa.array(map(len, found), pa.int32()), pa.array(sizes, pa.int32()),
                    pa.array([grams(w, n).view(np.int64) if n else [] for w, n in zip(found, sizes)], pa.list_(pa.int64())),
                ],
                names=["item_id", "item", "n_words", "gram", "seeds"],
            )

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema).where("n_words > 0")


def _hits(texts: list[str], seeds: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with seeds: its number, words, and the places and numbers of the seeds in it."""
    data = [t.lower().encode("utf-8", "replace").translate(_SPACED) for t in texts]
    found, starts, _ = words_of(b"\n".join(data), lower=False)
    owner = np.searchsorted(np.cumsum([0] + [len(d) + 1 for d in data]), starts, side="right") - 1
    places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in sizes:
        each = grams(found, n)
        if not len(each):
            continue
        at = np.minimum(np.searchsorted(seeds, each), len(seeds) - 1)
        hit = np.flatnonzero((seeds[at] == each) & (owner[: len(each)] == owner[n - 1 :]))
        places.append(hit)
        numbers.append(at[hit])
    place, number = np.concatenate(places), np.concatenate(numbers)
    order = np.argsort(place, kind="stable")
    place, number = place[order], number[order]
    of = owner[place]
    border = np.flatnonzero(np.diff(of, prepend=-1))
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(border, np.append(border[1:], len(of))):
        k = int(of[a])
        yield k, found[begin[k] : begin[k + 1]], place[a:b] - begin[k], number[a:b]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


@dataclass
class Items:
    """Distinct items in flat arrays: item k's words and seeds lie between their begins k and k + 1."""

    words: np.ndarray
    word_begin: np.ndarray
    seeds: np.ndarray  # sorted, distinct
    of_item: np.ndarray  # the numbers of each item's seeds
    item_begin: np.ndarray
    of_seed: np.ndarray  # the items of each seed
    seed_begin: np.ndarray
    reach: np.ndarray  # how far from each seed an alignment of the threshold can lie
    keys: np.ndarray  # sorted hashes of the items that the join names them by
    of_key: np.ndarray  # the item of each key
    ids: list[list[int | None]]  # the ids that share the item

    def item(self, k: int) -> np.ndarray:
        return self.words[self.word_begin[k] : self.word_begin[k + 1]]

    def with_seeds(self, numbers: np.ndarray) -> np.ndarray:
        """The items that have any of the seeds."""
        return np.unique(np.concatenate([self.of_seed[self.seed_begin[n] : self.seed_begin[n + 1]] for n in numbers.tolist()]))

    def with_keys(self, keys: np.ndarray) -> np.ndarray:
        """The items of the given hashes."""
        begin, end = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        return np.concatenate([self.of_key[a:b] for a, b in zip(begin, end)])

    def worded(self, items: np.ndarray, found: np.ndarray, threshold: float) -> np.ndarray:
        """Those of the items so many of whose words are in ``found`` that matches alone reach the threshold."""
        there, out = np.unique(found), []
        size = self.word_begin[items + 1] - self.word_begin[items]
        total = np.cumsum(size)
        at = 0
        while at < len(items):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOOKUP, side="right")))
            begin = np.cumsum(size[at:to]) - size[at:to]
            word = self.words[np.arange(size[at:to].sum()) + np.repeat(self.word_begin[items[at:to]] - begin, size[at:to])]
            known = there[np.minimum(np.searchsorted(there, word), len(there) - 1)] == word
            out.append(items[at:to][np.add.reduceat(known.astype(np.int64), begin) >= threshold * size[at:to]])
            at = to
        return np.concatenate(out)


def gathered(prepared: DataFrame, threshold: float = THRESHOLD) -> Items:
    """The items of one pass: about ``MAX_SEEDS`` seeds."""
    rows = prepared.groupBy("item").agg(F.collect_list(F.struct("item_id")).alias("ids"), F.first("seeds").alias("seeds"), F.xxhash64("item").alias("key")).toArrow()
    words_ = [np.frombuffer(w.as_buffer(), dtype=np.uint64) for w in rows["item"]]
    seeds = [np.asarray(x.values.to_numpy(), dtype=np.int64).view(np.uint64) for x in rows["seeds"]]
    begins = lambda parts: np.cumsum([0, *map(len, parts)])
    distinct, number = np.unique(np.concatenate(seeds), return_inverse=True)
    owner = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
    pairs = np.unique(np.stack([number, owner]), axis=1)
    seed_begin, keys = np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), rows["key"].to_numpy()
    reach = np.maximum.reduceat(reach_of(np.array([len(w) for w in words_]), threshold)[pairs[1]], seed_begin[:-1])
    order = np.argsort(keys, kind="stable")
    return Items(
        np.concatenate(words_), begins(words_), distinct, number, begins(seeds), pairs[1], seed_begin, reach, keys[order], order, [[x["item_id"] for x in ids] for ids in rows["ids"].to_pylist()]
    )


def reach_of(n_words: np.ndarray, threshold: float) -> np.ndarray:
    """So many matches and insertions of items of so many words that the score is still the threshold."""
    return (n_words * max(1, 3 - 2 * threshold)).astype(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and where in the passage it ends."""
    gaps = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, 2, -1))
        row = np.maximum.accumulate(new + gaps) - gaps
        k = int(np.argmax(row))
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def found_in(items: Items, ks: np.ndarray, found: np.ndarray, places: np.ndarray, numbers: np.ndarray, threshold: float, known: dict) -> Iterator[tuple[int, float, int, int]]:
    """Those of the items ``ks`` that leak into a passage's words, given the places of seeds: item, score, first and last word."""
    for k in items.worded(ks, found, threshold).tolist():
        item, own = items.item(k), places[np.isin(numbers, items.of_item[items.item_begin[k] : items.item_begin[k + 1]])]
        reach, results = int(reach_of(np.array(len(item)), threshold)), []
        cut = np.flatnonzero(np.diff(own) > 2 * reach) + 1
        for first, last in zip(own[np.append(0, cut)].tolist(), own[np.append(cut - 1, -1)].tolist()):
            start = max(0, first - reach)
            passage = found[start : last + GRAM + reach]
            if np.isin(item, passage).sum() < threshold * len(item):
                continue
            key = k, blake2b(passage.tobytes(), digest_size=16).digest()
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                best, end = align(item, passage)
                known[key] = best, end, align(item[::-1], passage[:end][::-1])[1]
            best, end, back = known[key]
            results.append((best / (2 * len(item)), start + end - back, start + end - 1))
        if results and max(results)[0] >= threshold:
            yield k, *max(results)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents and items: doc_id, text_hash, item_id, score, first_word, last_word."""
    prepared = saved(item_seeds(items), "items")
    shape = prepared.agg(F.collect_set("gram").alias("sizes"), F.coalesce(F.sum(F.size("seeds")), F.lit(0)).alias("n")).first()
    parts = max(1, -(-shape.n // MAX_SEEDS))
    pairs = [_leaks(docs, prepared.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k), sorted(shape.sizes), threshold) for k in range(parts)]
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out


def passages(docs: DataFrame, held: Broadcast[Items], sizes: list[int]) -> DataFrame:
    """The passages around seeds: doc_id, text_hash, start (a word's place), words (hashes), seeds and their places in the passage."""
    schema = "doc_id long, text_hash long, start long, words binary, seeds array<long>, places array<int>"

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        for batch in batches:
            at = 0
            for ids, texts in text_steps(iter([batch])):
                ids_, hashes, rows = ids.to_pylist(), batch.column(2).slice(at, len(ids)).to_pylist(), []
                at += len(ids)
                for n, found, places, numbers in _hits(texts, of.seeds, sizes):
                    low = places - of.reach[numbers]
                    order = np.argsort(low, kind="stable")
                    low, places, numbers = low[order], places[order], numbers[order]
                    high = np.maximum.accumulate(places + GRAM + of.reach[numbers])
                    border = np.append(np.flatnonzero(np.append(True, low[1:] > high[:-1])), len(low))
                    for a, b in zip(border[:-1], border[1:]):
                        start, by_place = max(0, int(low[a])), a + np.argsort(places[a:b], kind="stable")
                        rows.append((ids_[n], hashes[n], start, found[start : high[b - 1]].tobytes(), of.seeds[numbers[by_place]].view(np.int64), places[by_place] - start))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "text_hash", "start", "words", "seeds", "places"])

    return _texts(docs).mapInArrow(run, schema)


def _leaks(docs: DataFrame, prepared: DataFrame, sizes: list[int], threshold: float) -> DataFrame:
    schema = "doc_id long, text_hash long, item_id long, score double, first_word long, last_word long"
    spark = docs.sparkSession
    if prepared.isEmpty():
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(gathered(prepared, threshold))
    cut = saved(passages(docs, held, sizes).withColumn("passage", F.monotonically_increasing_id()), "passages")
    hits = cut.select("passage", F.explode(F.array_distinct("seeds")).alias("seed"))
    keys = prepared.select(F.explode("seeds").alias("seed"), F.xxhash64("item").alias("item")).distinct()
    made = hits.groupBy("seed").agg(F.count("*").alias("n")).join(keys.groupBy("seed").agg(F.count("*").alias("items")), "seed")
    made = saved(made.select("seed", (F.col("n") * F.col("items")).alias("made")), "seeds")
    limit = min(MAX_KEY, max(MIN_KEY, int(SHARE * (made.agg(F.sum("made")).first()[0] or 0))))
    frequent = made.where(F.col("made") > limit).select("seed")  # of the at most MAX_SEEDS seeds of a pass
    rare = hits.join(F.broadcast(frequent), "seed", "left_anti").join(keys, "seed")
    candidates = rare.groupBy("passage").agg(F.collect_set("item").alias("items"))
    often = spark.sparkContext.broadcast(np.sort(frequent.toArrow()["seed"].to_numpy().view(np.uint64)))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known, none = held.value, {}, np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text_hash, start, packed, seeds, places, items in zip(*(batch.column(c) for c in range(7))):
                here = seeds.values.to_numpy().view(np.uint64)
                ks = of.with_keys(items.values.to_numpy()) if items.is_valid else none
                unkeyed = np.intersect1d(here, often.value)
                if len(unkeyed):
                    ks = np.union1d(ks, of.with_seeds(np.searchsorted(of.seeds, unkeyed)))
                found = found_in(of, ks, np.frombuffer(packed.as_buffer(), np.uint64), places.values.to_numpy(), np.searchsorted(of.seeds, here), threshold, known)
                for k, score, first, last in found:
                    rows += [(doc_id.as_py(), text_hash.as_py(), item_id, score, start.as_py() + first, start.as_py() + last) for item_id in of.ids[k]]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "text_hash", "item_id", "score", "first_word", "last_word"])

    paired = cut.join(candidates, "passage", "left").select("doc_id", "text_hash", "start", "words", "seeds", "places", "items")
    best = paired.mapInArrow(run, schema).groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", "best.score", "best.first_word", "best.last_word")


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    return without(docs, leaks(docs, items).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), most=MAX_BROADCAST)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they leak."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "first_word", "last_word").distinct()
