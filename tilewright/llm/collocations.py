"""Phrase collocation mining by Apriori level-wise passes (operator 13).

Pass k reads all texts once and counts phrases of k words within pieces.  From the
second pass on, a task counts a phrase only when both phrases of k - 1 words in it
are frequent, which it looks up in a broadcast of their hashes; beyond
``MAX_BROADCAST`` of them the broadcast is a bit map of fixed size, which lets some
more phrases through.  These passes count by hash, which never misses a frequent
phrase, since phrases that share a hash can only raise a count.  A last pass counts the phrases of all
levels found so, spelled out and keyed by language and phrase, so the level tables are
exact.  (Within one step of a task, a few megabytes of text, phrases are told apart by 64-bit hashes.)

A candidate's cuts are scored from the level tables alone, as every part of a
frequent phrase is frequent.  A longer candidate that makes a candidate superfluous
occurs as often, and so does every phrase between the two; so looking one word
further on either side is enough.

Letters A-Z are lowered; null and empty texts have no words; a null language is
``und`` (and one with ``und``).  Repeated rows count each time.  Ids and other
columns are not looked at.  A language with fewer words than the threshold gives no rows, nor does an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frees, mix64, range_hashes, saved, table, text_steps

LEAST, LONGEST, BEST = 100, 5, 2000
#: Hashes of frequent phrases that are broadcast at most, and the size of the bit map beyond (16 MB).
MAX_BROADCAST, MAP_BITS = 2_000_000, 1 << 27
#: Bits of the hashes that levels are counted by.  Few bytes are shuffled for each of the many rare phrases;
#: phrases that share a hash only let some more through, which the exact counts then drop.
HASH_BITS = 40
#: Rows of level tables that are broadcast at most; larger ones are joined with salted keys.
MAX_LOOKUP, SALTS = 200_000, 8
#: Bytes of text that a task counts at a time.
COUNT_BYTES = 4_000_000
#: Characters that end a piece.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: floor(1000 * a * n / (l * r)) in decimals: products of two counts pass 64 bits.
SCORE = "CAST((CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000BD) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)"
_PREPARE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS.encode(), b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS))


class Words:
    """The words of some texts, in their order, as ranges of one buffer in which one space parts the words of a piece."""

    def __init__(self, texts: list[str]):
        joined = re.sub(rb" {2,}", b" ", "\n".join(texts).encode("utf-8", "replace").translate(_PREPARE))
        self.code = np.frombuffer(joined, dtype=np.uint8)
        edge = np.diff(((self.code != 10) & (self.code != 32)).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(self.code == 10)[self.starts]

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one piece (for all that have k - 1 words after them)."""
        n = max(len(self.starts) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 :][:n]

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        return range_hashes(self.code, self.starts[at], self.ends[at + k - 1])

    def phrases(self, k: int, at: np.ndarray) -> pa.Array:
        """The phrases of k words from these words on, as strings."""
        starts, ends = self.starts[at], self.ends[at + k - 1]
        bounds = np.append(0, np.cumsum(ends - starts))
        taken = self.code[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(taken)])


def in_lang(hashes: np.ndarray, lang: str) -> np.ndarray:
    """The hashes of phrases as those of one language, of HASH_BITS."""
    seed = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    return mix64(hashes ^ np.uint64(seed)) >> np.uint64(64 - HASH_BITS)


class Sorted:
    """Hashes of frequent phrases, sorted."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        return self.grams[at] == hashes


class BitMap:
    """A set that holds all frequent phrases, and by chance some others."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(64 * len(self.words) - 1)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def frequent(grams: DataFrame) -> Callable[[np.ndarray], np.ndarray] | None:
    """What tells the hashes in column ``gram``; None if there are none."""
    n = grams.count()
    if n <= MAX_BROADCAST:
        return Sorted(grams.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64)) if n else None
    place = F.col("gram").bitwiseAND(F.lit(MAP_BITS - 1))
    words = grams.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(gram & 63))")).alias("bits")).toPandas()  # at most MAP_BITS / 64 rows
    dense = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    dense[words["word"].to_numpy()] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return BitMap(dense)


def _in_tasks(docs: DataFrame, of: Callable[[str, Words], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
    """What ``of`` makes of the words of some megabytes of text of one language at a time."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = {}
        size = 0
        for langs, texts in text_steps(batches):
            for lang, text in zip(langs.to_pylist(), texts):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
            if size >= COUNT_BYTES:
                for lang, some in waiting.items():
                    yield from of(lang, Words(some))
                waiting, size = {}, 0
        for lang, some in waiting.items():
            yield from of(lang, Words(some))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, fields)


def _spelled(lang: str, words: Words, k: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """lang, k, phrase, gram, n of the phrases that begin at these words."""
    grams, first, times = np.unique(words.hashes(k, at), return_index=True, return_counts=True)
    for begin in range(0, len(grams), 50_000):
        part = slice(begin, begin + 50_000)
        size = len(grams[part])
        columns = [pa.array([lang] * size), pa.array(np.full(size, k, dtype=np.int32)), words.phrases(k, at[first[part]]), pa.array(in_lang(grams[part], lang).view(np.int64)), pa.array(times[part].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "gram", "n"])


def counted_words(docs: DataFrame) -> DataFrame:
    """lang, phrase, gram, n of every word, and each language's words in all (null phrase)."""

    def of(lang: str, words: Words) -> Iterator[pa.RecordBatch]:
        n = len(words.starts)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([1], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([n])], names=["lang", "k", "phrase", "gram", "n"])
        yield from _spelled(lang, words, 1, np.arange(n))

    rows = _in_tasks(docs, of, "lang string, k int, phrase string, gram long, n long")
    return rows.groupBy("lang", "phrase").agg(F.min("gram").alias("gram"), F.sum("n").alias("n"))


def counted(docs: DataFrame, k: int, known: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """gram, n: phrases of ``k`` words both of whose parts of k - 1 words ``known`` tells, by hash alone."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def of(lang: str, words: Words) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(words.whole(k - 1))
        fits = np.zeros(len(words.starts) + 1, dtype=bool)
        fits[at] = held.value(in_lang(words.hashes(k - 1, at), lang))
        n = max(len(words.starts) - k + 1, 0)
        at = np.flatnonzero(fits[:n] & fits[1 : n + 1] & words.whole(k))
        grams, times = np.unique(in_lang(words.hashes(k, at), lang), return_counts=True)
        for begin in range(0, len(grams), 100_000):
            part = slice(begin, begin + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(grams[part].view(np.int64)), pa.array(times[part].astype(np.int64))], names=["gram", "n"])

    return _in_tasks(docs, of, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def spelled(docs: DataFrame, sets: dict[int, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """lang, k, phrase, n: exact counts of the phrases whose hashes the level's set tells."""
    held = docs.sparkSession.sparkContext.broadcast(sets)

    def of(lang: str, words: Words) -> Iterator[pa.RecordBatch]:
        for k, known in held.value.items():
            at = np.flatnonzero(words.whole(k))
            yield from _spelled(lang, words, k, at[known(in_lang(words.hashes(k, at), lang))])

    return _in_tasks(docs, of, "lang string, k int, phrase string, gram long, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """The level tables in one (lang, k, phrase, n: frequent phrases, with exact counts), and each language's words in all."""
    words = saved(counted_words(docs).where((F.col("n") >= least) | F.col("phrase").isNull()), "level1")
    grams = words.where("phrase IS NOT NULL")
    totals = words.where("phrase IS NULL").select("lang", "n")
    known, sets = frequent(grams), {}
    for k in range(2, longest + 1):
        if known is None:
            break
        known = frequent(saved(counted(docs, k, known).where(F.col("n") >= least), f"level{k}"))
        if known is not None:
            sets[k] = known
    one = grams.select("lang", F.lit(1).alias("k"), "phrase", "n")
    return (one.unionByName(saved(spelled(docs, sets).where(F.col("n") >= least), "levels")) if sets else one), totals


def _looked_up(cuts: DataFrame, grams: DataFrame, n_grams: int, part: str, name: str) -> DataFrame:
    """``cuts`` with the count of the phrase in column ``part``; common parts are spread by salt."""
    right = grams.select(F.col("lang").alias("g_lang"), F.col("phrase").alias("g_phrase"), F.col("n").alias(name))
    on = (F.col("lang") == F.col("g_lang")) & (F.col(part) == F.col("g_phrase"))
    if n_grams <= MAX_LOOKUP:
        right = F.broadcast(right)
    else:
        cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        right = right.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("salt") == F.col("g_salt"))
    return cuts.join(right, on).drop("g_lang", "g_phrase", "salt", "g_salt")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases by their weakest cut."""
    grams, totals = levels(docs, least, longest)
    totals = totals.select(F.col("lang").alias("t_lang"), "n")
    n_grams = grams.count()
    candidates = grams.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k", F.split("phrase", " ").alias("words"))

    joined = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    k = F.col("k")
    longer = candidates.where("k > 2").select("lang", F.explode(F.array(joined(F.lit(1), k - 1), joined(F.lit(2), k - 1))).alias("phrase"), "a").distinct()
    left = candidates.join(longer, ["lang", "phrase", "a"], "left_anti")  # one candidate a key

    cuts = left.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, k - F.col("cut")).alias("tail"))
    cuts = _looked_up(_looked_up(cuts, grams, n_grams, "head", "l"), grams, n_grams, "tail", "r")
    n_langs = totals.count()
    cuts = cuts.join(F.broadcast(totals) if n_langs <= MAX_LOOKUP else totals, F.col("lang") == F.col("t_lang"))
    weakest = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))  # at most four rows each
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = weakest.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score").withColumn("rank", rank).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language of ``documents``."""
    return phrases(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), total AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), counted AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
      SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k))
  GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}
), cand AS (
  SELECT * FROM counted WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, j, n, CAST((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM cand) c
  JOIN counted h ON h.lang = c.lang AND h.k = j AND h.phrase = array_to_string(w[1:j], ' ')
  JOIN counted t ON t.lang = c.lang AND t.k = c.k - j AND t.phrase = array_to_string(w[j + 1:], ' ')
  JOIN total ON total.lang = c.lang
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), left_over AS (
  SELECT * FROM weakest p WHERE NOT EXISTS (
    SELECT 1 FROM cand q WHERE q.lang = p.lang AND q.f >= p.a AND len(q.phrase) > len(p.phrase) AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM left_over QUALIFY rank <= {BEST}
"""
