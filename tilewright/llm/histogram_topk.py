"""Exact search for the highest inner products by distributed histogram selection (operator 12).

Every query is scored against every row, a block of queries at a time.  A round
counts, for each query, how many scores fall into each of ``BINS`` bins of the
range that still holds its k-th highest score.  Tasks count their own rows, Spark
adds the bins up and finds the one with the k-th score, and that bin is the next
round's range, until few scores lie at or above its lower edge or it is one score
wide.  Then the scores from that edge on are filtered, ties broken by id, and ranked.

A task sends a query's bins only down to the one with the task's own k-th score,
as the k-th of all is at least that; in the last step it sends its k best rows of each query,
so ties, however many, do not travel.  A block holds at most about ``BLOCK``
queries (their vectors, bounds and counters are what a task holds), and its
bounds are the only thing that passes through the driver.

Components are ``floor(scale * x)`` and scores are exact: float32 or float64
products where sums fit their integers, else Python's integers.

A vector that is null or holds a null or a value that is not finite takes no
part.  Only vectors of equal length are scored with one another (empty ones: 0).  A query's
own rows are those with its id.  Ties go to the smaller id, a null id last; a row without id is
never a query.  Repeated rows are rows of their own: a repeated query is answered
for each of its rows, and repeated candidates each take a rank.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frees, saved, scratch, table
from .vectors import packed, scaled

TOP, SCALE, EVERY = 5, 256, 50
#: Queries in a block, bins of a histogram, and scores that may be left where a query's rounds end.
BLOCK, BINS, FEW = 16_384, 256, 64
#: Queries and candidates of one product, and rows that a task holds before it drops those beyond a query's k best.
TILE_QUERIES, TILE_ROWS, HELD = 1024, 2048, 500_000


def product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued float64 matrices, as int64."""
    longest = lambda m: np.sqrt(np.square(m).sum(axis=1).max(initial=0))
    most = longest(queries) * longest(rows) * 1.01  # bounds every partial sum
    if most < 2**24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return (whole(queries) @ whole(rows).T).astype(np.int64)


@dataclass
class Block:
    """Queries in the order of their length and id, with the range that holds each one's k-th score."""

    numbers: np.ndarray
    ids: np.ndarray
    vectors: dict[int, tuple[int, np.ndarray]]
    low: np.ndarray
    width: np.ndarray
    top: np.ndarray  # the range ends before it; the last bin may reach beyond
    above: np.ndarray  # scores at or over top
    few: np.ndarray  # few scores lie at or above low

    @classmethod
    def of(cls, rows: list, longest: float) -> Block:
        rows = sorted(rows, key=lambda r: (len(r.vector), r.vec_id))
        vectors: dict[int, tuple[int, np.ndarray]] = {}
        for at, r in enumerate(rows):
            vectors.setdefault(len(r.vector) // 8, (at, []))[1].append(np.frombuffer(r.vector))
        vectors = {length: (at, np.array(group).reshape(len(group), length)) for length, (at, group) in vectors.items()}
        norms = np.concatenate([np.sqrt(np.square(m).sum(axis=1)) for _, m in vectors.values()])
        reach = np.minimum(np.ceil(norms * longest * (1 + 1e-9)) + 1, 2.0**62).astype(np.int64)  # no score is beyond
        n = len(rows)
        return cls(np.array([r.query_no for r in rows]), np.array([r.vec_id for r in rows]), vectors, -reach, 2 * reach // BINS + 1, reach + 1, np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool))

    def open(self) -> Block:
        """The queries whose range is to be refined."""
        keep = ~self.few
        vectors, begin = {}, 0
        for length, (at, m) in self.vectors.items():
            part = m[keep[at : at + len(m)]]
            if len(part):
                vectors[length] = (begin, part)
                begin += len(part)
        return Block(self.numbers[keep], self.ids[keep], vectors, self.low[keep], self.width[keep], self.top[keep], self.above[keep], self.few[keep])

    def scores(self, column: pa.Array, ids: np.ndarray, known: np.ndarray, scale: int, tile_queries: int, tile_rows: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Tile by tile: the queries, the candidates' places, their scores, and which of them take part."""
        for places, rows in scaled(column, scale):
            begin, queries = self.vectors.get(rows.shape[1], (0, None))
            if queries is None:
                continue
            for q in range(0, len(queries), tile_queries):
                tile = slice(begin + q, begin + min(q + tile_queries, len(queries)))
                mine = self.ids[tile]
                for c in range(0, len(places), tile_rows):
                    at = places[c : c + tile_rows]
                    lower, upper = np.searchsorted(mine, ids[at], "left"), np.searchsorted(mine, ids[at], "right")
                    other = np.ones((len(mine), len(at)), dtype=bool)
                    for k in np.flatnonzero((upper > lower) & known[at]):
                        other[lower[k] : upper[k], k] = False
                    yield tile, at, product(queries[q : q + tile_queries], rows[c : c + tile_rows]), other


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def histograms(rows: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    """query_no, bin, n: each task's bins from the highest down to that of its own k-th score."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        need = k - b.above
        count = np.zeros((len(b.ids), BINS), dtype=np.int64)
        floor = b.low.copy()
        for batch in batches:
            ids, known = _ids(batch.column(0))
            for tile, _, score, other in b.scores(batch.column(1), ids, known, scale, TILE_QUERIES, TILE_ROWS):
                q, c = np.nonzero(other & (score >= floor[tile, None]) & (score < b.top[tile, None]))
                bins = (score[q, c] - b.low[tile][q]) // b.width[tile][q]
                count[tile] += np.bincount(q * BINS + bins, minlength=len(score) * BINS).reshape(-1, BINS)
                from_top = np.cumsum(count[tile, ::-1], axis=1)
                reached = from_top[:, -1] >= need[tile]
                kth = BINS - 1 - (from_top >= need[tile, None]).argmax(axis=1)
                floor[tile] = np.where(reached, b.low[tile] + kth * b.width[tile], floor[tile])
        q, bins = np.nonzero(count)
        sent = b.low[q] + bins * b.width[q] >= floor[q]
        q, bins = q[sent], bins[sent]
        for at in range(0, len(q), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(b.numbers[q[part]]), pa.array(bins[part].astype(np.int32)), pa.array(count[q[part], bins[part]])], names=["query_no", "bin", "n"])

    return rows.mapInArrow(run, "query_no long, bin int, n long")


def refine(rows: DataFrame, block: Block, k: int, scale: int) -> None:
    """One round: every open query's range becomes the bin that holds its k-th score."""
    part = block.open()
    need = rows.sparkSession.createDataFrame(list(zip(part.numbers.tolist(), (k - part.above).tolist())), "query_no long, need long")
    summed = histograms(rows, part, k, scale).groupBy("query_no", "bin").agg(F.sum("n").alias("n"))
    from_top = F.sum("n").over(Window.partitionBy("query_no").orderBy(F.desc("bin")))  # at most BINS rows each
    found = summed.withColumn("from_top", from_top).join(F.broadcast(need), "query_no").where("from_top >= need AND from_top - n < need")
    at = {number: i for i, number in enumerate(block.numbers.tolist())}
    done = ~block.few
    for r in found.select("query_no", "bin", "n", "from_top").collect():  # one row a query of the block
        i = at[r.query_no]
        block.low[i] += r.bin * block.width[i]
        block.top[i] = min(block.low[i] + block.width[i], block.top[i])  # scores from there on are counted in above
        block.above[i] += r.from_top - r.n
        block.few[i] = block.above[i] + r.n <= max(FEW, k) or block.width[i] == 1
        block.width[i] = -(-block.width[i] // BINS)
        done[i] = False
    block.few |= done  # fewer scores than k: all of them count


def highest(rows: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    """query_no, query_id, vec_id, score: each task's k best rows among those from a query's bound on."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def best(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        q, s, unknown, i = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((i, unknown, -s, q))
        q, s, unknown, i = q[order], s[order], unknown[order], i[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < k
        return q[keep], s[keep], unknown[keep], i[keep]

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, parts, size = held.value, [], 0
        for batch in batches:
            ids, known = _ids(batch.column(0))
            for tile, at, score, other in b.scores(batch.column(1), ids, known, scale, TILE_QUERIES, TILE_ROWS):
                q, c = np.nonzero(other & (score >= b.low[tile, None]))
                parts.append((q + tile.start, score[q, c], ~known[at][c], ids[at][c]))
                size += len(q)
                if size > HELD:
                    parts = [best(parts)]
                    size = len(parts[0][0])
        if parts:
            q, s, unknown, i = best(parts)
            yield pa.RecordBatch.from_arrays([pa.array(b.numbers[q]), pa.array(b.ids[q]), pa.array(i, mask=unknown), pa.array(s)], names=["query_no", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_no long, query_id long, vec_id long, score long")


def numbered_queries(rows: DataFrame, scale: int) -> DataFrame:
    """The whole vectors of ``rows`` with a number of their own, written once so that numbers stay."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in scaled(batch.column(1), scale):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), packed(matrix)], names=["vec_id", "vector"])

    return saved(rows.mapInArrow(run, "vec_id long, vector binary").withColumn("query_no", F.monotonically_increasing_id()), "queries")


def longest_vector(rows: DataFrame, scale: int) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            for _, matrix in scaled(batch.column(1), scale):
                most = max(most, float(np.sqrt(np.square(matrix).sum(axis=1)).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    return rows.mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 0.0


def top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    queries = numbered_queries(vectors.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id IS NOT NULL"), scale)
    n = queries.count()
    out = scratch(spark, "topk")
    found = spark.createDataFrame([], "query_no long, query_id long, vec_id long, score long")
    if n:
        longest, blocks = longest_vector(rows, scale), -(-n // BLOCK)
        in_block = F.pmod(F.xxhash64("query_no"), F.lit(blocks))
        for number in range(blocks):
            part = queries.where(in_block == number).collect()  # about BLOCK rows
            if not part:
                continue
            block = Block.of(part, longest)
            while not block.few.all():
                refine(rows, block, k, scale)
            highest(rows, block, k, scale).write.mode("append").parquet(out)
        found = spark.read.schema(found.schema).parquet(out)
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.c, r.c), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % {EVERY} = 0 AND q.vec_id <> r.vec_id AND len(q.c) = len(r.c)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= {TOP}
"""
