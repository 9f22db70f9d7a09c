"""Exact Jaccard join on word shingles by partitioning the universe (operator 5).

Two sets whose Jaccard similarity reaches ``pct`` per cent differ in at most
``h = floor((|X| + |Y|) * (100 - pct) / (100 + pct))`` elements.  A set's size
picks its band; each band has a scheme that hashes the universe into segments.

* In a scheme of ``m`` segments, a pair agrees on at least ``m - h`` of them.
  Every segment's subset is indexed by a hash of the elements in it.
* Very small sets, which may differ in one element only, are indexed as one
  segment together with its one-deletion neighbourhood.
* Cost-based allocation: as ``m`` exceeds ``h + 1``, a set may leave out its
  ``m - h - 1`` most expensive segments, those whose subsets most documents
  have.  Expense depends on the subset alone, so both sides of a pair leave out
  the same shared segments first, and at least one agreed segment always stays.
  A set with no more shared segments than that has no partner at all.
* A set that partners of the next smaller band can reach is indexed under that
  band's scheme too.

Sets with equal elements are one class, known by a 64-bit hash, and only
classes are compared.  Candidates are verified exactly on the sets of shingle
hashes, in three rounds so that large groups do not emit all their pairs: each
class with the least class of its segments; then with the least classes of its
other segments, where not yet connected; then, for segments whose classes are
still in different components, their classes in blocks, two blocks that share such a
segment to a task.  So no link that joins two components is lost.

Null and empty texts, and texts of white space, have the empty set, link with
nothing and are components of their own.  A null id is never a component's id
unless no member has an id.  Repeated rows are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, mix64, saved, table, text_steps, without, words_of

#: Growth of sizes from band to band, and the share of further segments.
BAND, EXTRA = 1.3, 0.25
#: Candidate classes whose ids are broadcast at most (16 bytes each).
MAX_BROADCAST = 1_000_000
SKETCH = 64
#: Classes whose signatures a task need not send again.
REMEMBERED = 200_000
#: Sets in a block, and columns of an incidence matrix at a time.
BLOCK, COLUMNS = 128, 4096


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's ``width``-word shingles (all its words if fewer)."""
    words, _, _ = words_of(text)
    n = len(words)
    if not n:
        return words
    out = np.zeros(max(1, n - width + 1), dtype=np.uint64)
    for k in range(min(width, n)):
        out = mix64(out + words[k : k + len(out)] + np.uint64(k + 1))
    return np.unique(out)


@dataclass(frozen=True)
class Scheme:
    """Sizes from ``low`` to below ``high``, and the number of segments (0: one-deletion)."""

    number: int
    low: int
    high: int
    segments: int


class Schemes:
    """The schemes for a similarity of ``pct`` per cent."""

    def __init__(self, pct: int):
        self.pct = pct
        self.lists: list[Scheme] = []
        self.low = next(s for s in range(1, 10_000) if self.most(s + s * 100 // pct) >= 1)
        end = next(s for s in range(self.low, 10_000) if s * (100 - pct) // pct >= 2)
        self.lists.append(Scheme(0, self.low, end, 0))
        self._grow(end)

    def most(self, total: int) -> int:
        """The largest difference of a similar pair with so many elements in both sets together."""
        return total * (100 - self.pct) // (100 + self.pct)

    def _grow(self, size: int) -> None:
        ratio = max(BAND, 1.05 * 100 / self.pct)
        while self.lists[-1].high <= size:
            low = self.lists[-1].high
            high = int(np.ceil(low * ratio)) + 1
            h = (high - 1) * (100 - self.pct) // self.pct
            self.lists.append(Scheme(len(self.lists), low, high, h + 1 + max(2, int(h * EXTRA))))

    def of(self, size: int) -> list[tuple[Scheme, int]]:
        """The schemes for a set of this size, each with the most elements a partner there differs in."""
        if size < self.low:
            return []
        self._grow(size)
        at = next(k for k, s in enumerate(self.lists) if size < s.high)
        own = self.lists[at]
        out = [(own, size * (100 - self.pct) // self.pct)]
        if at and -(-size * self.pct // 100) < own.low:
            below = self.lists[at - 1]
            out.append((below, self.most(size + below.high - 1)))
        return out


def signatures(elements: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """The segment hashes of a set, and for each how many segments of its scheme the set may leave out.

    The latter is ``scheme * 2**20 + count``.
    """
    keys, spare = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    mixed = mix64(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for scheme, h in schemes.of(len(elements)):
        salt = mix64(np.array([scheme.number * 1_000_003 + schemes.pct], dtype=np.uint64))[0]
        if not scheme.segments:
            whole = mixed.sum(dtype=np.uint64)
            keys.append(mix64(np.append(whole, whole - mixed) ^ salt))
            spare.append(np.full(len(mixed) + 1, scheme.number << 20, dtype=np.int64))
            continue
        m = scheme.segments
        segment = (mix64(mixed + salt) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        total = np.append(np.uint64(0), np.cumsum(mixed[order]))
        border = np.searchsorted(segment[order], np.arange(m + 1))
        content = total[border[1:]] - total[border[:-1]]
        keys.append(mix64(content + mix64(salt + np.arange(1, m + 1, dtype=np.uint64))))
        spare.append(np.full(m, scheme.number << 20 | max(0, m - h - 1), dtype=np.int64))
    return np.concatenate(keys), np.concatenate(spare)


def sketch(docs: DataFrame, width: int, pct: int) -> DataFrame:
    """Per row: id, hash of the text, size of the set, its class (null if empty), and its signatures.

    Of copies that a task meets, one has the signatures.
    """
    schema = "doc_id long, text_hash long, n_shingles long, node long, keys array<long>, spares array<long>"

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, seen = Schemes(pct), set()
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            at, hashes = 0, batch.column(2)
            for ids, texts in text_steps(iter([batch])):
                n, nodes, keys, spares, ends = [], [], [], [], [0]
                for text in texts:
                    found = shingles(text.encode("utf-8", "replace"), width)
                    node = class_of(found)
                    key, spare = nothing if node in seen else signatures(found, schemes)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    n.append(len(found))
                    nodes.append(node)
                    keys.append(key)
                    spares.append(spare)
                    ends.append(ends[-1] + len(key))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, hashes.slice(at, len(ids)), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(spares))),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "keys", "spares"],
                )
                at += len(ids)

    return _texts(docs).mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def class_of(elements: np.ndarray) -> int | None:
    """The hash of a set; null for the empty one."""
    if not len(elements):
        return None
    mixed = mix64(elements * np.uint64(0x9E3779B97F4A7C15))
    return int(mix64(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(elements))]) ^ np.bitwise_xor.reduce(mix64(mixed)))[0].view(np.int64))


def shared_segments(sketched: DataFrame) -> DataFrame:
    """Segments that several classes have, after allocation: key and class."""
    rows = sketched.where("node IS NOT NULL").select("node", F.explode(F.arrays_zip("keys", "spares")).alias("s")).select("node", F.col("s.keys").alias("key"), F.col("s.spares").alias("spare"))
    # One row for each key and task is shuffled; a key that many copies have is summed before.
    several = sketched.where("node IS NOT NULL").select("node", F.explode("keys").alias("several_key")).groupBy("several_key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("uses")).where("low < high").select("several_key", "uses")
    several = saved(several, "segments")
    members = saved(rows.join(several.hint("shuffle_hash"), F.col("key") == F.col("several_key")).select("key", "node", "spare", "uses").distinct(), "members")
    # A set's segments in one scheme: as many as its size allows.
    ranked = members.select("*", F.expr("row_number() OVER (PARTITION BY node, spare ORDER BY uses DESC, key)").alias("place"))
    kept = ranked.where((F.col("place") > F.expr("spare & 1048575"))).select("key", "node")
    return saved(kept, "kept-segments")


def candidate_sets(docs: DataFrame, sketched: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """The sorted shingle hashes of each class in ``segments``, with a histogram of them."""
    wanted = segments.select(F.col("node").alias("wanted")).distinct()
    # Copies are summed before the join, so a class of many is one row there.
    first = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("who"))
    first = first.join(wanted, F.col("node") == F.col("wanted"), "left_semi")
    first = saved(first.select("node", F.col("who.doc_id").alias("of_doc"), F.col("who.text_hash").alias("of_hash")), "candidates")
    if first.count() <= MAX_BROADCAST:
        first = F.broadcast(first)
    chosen = _texts(docs).join(first, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash"))).select("node", "text")

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in text_steps(batches):
            found = [shingles(t.encode("utf-8", "replace"), width) for t in texts]
            counts = [np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=SKETCH).astype("<u4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([nodes, pa.array(map(len, found), pa.int64()), pa.array(counts, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "size", "histogram", "elements"])

    made = chosen.mapInArrow(run, "node long, size long, histogram binary, elements binary")
    return saved(made.dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: first by sizes and histograms, then by the elements."""

    @frees
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").reshape(len(batch), SKETCH).astype(np.int64) for k in (2, 4))
                total = a.sum(1) + b.sum(1)
                fits = np.abs(a - b).sum(1) <= total * (100 - pct) // (100 + pct)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fits))

    @frees
    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= pct * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small = sets.select("node", "size", "histogram")
    one = small.select(F.col("node").alias("node_a"), F.col("size").alias("size_a"), F.col("histogram").alias("histogram_a"))
    two = small.select(F.col("node").alias("node_b"), F.col("size").alias("size_b"), F.col("histogram").alias("histogram_b"))
    sized = pairs.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))
    sized = sized.where((100 * F.least("size_a", "size_b")) >= pct * F.greatest("size_a", "size_b"))
    close = saved(sized.select("a", "b", "size_a", "histogram_a", F.col("histogram_b")).select("a", "b", "histogram_a", "size_a", "histogram_b").mapInArrow(near, "a long, b long"), "close-pairs")
    one = sets.select(F.col("node").alias("node_a"), F.col("elements").alias("elements_a"))
    two = sets.select(F.col("node").alias("node_b"), F.col("elements").alias("elements_b"))
    full = close.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b")).select("a", "b", "elements_a", "elements_b")
    return saved(full.mapInArrow(same, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """The least node that each node of ``edges`` (a, b) is connected with: node, root.

    Large and small stars in turn, until every node points at one that points at none
    and at no other; all steps are joins and sums.
    """
    state = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        sides = state.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("hit")).unionByName(state.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("hit")))
        if sides.groupBy("node").agg(F.sum("out").alias("out"), F.max("hit").alias("hit")).where("out > 1 OR out = 1 AND hit = 1").isEmpty():
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select("of", F.least("of", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, "large-star")
        least = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("of")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        state = saved(small.where("a <> b").distinct(), "small-star")


def links(docs: DataFrame, sketched: DataFrame, width: int, pct: int) -> DataFrame:
    """Links between classes, enough to connect all that are connected: a, b."""
    spark = docs.sparkSession
    segments = shared_segments(sketched)
    sets = candidate_sets(docs, sketched, segments, width)
    least = segments.groupBy(F.col("key").alias("of_key")).agg(F.min("node").alias("least"))
    stars = saved(segments.join(saved(least, "least-of-segment"), F.col("key") == F.col("of_key")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "stars")
    found = verified(stars.groupBy("a").agg(F.min("b").alias("b")), sets, pct)
    tried = stars.groupBy("a").agg(F.min("b").alias("b"))

    def rooted(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
        named = roots.select(F.col("node").alias(f"{column}_node"), F.col("root").alias(f"{column}_root"))
        return df.join(named, F.col(column) == F.col(f"{column}_node"), "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column)).drop(f"{column}_node")

    def untried(df: DataFrame) -> DataFrame:
        done = tried.select(F.col("a").alias("done_a"), F.col("b").alias("done_b"))
        return df.join(done, (F.col("a") == F.col("done_a")) & (F.col("b") == F.col("done_b")), "left_anti")

    roots = components(found)
    second = saved(untried(rooted(rooted(stars, "a", roots), "b", roots).where("a_root <> b_root").select("a", "b")), "second-pairs")
    if not second.isEmpty():
        found = saved(found.unionByName(verified(second, sets, pct)), "links")
        roots = components(found)
        tried = stars
    members = saved(rooted(segments.withColumnRenamed("node", "a"), "a", roots), "rooted-segments")
    split = members.groupBy(F.col("key").alias("of_key")).agg(F.min("a_root").alias("r0"), F.max("a_root").alias("r1")).where("r0 < r1").select("of_key")
    members = saved(members.join(saved(split, "split-segments"), F.col("key") == F.col("of_key"), "left_semi"), "split-members")
    if members.isEmpty():
        return found
    least = saved(members.groupBy(F.col("key").alias("of_key")).agg(F.min("a").alias("b")), "least-of-split")
    near = members.join(least, F.col("key") == F.col("of_key")).select("a", "b")
    clusters = components(near).select(F.col("node").alias("of_node"), F.col("root").alias("cluster"))
    placed = members.join(clusters, F.col("a") == F.col("of_node"), "left").select("key", "a", "a_root", F.coalesce("cluster", "a").alias("cluster"))
    return found.unionByName(saved(block_links(saved(placed, "unresolved"), sets, pct), "links"))


def block_links(members: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """For each two components with a similar pair that shares a segment, such a pair.

    ``members`` has the segments' nodes: key, a, a_root, cluster.  The nodes of a
    component of ``BLOCK`` or more are dealt into blocks of their own, the others of a
    cluster into common blocks.  Two blocks that share a segment go to a task,
    never more, unless all in both are of one component; so a stray node meets a large
    component's blocks, and they don't meet each other.  The task counts common
    elements of all their pairs at once as a product of incidence matrices.
    """
    nodes = members.select("a", "a_root", "cluster").distinct()
    roots = nodes.groupBy(F.col("a_root").alias("of_root")).agg(F.count("*").alias("size"), F.min("cluster").alias("in_cluster"))
    roots = saved(roots, "root-sizes")
    common = roots.where(F.col("size") < BLOCK).groupBy("in_cluster").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    own = F.ceil(F.col("size") / BLOCK).alias("blocks")
    dealt = roots.where(F.col("size") >= BLOCK).select("of_root", "in_cluster", own, F.lit(True).alias("pure"))
    dealt = dealt.unionByName(roots.where(F.col("size") < BLOCK).join(common, "in_cluster").select("of_root", "in_cluster", "blocks", F.lit(False).alias("pure")))
    place = F.pmod(F.xxhash64(F.when(F.col("pure"), F.col("a")).otherwise(F.col("a_root"))), F.col("blocks"))
    block = F.xxhash64("pure", F.when(F.col("pure"), F.col("a_root")).otherwise(F.col("in_cluster")), place)
    at = nodes.drop("cluster").join(saved(dealt, "roots-dealt"), F.col("a_root") == F.col("of_root"))
    at = saved(at.select(F.col("a").alias("node"), "a_root", block.alias("block"), F.when(F.col("pure"), F.col("a_root")).alias("pure_root")), "blocks")
    there = saved(members.select("key", "a").join(at, F.col("a") == F.col("node")).select("key", "block", "pure_root").distinct(), "blocks-of-segments")
    other = there.select(F.col("key").alias("of_key"), F.col("block").alias("second"), F.col("pure_root").alias("other_root"))
    met = there.join(other, (F.col("key") == F.col("of_key")) & (F.col("block") <= F.col("second")) & ~F.coalesce(F.col("pure_root") == F.col("other_root"), F.lit(False)))
    met = saved(met.select(F.col("block").alias("first"), "second").distinct(), "block-pairs")
    sides = met.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("side"))
    held = sets.select(F.col("node").alias("a"), "elements")
    paired = sides.join(at, F.col("side") == F.col("block")).select("first", "second", "block", F.col("node").alias("a"), "a_root").join(held, "a")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(x, dtype=np.uint64) for x in part["elements"]]
        size = np.array([len(x) for x in found])
        values, inverse, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(found)), size)
        column = (np.cumsum(times > 1) - 1)[inverse]
        shared = np.flatnonzero(times[inverse] > 1)
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(found), len(found)), dtype=np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            incidence = np.zeros((len(found), COLUMNS), dtype=np.float32)
            incidence[row[a:b], column[a:b] - at] = 1
            common += incidence @ incidence.T
        root, block = part["a_root"].to_numpy(), part["block"].to_numpy()
        common = common.astype(np.int64)
        fits = (100 * common >= pct * (size[:, None] + size[None, :] - common)) & (root[:, None] > root[None, :])
        if key[0] != key[1]:
            fits &= block[:, None] != block[None, :]
        x, y = np.nonzero(fits)
        node = part["a"].to_numpy()
        one = np.unique(np.stack([root[x], root[y]]), axis=1, return_index=True)[1]  # a link for each two components
        return pd.DataFrame({"a": node[x[one]], "b": node[y[one]]})

    return paired.groupBy("first", "second").applyInPandas(compare, "a long, b long")


def groups(docs: DataFrame, width: int, pct: int) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, node, component_id, the least id of its component, and ``stays``, whether it has the id and text that stay."""
    sketched = saved(sketch(docs, width, pct), "sketches")
    roots = saved(components(links(docs, sketched, width, pct)), "roots").withColumnRenamed("node", "of_node")
    full = sketched.where("node IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "node")
    placed = saved(full.join(roots, F.col("node") == F.col("of_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("of_node"), "placed")
    names = saved(placed.groupBy(F.col("root").alias("of_root")).agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")), "names")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    named = placed.join(names, F.col("root") == F.col("of_root")).select("doc_id", "text_hash", "n_shingles", "node", "component_id", stays.alias("stays"))
    empty = sketched.where("node IS NULL").select("doc_id", "text_hash", "n_shingles", "node", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return named.unionByName(empty)


def keep_one(docs: DataFrame, width: int = 5, pct: int = 80) -> DataFrame:
    """One row of each group of similar documents stays: of the least id (null last), then text hash.  All columns stay.

    Of rows with that id and text any one stays.  Rows without a shingle are like no other, and all stay.
    """
    found = saved(groups(docs, width, pct), "groups").where("node IS NOT NULL")
    key = [F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")]
    repeated = saved(found.where("stays").groupBy(*key).count().where("count > 1").drop("count"), "repeated")
    kept = without(docs, found.where("NOT stays").select(*key).unionByName(repeated), most=MAX_BROADCAST)
    if repeated.isEmpty():
        return kept
    prefix = "kept"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    keyed = docs.withColumns({f"{prefix}id": F.col("doc_id").cast("long"), f"{prefix}hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    again = repeated.toDF(f"{prefix}of_id", f"{prefix}of_hash")
    rows = keyed.join(again, F.col(f"{prefix}id").eqNullSafe(F.col(f"{prefix}of_id")) & (F.col(f"{prefix}hash") == F.col(f"{prefix}of_hash")), "left_semi")
    return kept.unionByName(rows.dropDuplicates([f"{prefix}id", f"{prefix}hash"]).select(*docs.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles are 90 % alike."""
    return groups(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")
