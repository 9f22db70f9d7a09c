"""Neighbourhoods of pixels: each block of an image with the pixels around it, as dense arrays in one task.

A pixel travels once, or a few times beside a block's edge, and not once for each neighbour; what a task
holds is one block, whatever the images and however many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a block.
BLOCK = 512
#: Rows that a task looks at together where single groups are smaller, and cells of its dense arrays where single boxes are.
ROWS, CELLS = 1 << 16, 1 << 22


class Area:
    """The place of a block's arrays: the pixels' box with a margin."""

    def __init__(self, part: pd.DataFrame, margin: int, side: int):
        self.y, self.x = part["y"].to_numpy().astype(np.int64), part["x"].to_numpy().astype(np.int64)
        self.top, self.left = int(self.y.min()) - margin, int(self.x.min()) - margin
        self.shape = (int(self.y.max()) - self.top + margin + 1, int(self.x.max()) - self.left + margin + 1)
        self.rows, self.cols = self.top + np.arange(self.shape[0])[:, None], self.left + np.arange(self.shape[1])[None, :]
        row, col = int(part["block_row"].iloc[0]), int(part["block_col"].iloc[0])
        self.mine = (self.rows // side == row) & (self.cols // side == col)

    def dense(self, values, empty, kind, where=slice(None)) -> np.ndarray:
        """An array of ``values`` (those of the pixels ``where``) and ``empty`` elsewhere."""
        out = np.full(self.shape, empty, dtype=kind)
        out[self.y[where] - self.top, self.x[where] - self.left] = values
        return out

    def inside(self, height: int, width: int) -> np.ndarray:
        return (self.rows >= 0) & (self.rows < height) & (self.cols >= 0) & (self.cols < width)


def moved(array: np.ndarray, dy: int, dx: int, empty=False) -> np.ndarray:
    """At each place what lies ``dy`` below and ``dx`` to the right of it."""
    out = np.full_like(array, empty)
    h, w = array.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = array[max(dy, 0) : h - max(-dy, 0), max(dx, 0) : w - max(-dx, 0)]
    return out


def on_blocks(pix: DataFrame, of: list[str], columns: Sequence[str], reach: int, run: Callable[[pd.DataFrame, Area], pd.DataFrame], gives: str) -> DataFrame:
    """``run`` of each block's pixels and those within ``reach`` of it, to columns ``gives`` after ``of``.

    ``run`` gives what lies in the block (``Area.mine``), so that nothing comes twice.
    """
    side = BLOCK
    block = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    dealt = pix.select(*of, "y", "x", *columns, block("y").alias("block_row")).select("*", block("x").alias("block_col"))

    def each(part: pd.DataFrame) -> pd.DataFrame:
        out = run(part, Area(part, reach, side))
        for k, c in enumerate(of):
            out.insert(k, c, [part[c].iloc[0]] * len(out))
        return out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pix.select(*of).schema.fields)
    return dealt.groupBy(*of, "block_row", "block_col").applyInPandas(each, f"{fields}, {gives}")


def group_numbers(part: pa.Table, by: Sequence[str]) -> np.ndarray:
    """The number of each row's group in a table sorted by ``by``."""
    new = np.zeros(part.num_rows, dtype=bool)
    for c in by:
        here = part[c].combine_chunks()
        one, other = here[1:], here[:-1]
        new[1:] |= pc.fill_null(pc.not_equal(one, other), False).to_numpy(zero_copy_only=False)
        new[1:] |= pc.not_equal(one.is_null(), other.is_null()).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def on_groups(rows: DataFrame, by: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], gives: str) -> DataFrame:
    """``run`` of tables of whole groups with the number of each row's group: many small groups at once, or one large.

    A call costs more than the work on a small group, so that a call for each would take the longer the more groups there are.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < enough:
                continue
            part = pa.Table.from_batches(held)
            number = group_numbers(part, by)
            whole = int(np.searchsorted(number, number[-1]))  # the last group may go on
            if whole:
                yield from run(part.slice(0, whole).combine_chunks(), number[:whole]).to_batches()
            held, n = part.slice(whole).to_batches(), n - whole
            enough = max(ROWS, 2 * n)
        if n:
            part = pa.Table.from_batches(held)
            yield from run(part.combine_chunks(), group_numbers(part, by)).to_batches()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(each, gives)


class Boxes:
    """The boxes of groups' pixels, each with a margin of one, laid one after the other in a flat array."""

    def __init__(self, y: np.ndarray, x: np.ndarray, group: np.ndarray):
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        low, high = (lambda v: np.minimum.reduceat(v, begin)), (lambda v: np.maximum.reduceat(v, begin))
        top, left = low(y) - 1, low(x) - 1
        wide = high(x) - left + 2
        cells = (high(y) - top + 2) * wide
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(y))))
        self.size = int(cells.sum())
        self.wide = wide[of]
        self.at = (np.cumsum(cells) - cells)[of] + (y - top[of]) * self.wide + x - left[of]


def box_runs(y: np.ndarray, x: np.ndarray, group: np.ndarray) -> Iterator[slice]:
    """Runs of groups whose boxes have CELLS cells together, or one larger box."""
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    if not len(begin):
        return
    reach = lambda v: np.maximum.reduceat(v, begin) - np.minimum.reduceat(v, begin) + 3
    run = np.cumsum(reach(y) * reach(x)) // CELLS
    first = np.append(begin[np.flatnonzero(np.diff(run, prepend=-1))], len(y))
    yield from (slice(a, b) for a, b in zip(first[:-1], first[1:]))
