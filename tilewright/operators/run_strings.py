"""Run-length codes as text: each count, or its difference from the count two before, in five-bit digits.

A digit is a character from ``0`` on; its fifth bit says that more follow, and
the last digit's fourth bit is the sign.  The first three counts are plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Digits that a number may have: 35 bits.
DIGITS = 7


def to_text(counts: str = "counts") -> Column:
    """The text of an array of counts."""
    plain = f"transform({counts}, (c, i) -> CAST(IF(i > 2, c - element_at({counts}, i - 1), c) AS BIGINT))"
    length = "CASE " + " ".join(f"WHEN x >= {-(1 << 5 * k - 1)} AND x < {1 << 5 * k - 1} THEN {k}" for k in range(1, DIGITS)) + f" ELSE {DIGITS} END"
    digit = "chr(48 + (shiftright(s.x, 5 * j) & 31) + IF(j < s.n - 1, 32, 0))"
    sized = f"transform({plain}, x -> named_struct('x', x, 'n', {length}))"
    return F.expr(f"array_join(transform({sized}, s -> array_join(transform(sequence(0, s.n - 1), j -> {digit}), '')), '')")


def read_texts(texts: list[str | None]) -> list[np.ndarray]:
    """The counts of each text; the digits of all are read at once."""
    digits = [np.frombuffer((t or "").encode("utf-32-le"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(d) for d in digits])
    v = np.concatenate([*digits, np.zeros(0, dtype=np.uint32)]).astype(np.int64) - 48
    text = np.repeat(np.arange(len(digits)), sizes)
    last = ((v & 32) == 0) | (np.diff(text, append=-1) != 0)  # a text's end ends its number
    ends = np.flatnonzero(last)
    begin = np.append(0, ends + 1)[: len(ends)]
    if not len(ends):
        return [np.zeros(0, dtype=np.int64)] * len(digits)
    shift = (5 * (np.arange(len(v)) - np.repeat(begin, ends + 1 - begin))) & 63
    d = np.add.reduceat((v & 31) << shift, begin) - np.where((v[ends] & 48) == 16, np.int64(1) << ((shift[ends] + 5) & 63), 0)
    per = np.bincount(text[ends], minlength=len(digits))
    out = []
    for one in np.split(d, np.cumsum(per)[:-1]):
        for k in (1, 2):  # sums along every second number; the first stands alone
            one[k::2] = np.cumsum(one[k::2])
        out.append(one)
    return out


def from_text(coded: DataFrame, of: list[str], text: str = "code") -> DataFrame:
    """The counts of each text; an empty text has none."""
    rows = coded.select(*of, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = read_texts(batch.column("_text").to_pylist())
            ends = pa.array(np.cumsum([0, *map(len, counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*counts, np.zeros(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in of), lists], names=[*of, "counts"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("counts", ArrayType(LongType()))]))
