"""Positions in tile file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three name formats, the first that matches at the start wins.
FOUR_NUMBERS = r"^tile_(\d+)_(\d+)_(\d+)_(\d+)"
LETTERS = r"^tile_r(\d+)_c(\d+)"
PLAIN = r"^(\d+)_(\d+)"


def tile_position(name: Column) -> dict[str, Column]:
    """Row, column and offsets (in the order row, column, y, x) of a tile; null where the name has none."""

    def number(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, group), F.lit("")).cast("int")

    return {
        "tile_row": F.coalesce(number(FOUR_NUMBERS, 1), number(LETTERS, 1), number(PLAIN, 1)),
        "tile_col": F.coalesce(number(FOUR_NUMBERS, 2), number(LETTERS, 2), number(PLAIN, 2)),
        "offset_y": number(FOUR_NUMBERS, 3),
        "offset_x": number(FOUR_NUMBERS, 4),
    }
