"""Small scalar functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_colour(text: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of ``#rrggbb``."""
    return tuple(F.conv(F.substring(text, at, 2), 16, 10).cast("int") for at in (2, 4, 6))


def humanised(seconds: Column) -> Column:
    """Seconds as days, hours and minutes."""
    whole = lambda n: F.floor(seconds / n)
    return F.format_string("%02dd %02dh %02dm", whole(86_400), whole(3600) % 24, whole(60) % 60)


def content_name(content: Column) -> Column:
    """The name under which content is stored: its SHA-256."""
    return F.sha2(content, 256)


def clip_window(start: Column, duration: Column, most: float) -> tuple[Column, Column]:
    """Start (0 without one) and length (at most ``most``) of a clip."""
    return F.coalesce(start, F.lit(0.0)), F.least(F.coalesce(duration, F.lit(most)), F.lit(most))


def between_strictly(value: Column, low: float, high: float | None) -> Column:
    """Whether a value lies over ``low``, and below ``high`` if there is one."""
    return value > low if high is None else (value > low) & (value < high)


def glob_pattern(glob: str) -> str:
    """The regular expression, of a whole text, for a pattern with ``*`` and ``?``."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob) + "$"


#: Arithmetic of configuration values, by the names that configurations use.
RESOLVERS = {
    "add": lambda *x: reduce(lambda a, b: a + b, x),
    "times": lambda *x: reduce(lambda a, b: a * b, x),
    "divide": lambda a, b: a / b,
    "pow": lambda a, b: F.pow(a, b),
    "subtract": lambda a, b: a - b,
    "range": lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
    "int": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)),
    "ceil_int": lambda a: F.ceil(a),
}
