"""Draws by hashes: the same for the same values, in any engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A whole number of 32 bits from the text of the parts, joined by colons; arrays are joined by commas beforehand."""
    cells = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *cells), 256), 1, 8), 16, 10).cast("long")


def listed(args: str) -> Column:
    return F.concat_ws(",", F.col(args).cast("array<string>"))


def share(*parts: Column | str | int) -> Column:
    """A draw between 0 and 1, neither included."""
    return (draw(*parts) + 1) / F.lit((1 << 32) + 1)
