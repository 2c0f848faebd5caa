"""Random choices as pure functions of (seed, key): the same in every engine, partitioning and rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts: tuple) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def order_key(*parts) -> Column:
    """A hash to rank by."""
    return F.md5(_text(parts))


def uniform(*parts) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(F.md5(_text(parts)), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def order_key_sql(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr({order_key_sql(*parts)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
