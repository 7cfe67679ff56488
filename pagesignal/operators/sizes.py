"""Checks of size before a side of a join is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_small(df: DataFrame, most: int = 500_000) -> bool:
    """Whether ``df`` has at most ``most`` rows. Reading stops once that is passed."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it is small; else as it is, to be shuffled.

    The check works ``df`` out, so give it a side that is cheap to make, or check with ``is_small`` what bounds it.
    """
    return F.broadcast(df) if is_small(df, most) else df
