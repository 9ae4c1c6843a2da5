"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many rows on (some ten megabytes of narrow rows).
HOT_ROWS = 200_000
#: The hottest keys that are joined apart.  Any other key holds less than 1 / MOST_HOT of all rows.
MOST_HOT = 1000


def hottest(counts: DataFrame, key: str, n: str, least: int = HOT_ROWS, most: int = MOST_HOT) -> list:
    """The (at most ``most``) keys of a table of counts with the largest counts of at least ``least``."""
    rows = counts.filter((F.col(n) >= least) & F.col(key).isNotNull()).orderBy(F.col(n).desc(), key).limit(most)
    return [r[0] for r in rows.select(key).collect()]


def hot_keys(rows: DataFrame, key: str, least: int = HOT_ROWS, most: int = MOST_HOT) -> list:
    """``hottest`` of the rows themselves, counted with map-side combine."""
    return hottest(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "__n", least, most)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", least: int = HOT_ROWS, most: int = MOST_HOT, hot: list | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with a table that holds each ``key`` once at most.

    Rows of hot keys stay where they are: the few rows of ``unique`` that they meet, at
    most ``most``, are broadcast.  All other rows are shuffled by the key, of which none
    holds more than 1 / ``most`` of them.  Unless the ``hot`` keys (``hottest`` of counts
    at hand) are given, ``rows`` is read for them first, so it should be a stored table.
    """
    hot = hot_keys(rows, key, least, most) if hot is None else hot
    if not hot:
        return rows.join(unique, key, how)
    is_hot = F.col(key).isin(hot)
    apart = rows.filter(is_hot).join(F.broadcast(unique.filter(is_hot)), key, how)  # at most ``most`` rows
    return apart.unionByName(rows.filter(~is_hot | F.col(key).isNull()).join(unique.filter(~is_hot), key, how))
