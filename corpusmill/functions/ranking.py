"""Dense ranks within large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group is ranked in 2**CELL_BITS cells.  The ranks do not depend on it, only the load.
CELL_BITS = 10


def numbered_cells(placed: DataFrame, by: list[str], order: list, name: str, columns: list[str] | None = None, across: bool = False) -> DataFrame:
    """``placed`` with ``name``: 0-based ranks within (by, __cell) by ``order``, shifted by the counts of the group's lower cells.

    ``across`` shifts by all lower groups too, so that the groups follow one another; the
    window over the counts then has a row a group and cell and no partition.
    """
    before = (Window.orderBy(*by, "__cell") if across else Window.partitionBy(*by).orderBy("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__cell").alias("__low"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(*order)) - 1
    cond = F.col("__cell") == F.col("__low")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.withColumn("__k", within).join(starts, cond).withColumn(name, (F.col("__start") + F.col("__k")).cast("bigint")).select(*(columns or placed.columns), name)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank", cell_bits: int = CELL_BITS) -> DataFrame:
    """``df`` with ``name``: a dense 0-based place of each row among the rows with equal ``by``.

    The order is by a 64-bit hash of ``order`` (as an unsigned number), then by ``order``
    itself: it depends on the values alone, not on partitioning, settings or
    ``cell_bits``.  ``order`` must tell the rows of a group apart.  The upper bits of the
    hash cut a group into cells that are ranked apart and shifted by the counts of the
    cells below, so a group that holds a third of all rows is spread over many tasks.
    Nulls count as one value.
    """
    # a hash independent of the one that places rows in shuffle partitions
    placed = df.withColumn("__hash", F.xxhash64(F.lit(7), *order)).withColumn("__cell", F.shiftrightunsigned("__hash", 64 - cell_bits))
    # within a cell all hashes have one sign, so signed and unsigned order agree
    return numbered_cells(placed, by, ["__hash", *order], name, df.columns)


def _bounds(df: DataFrame, key: str, cells: int) -> list:
    """Up to ``cells`` - 1 approximate quantiles of a number column, ascending."""
    found = df.agg(F.percentile_approx(key, [i / cells for i in range(1, cells)], 10_000).alias("b")).first()["b"] or []
    return sorted(set(found))


def range_cell(key: str, bounds: list) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``; -1 for null."""
    if not bounds:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))), F.lit(-1))


def ranked_in_order(df: DataFrame, key: str, name: str = "rank", by: list[str] | None = None, ties: list[str] | None = None, across: bool = False, cells: int = 64) -> DataFrame:
    """``df`` with ``name``: the 0-based place of each row in the order of a number ``key``, among rows with equal ``by``.

    The key's range is cut at approximate quantiles, which become constants of the plan;
    rows are ranked within a range and shifted by the counts of the ranges below, so the
    ranks are exact whatever the cuts and a group that holds a third of all rows is spread
    over many tasks.  Equal keys go by ``ties``, which must tell them apart; keys must be
    unique without it.  Null keys come first.  With ``across`` the groups, few in number,
    follow one another in the order of ``by`` instead of each starting at 0.
    """
    by = by or []
    placed = df.withColumn("__cell", range_cell(key, _bounds(df, key, cells)))
    return numbered_cells(placed, by, [key, *(ties or [])], name, df.columns, across)
