"""Ranks, running sums and exact quantiles inside groups of any size, without one task for a group.

Rows are sorted across all tasks by (group, value, further columns) and written once with their place. A place names the range (one task's output) and the row in it,
so a rank is the difference to the group's first place in the range plus the rows of the group in earlier ranges: a table of one row for each group and range.
Everything reads the written places, so it does not matter where ranges were cut, who reads them how often, or what is computed again after a
lost executor. Running sums and quantiles take one row for each value of a group with its count or weight, so rows that share a value never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a place for the row inside its range, as monotonically_increasing_id gives them.
ROW_BITS = 33


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _place, rising with the columns `order` over all rows, and _range, the task that sorted the row."""
    from ..sources.io import stashed

    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return stashed(rows, "places").withColumn("_range", F.shiftright("_place", ROW_BITS))


def with_offsets(rows: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Placed rows with _first, the group's first place in the row's range, _before, the amount of the group in earlier ranges, and _whole, its whole amount."""
    names = [f"_k{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    parts = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_range").alias("_r")).agg(F.min("_place").alias("_first"), F.sum(amount).alias("_t"))
    over = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_t").over(over.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_whole": F.sum("_t").over(over)}).drop("_t")
    return rows.join(parts, [*same, F.col("_range") == F.col("_r")]).drop("_r", *names)


def numbered(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", total: str = "total") -> DataFrame:
    """df with a number from 1 in the given order inside keys, and the group's number of rows. Rows alike in keys and order should be few: they meet in one task."""
    rows = with_offsets(placed(df, [*keys, *order]), keys, F.lit(1).cast("long"))
    return rows.withColumns({rank: F.col("_place") - F.col("_first") + 1 + F.col("_before"), total: F.col("_whole")}).select(*df.columns, rank, total)


def ranked(df: DataFrame, value: str, keys: list[str], order: list[str], rank: str = "rank", total: str = "total") -> DataFrame:
    """df without null values, with the rank from 1 by (value, order) inside keys and the group's number of rows."""
    return numbered(df.where(F.col(value).isNotNull()), keys, [value, *order], rank, total)


def running(df: DataFrame, value: str, keys: list[str], weight: str, name: str, whole: str) -> DataFrame:
    """df (one row for each value inside keys) without null values, with the weight of all values up to this one, and of the whole group."""
    rows = with_offsets(placed(df.where(F.col(value).isNotNull()), [*keys, value]), keys, F.col(weight))
    w = Window.partitionBy(*keys, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(weight).over(w) + F.col("_before"), whole: F.col("_whole")}).select(*df.columns, name, whole)


def counted(df: DataFrame, value: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """For each value inside keys: _n rows (or their whole weight), _up up to it, _all of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    counts = counts if weight is None else counts.where("_n > 0")
    return running(counts, value, keys, "_n", "_up", "_all")


def average_rank(df: DataFrame, value: str, keys: list[str], name: str, among: DataFrame | None = None) -> DataFrame:
    """df without null values, with the rank from 1 of value inside keys, ties at their mean. among: the rows to rank among, if not df itself."""
    names = [f"_k{i}" for i in range(len(keys))]
    ranks = counted(df if among is None else among, value, keys).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("_v"), (F.col("_up") - (F.col("_n") - 1) / 2).alias(name))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return df.join(ranks, [*same, F.col(value) == F.col("_v")]).drop("_v", *names)


def quantiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row a group that has values: exact quantiles, interpolated between neighbours, each under its name. weight: a column of how often a row counts.

    A quantile is where the running count of values reaches its rank, a minimum over the group's values that every task takes of its own rows first.
    """
    at = {n: (F.col("_all") - 1) * p for n, p in shares.items()}
    reaches = lambda rank: F.min(F.when(F.col("_up") > rank, F.col(value).cast("double")))
    ends = [reaches(round_(p)).alias(f"_{n}_{i}") for n, p in at.items() for i, round_ in enumerate((F.floor, F.ceil))]
    got = counted(df, value, keys, weight).groupBy(*keys).agg(F.first("_all").alias("_all"), *ends)
    low, high, part = (lambda n: F.col(f"_{n}_0")), (lambda n: F.col(f"_{n}_1")), (lambda n: at[n] - F.floor(at[n]))
    return got.select(*keys, *[F.when(low(n) == high(n), low(n)).otherwise(low(n) * (1 - part(n)) + high(n) * part(n)).alias(n) for n in shares])


def with_quantiles(groups: DataFrame, df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """groups (one row a group of df) with the quantiles of value; null where a group has no values."""
    names = [f"_q{i}" for i in range(len(keys))]
    found = quantiles(df, value, keys, shares).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *shares)
    if not keys:
        return groups.crossJoin(found)  # two single rows
    return groups.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left").drop(*names)
