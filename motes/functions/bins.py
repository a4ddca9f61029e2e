"""Values to bins, with explicit rules for the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(v: Column, low: float, high: float, n: int, edges: str = "last_closed") -> Column:
    """Bin index 0..n-1 of equal bins on [low, high].

    last_closed: high belongs to the last bin, values outside are null; left: high is outside; clip: values outside go to the end bins.
    """
    i = F.floor((v - low) / ((high - low) / n))
    if edges == "clip":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("int")
    inside = (v >= low) & ((v < high) if edges == "left" else (v <= high))
    return F.when(inside, F.least(i, F.lit(n - 1))).cast("int")


def by_edges(v: Column, edges: list[float], closed: str = "left") -> Column:
    """Bin index by a list of rising edges: left-closed (last bin closed too) or right-closed (first bin closed too); null outside."""
    out = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        a, b = edges[i], edges[i + 1]
        test = (v >= a) & ((v <= b) if i == last else (v < b)) if closed == "left" else ((v >= a) if i == 0 else (v > a)) & (v <= b)
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def filled(df: DataFrame, keys: list[str], bin_name: str, n: int, values: list[str]) -> DataFrame:
    """Missing bins of every key as zeros."""
    grid = df.select(*keys).distinct().withColumn(bin_name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if keys else df.sparkSession.range(n).select(F.col("id").cast("int").alias(bin_name))
    return grid.join(df, [*keys, bin_name], "left").fillna(0, values)
