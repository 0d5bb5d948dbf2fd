"""Order statistics of groups, by their definitions in use: median, nearest rank, exclusive and upper median.

Equal values are counted before any window, so a group costs one row per distinct value, not per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(rows: DataFrame, keys: list[str], value: str, picks: dict[str, Callable[[Column], Column]], within: dict[str, tuple[Column, list[str]]] | None = None) -> DataFrame:
    """keys, n and for each pick the value at an index (from 0) that is a function of n. Nulls are left out.

    ``within`` gives conditions, each with picks that count only the rows where it holds (null without such a row), so that
    statistics of parts of a group come from the same pass.
    """
    parts = {"": (F.lit(True), [p for p in picks if not any(p in names for _, names in (within or {}).values())]), **(within or {})}
    held = [F.count(F.when(condition, 1)).alias(f"_k{part}") for part, (condition, _) in parts.items()]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*held)
    running, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    spread = counted.select(*keys, value, *[F.sum(f"_k{p}").over(running).alias(f"_up{p}") for p in parts], *[F.sum(f"_k{p}").over(whole).alias(f"_n{p}") for p in parts])
    at = []
    for part, (_, names) in parts.items():
        up, n = F.col(f"_up{part}"), F.col(f"_n{part}")
        at += [F.min(F.when((n > 0) & (up > picks[name](n)), F.col(value))).alias(name) for name in names]
    return spread.groupBy(*keys).agg(F.first("_n").alias("n"), *at)


def middle(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n, median: the mean of the two middle values."""
    two = order_statistics(rows, keys, value, {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)})
    return two.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias(name))


def nearest_quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, p25, p75; the quartiles are the values at n div 4 and 3n div 4."""
    out = order_statistics(
        rows,
        keys,
        value,
        {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2), "p25": lambda n: F.floor(n / 4), "p75": lambda n: F.floor(n * 3 / 4)},
    )
    return out.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "p25", "p75")


def quartiles_and_medians(rows: DataFrame, keys: list[str], value: str, within: dict[str, Column]) -> DataFrame:
    """``nearest_quartiles`` with the median of the rows that meet each condition of ``within``, in one pass."""
    low, high = (lambda n: F.floor((n - 1) / 2)), (lambda n: F.floor(n / 2))
    picks = {"_a": low, "_b": high, "p25": lambda n: F.floor(n / 4), "p75": lambda n: F.floor(n * 3 / 4)}
    picks |= {f"{side}{name}": f for name in within for side, f in (("_a_", low), ("_b_", high))}
    out = order_statistics(rows, keys, value, picks, {name: (condition, [f"_a_{name}", f"_b_{name}"]) for name, condition in within.items()})
    mean = lambda end: (F.col(f"_a{end}") + F.col(f"_b{end}")) / 2
    return out.select(*keys, "n", mean("").alias("median"), "p25", "p75", *[mean(f"_{name}").alias(name) for name in within])


def exclusive_quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, p25, p75 by the exclusive method; the single value where there is one."""
    j = lambda n, q: F.greatest(F.lit(1), F.least(F.floor(q * (n + 1) / 4), n - 1))
    out = order_statistics(
        rows,
        keys,
        value,
        {
            "_a": lambda n: F.floor((n - 1) / 2),
            "_b": lambda n: F.floor(n / 2),
            "_l1": lambda n: j(n, 1) - 1,
            "_h1": lambda n: F.least(j(n, 1), n - 1),
            "_l3": lambda n: j(n, 3) - 1,
            "_h3": lambda n: F.least(j(n, 3), n - 1),
        },
    )

    def quartile(q: int) -> Column:
        d = q * (F.col("n") + 1) - 4 * j(F.col("n"), q)
        return F.when(F.col("n") == 1, F.col("_a")).otherwise((F.col(f"_l{q}") * (4 - d) + F.col(f"_h{q}") * d) / 4)

    return out.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"), quartile(1).alias("p25"), quartile(3).alias("p75"))
