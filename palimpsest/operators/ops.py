"""Operational queries: rates, log tails, progress, shared tasks, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def sliding_rate(events: DataFrame, ts: str = "ts", seconds: int = 60, step: int = 10) -> DataFrame:
    """(start, events, rate): events of each window of ``seconds``, one every ``step``, and their number a second."""
    return (
        events.groupBy(F.window(ts, f"{seconds} seconds", f"{step} seconds").alias("w"))
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("start"), "events", (F.col("events") / seconds).alias("rate"))
    )


def tail(log: DataFrame, limit: int, *order: str) -> DataFrame:
    """The last ``limit`` rows, oldest first."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order)


def every_nth(rows: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """Every n-th row of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rn", nth).where((F.col("rn") - 1) % n == 0).drop("rn")


def percent(done: Column, total: Column) -> Column:
    return F.round(F.try_divide(100.0 * done, total), 1)


def shared_tasks(asks: DataFrame) -> DataFrame:
    """(page, task, users): one task for each page that is asked for, the first; and how many users share it.

    ``asks``: user, page, ts, task.
    """
    return asks.groupBy("page").agg(
        F.min_by("task", F.struct("ts", "task")).alias("task"), F.countDistinct("user").alias("users")
    )


def success_ratio(results: DataFrame, order: str | list[str], valid: str) -> DataFrame:
    """Share of valid results so far, by an order over all of them."""
    sums = running(results, {"__valid": F.col(valid).cast("long"), "__all": F.lit(1).cast("long")}, *([order] if isinstance(order, str) else order))
    return sums.withColumn("ratio", F.col("__valid") / F.col("__all")).drop("__valid", "__all")


def last_link(cells: DataFrame) -> DataFrame:
    """Every cell of a row gets the row's last link that isn't null. ``cells``: row, col, link."""
    whole = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cells.withColumn("link", F.last("link", ignorenulls=True).over(whole))


def numbered(df: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """``df`` with the place of each row in the order of all, from 0. Ties are placed in no fixed order."""
    return running(df, {name: F.lit(1).cast("long")}, *order).withColumn(name, F.col(name) - 1)


def running(df: DataFrame, sums: dict[str, Column], *order: str | Column) -> DataFrame:
    """``df`` with sums, by name, over all rows up to each in the order of all; nulls add nothing.

    A prefix sum over ranges: rows are sorted into ranges of the order and written once, each range adds up its own rows,
    and what stands before a range is added to them. Only the ranges' totals, a row each, pass the driver; no task sees
    more than its range. Of ties, which are in one range, each may come first.
    """
    names = list(sums)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    marked = df.withColumns({f"__{n}": F.coalesce(v, F.lit(0)) for n, v in sums.items()})
    ranged = written(marked.repartitionByRange(*columns).withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = sorted(ranged.groupBy("__range").agg(*[F.sum(f"__{n}").alias(n) for n in names]).collect())
    before, at = [], [0] * len(names)
    for number, *own in totals:
        before.append((number, *at))
        at = [a + b for a, b in zip(at, own, strict=True)]
    kinds = [marked.select(F.sum(f"__{n}")).schema[0].dataType.simpleString() for n in names]
    spark = df.sparkSession
    starts = spark.createDataFrame(before, ", ".join(["__range int", *(f"`__b{i}` {k}" for i, k in enumerate(kinds))]))
    summed = ranged.withColumns({f"__s{i}": F.sum(f"__{n}").over(within) for i, n in enumerate(names)})
    # A row for each range, so as many as the session has shuffle partitions.
    summed = summed.join(F.broadcast(starts), "__range")
    out = summed.withColumns({n: F.col(f"__s{i}") + F.col(f"__b{i}") for i, n in enumerate(names)})
    return out.select(*[c for c in df.columns if c not in names], *names)
