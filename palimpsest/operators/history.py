"""Revision histories: newest versions, slices from a cut-off, versions as of a time, compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import standard, until



def _newest(page: str = "page"):
    return Window.partitionBy(page).orderBy(F.desc("ts"), F.desc("revid"))


def latest(revisions: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` newest revisions of each page. ``revisions``: page, revid, ts."""
    return revisions.withColumn("rn", F.row_number().over(_newest())).where(F.col("rn") <= limit).drop("rn")


def from_cutoff(revisions: DataFrame, cutoff: str) -> DataFrame:
    """Each page's revisions after ``cutoff`` and the newest at or before it; ``created`` marks the oldest revision of a
    page whose history doesn't reach the cut-off."""
    old = F.when(until(F.col("ts"), cutoff), 1).otherwise(0)
    upto = F.sum(old).over(_newest().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy("page")
    oldest = F.row_number().over(Window.partitionBy("page").orderBy("ts", "revid")) == 1
    return (
        revisions.withColumn("old", upto)
        .withColumn("created", oldest & (F.sum(old).over(whole) == 0))
        .where((F.col("old") == 0) | ((F.col("old") == 1) & until(F.col("ts"), cutoff)))
        .drop("old")
    )


def as_of(revisions: DataFrame, cutoff: str, or_oldest: bool = True) -> DataFrame:
    """The newest revision of each page at or before ``cutoff``; without one the oldest, or null if not ``or_oldest``."""
    row = F.struct("ts", "revid")
    newest = F.max(F.when(until(F.col("ts"), cutoff), row))
    picked = F.coalesce(newest, F.min(row)) if or_oldest else newest
    return revisions.groupBy("page").agg(picked.alias("r")).select("page", "r.ts", "r.revid")


def as_of_rows(asks: DataFrame, revisions: DataFrame) -> DataFrame:
    """For each row of ``asks`` (page, at, ...) the newest revision of its page at or before ``at``; null without one.

    Asks and revisions are merged in one sort by page and time, so a page's revisions are passed once, not once an ask.
    """
    names = [c for c in asks.columns if c != "page"]
    left = asks.select("page", F.col("at").alias("t"), F.lit(1).alias("side"), F.struct(*names).alias("ask"))
    right = revisions.select("page", F.col("ts").alias("t"), F.lit(0).alias("side"), "revid")
    merged = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("page").orderBy("t", "side", "revid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        merged.withColumn("revid", F.last("revid", ignorenulls=True).over(order))
        .where("side = 1")
        .select("page", *[F.col(f"ask.{n}").alias(n) for n in names], "revid")
    )


def one_per_minute(revisions: DataFrame) -> DataFrame:
    """The highest revision of each page and minute."""
    return revisions.groupBy("page", standard(F.col("ts")).alias("modified")).agg(F.max("revid").alias("revid"))


def oldest_per_day(minutes: DataFrame) -> DataFrame:
    """The first minute of each page and day. ``minutes``: page, modified, revid."""
    first = F.min(F.struct("modified", "revid")).alias("r")
    return minutes.groupBy("page", F.substring("modified", 1, 10).alias("day")).agg(first).select("page", "r.modified", "r.revid")


def compress(revisions: DataFrame, most: int = 30) -> DataFrame:
    """A page's minutes if they are at most ``most``, else the ``most`` newest of one per day (its first)."""
    minutes = one_per_minute(revisions)
    counted = minutes.withColumn("n", F.count("*").over(Window.partitionBy("page")))
    few = counted.where(F.col("n") <= most).drop("n")
    newest = Window.partitionBy("page").orderBy(F.desc("modified"))
    many = oldest_per_day(counted.where(F.col("n") > most).drop("n"))
    many = many.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= most).drop("rn")
    return few.unionByName(many)


def is_latest(revisions: DataFrame) -> DataFrame:
    return revisions.withColumn("is_latest", F.col("ts") == F.max("ts").over(Window.partitionBy("page")))


