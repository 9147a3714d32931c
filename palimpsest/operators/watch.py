"""Change feeds and watch lists: what changed since a cut-off, and which changes nobody has resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import ADDRESS, address_key
from ..functions.timefmt import since


def summary(feed: DataFrame, cutoff: str, keys: list[str]) -> DataFrame:
    """The newest change of each address since ``cutoff``. ``feed``: keys, ts. The timestamp is aggregated, so the plan
    stays a hash aggregate, and the cut-off reaches the scan."""
    return feed.where(since(F.col("ts"), cutoff)).groupBy(*keys).agg(F.max("ts").alias("ts"))


def page_of_feed(feed: DataFrame, limit: int, offset: int, *ties: str) -> DataFrame:
    """A page of the feed, newest first."""
    return feed.orderBy(F.desc("ts"), *ties).offset(offset).limit(limit)


def merge_newest(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keyed union that keeps the greater value."""
    return a.unionByName(b).groupBy(*keys).agg(F.max(value).alias(value))


def watermark(updates: DataFrame, value: str, last: Column) -> DataFrame:
    """The newest update or ``last``, whichever is later."""
    return updates.agg(F.greatest(F.max(value), last).alias("last_checked"))


def latest_resolved(items: DataFrame) -> DataFrame:
    """(address, resolved): what each address was last resolved at. ``items``: address, status, seq, modified."""
    rows = items.where("status = 'resolved'")
    return rows.groupBy("address").agg(F.max_by("modified", "seq").alias("resolved"))


def unresolved(updates: DataFrame, items: DataFrame, last_checked: str, cutoff: str) -> DataFrame:
    """(address, modified, last_resolved) of the updates to look at: not before ``last_checked`` (the same time counts),
    and later than what the address was last resolved at. ``updates``: address, modified."""
    joined = updates.where(F.col("modified") >= last_checked).join(latest_resolved(items), "address", "left")
    fresh = F.col("resolved").isNull() | (F.col("modified") > F.col("resolved"))
    return joined.where(fresh).select("address", "modified", F.coalesce("resolved", F.lit(cutoff)).alias("last_resolved"))


def resolve(items: DataFrame, address: str, deep: bool = False, delimited: bool = False) -> DataFrame:
    """Items after resolving an address, or with ``deep`` all whose text starts with it (whole parts if ``delimited``).

    Resolved entries are appended behind those that the address has. ``items``: address, status, seq, modified,
    last_resolved.
    """
    stem = address.rstrip(",")
    if deep:
        hit = F.startswith(F.col("address"), F.lit(stem))
        if delimited:
            hit = (F.col("address") == stem) | F.startswith(F.col("address"), F.lit(stem + ","))
    else:
        hit = F.col("address") == address
    last = F.max(F.when(F.col("status") == "resolved", F.col("seq"))).over(Window.partitionBy("address"))
    moved = hit & (F.col("status") == "unresolved")
    return (
        items.withColumn("last", F.coalesce(last, F.lit(0)))
        .withColumn("seq", F.when(moved, F.col("last") + 1).otherwise(F.col("seq")))
        .withColumn("status", F.when(moved, "resolved").otherwise(F.col("status")))
        .drop("last")
    )


def unresolve(items: DataFrame, address: str) -> DataFrame:
    """Items after taking back the last resolution of an address."""
    last = F.max(F.when(F.col("status") == "resolved", F.col("seq"))).over(Window.partitionBy("address"))
    back = (F.col("address") == address) & (F.col("status") == "resolved") & (F.col("seq") == last)
    return items.withColumns(
        {"status": F.when(back, "unresolved").otherwise(F.col("status")), "seq": F.when(back, 0).otherwise(F.col("seq"))}
    )


def migrate(states: DataFrame, cutoff: str) -> DataFrame:
    """States (address, version, modified) of the old layout, one resolved time, as a list of {modified, last_resolved}."""
    one = F.array(F.struct(F.col("modified"), F.lit(cutoff).alias("last_resolved")))
    return states.withColumn("resolved", F.when(F.col("version").isNull(), one)).withColumn(
        "version", F.coalesce("version", F.lit(2))
    )


def needs_resolve(pages: DataFrame, pending: DataFrame) -> DataFrame:
    """Pages (path) that are, or lie above, an address with a pending update (path: array)."""
    above = pending.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path")
    )
    return pages.join(above.distinct(), "path", "left_semi")


def key_of(row: str = "") -> Column:
    """The address key of the five address columns."""
    return address_key(*[F.col(row + p) for p in ADDRESS])


def upsert(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed union in which ``over`` wins."""
    ranked = base.withColumn("rank", F.lit(1)).unionByName(over.withColumn("rank", F.lit(0)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    return ranked.withColumn("rn", first).where("rn = 1").drop("rn", "rank")


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")
