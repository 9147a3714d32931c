"""Trees of addresses: roll-up to ancestors, pre-order, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..session import written


def with_ancestors(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Each row for its address and for every ancestor: parts below the ancestor become empty; ``level`` counts from 0."""
    n = len(parts)
    levels = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return levels.withColumns({p: F.when(F.col("level") >= i, F.col(p)).otherwise("") for i, p in enumerate(parts)})


def flatten(leaves: DataFrame, path: str, payload: str) -> DataFrame:
    """Pre-order list of the tree of ``path`` arrays: (path, level, payload), with ancestors that have no payload."""
    nodes = leaves.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))).alias("path")
    ).distinct()
    own = leaves.groupBy(F.col(path).alias("path")).agg(F.max(payload).alias("payload"))
    return nodes.join(own, "path", "left").select("path", (F.size("path") - 1).alias("level"), "payload")


def preorder(path: Column) -> Column:
    """Sort key of a path in pre-order with natural order at each level."""
    return F.transform(path, natural_key)


def find(rows: DataFrame, **parts: str) -> DataFrame:
    """Rows at an address; parts not given are free. A miss is an empty table."""
    for name, value in parts.items():
        rows = rows.where(F.col(name) == value)
    return rows


def find_sub(archives: DataFrame, asked: Column) -> DataFrame:
    """(tag, sub_key): the first sub-archive of each tag that the ask allows: any if null, else by key or English name.

    ``archives``: tag, sub_key, en, ord.
    """
    fits = asked.isNull() | (F.col("sub_key") == asked) | (F.col("en") == asked)
    return archives.where(fits).groupBy("tag").agg(F.min_by("sub_key", "ord").alias("sub_key"))


def lookup(asks: DataFrame, cells: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, entry, tier, found): three tiers for each ask (page, entry).

    0: a row of the page by its key or the last segment of its link; 1: a page named page/entry; 2: a row of a page that
    a row of the page leads to. The lowest tier wins, then the smallest link. ``cells``: page, row_key, link (of the
    first column); ``pages``: page.
    """
    last = F.element_at(F.split("link", "/"), -1)
    hit = (F.col("row_key") == F.col("entry")) | (F.coalesce(F.try_url_decode(last), last) == F.col("entry"))
    own = asks.join(cells, "page").where(hit).select("page", "entry", F.lit(0).alias("tier"), F.col("link").alias("found"))
    shadow = asks.withColumn("found", F.concat_ws("/", "page", "entry")).join(
        pages.select(F.col("page").alias("found")), "found"
    )
    shadow = shadow.select("page", "entry", F.lit(1).alias("tier"), "found")
    below = cells.select("page", F.col("link").alias("child")).join(
        cells.select(F.col("page").alias("child"), "row_key", "link"), "child"
    )
    deep = asks.join(below, "page").where(hit).select("page", "entry", F.lit(2).alias("tier"), F.col("link").alias("found"))
    best = F.min(F.struct("tier", "found")).alias("r")
    return own.unionByName(shadow).unionByName(deep).groupBy("page", "entry").agg(best).select("page", "entry", "r.tier", "r.found")


def deep_lookup(asks: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, entry, place, found): the first row in depth-first order, below a page, that has an entry as its key.

    ``asks``: page, entry; ``cells``: page, ord (long), row_key, link, the page a row leads to. ``place`` are the ``ord`` of
    the rows that lead to the hit; of rows with equal ``ord`` the smaller link comes first. One round for each level: what
    comes after an ask's best hit so far is given up, and so is a page that an earlier place has led to, which ends
    circles. Only pages are entered from which a row with the entry can be reached. Asks without a hit and nulls give no row.
    Rounds are written; a round holds the open places of all asks.
    """
    rows = cells.select(F.col("page").alias("at"), F.struct("ord", "link").alias("step"), "row_key", "link")
    open_ = asks.where("page is not null and entry is not null").distinct().select("page", "entry", F.col("page").alias("at"), F.array().cast(rows.select(F.array("step")).schema[0].dataType).alias("path"))
    leads = written(_leading(asks, cells), "leads")
    open_ = open_.join(leads, ["at", "entry"], "left_semi").select("page", "entry", "at", "path")
    seen, best = open_, None
    while True:
        below = open_.join(rows, "at").select("page", "entry", "link", "row_key", F.array_append("path", F.col("step")).alias("path"))
        below = written(below, "below")
        hits = below.where("row_key = entry").select("page", "entry", "path", "link")
        best = hits if best is None else best.unionByName(hits)
        best = written(best.groupBy("page", "entry").agg(F.min(F.struct("path", "link")).alias("b")).select("page", "entry", "b.*"), "hits")
        first = best.select("page", "entry", F.col("path").alias("limit"))
        step = below.where("link is not null").join(leads.withColumnRenamed("at", "link"), ["link", "entry"], "left_semi").groupBy("page", "entry", F.col("link").alias("at")).agg(F.min("path").alias("path"))
        step = step.join(first, ["page", "entry"], "left").where("limit is null or path < limit").drop("limit")
        known = seen.select("page", "entry", "at", F.col("path").alias("known"))
        open_ = written(step.join(known, ["page", "entry", "at"], "left").where("known is null or path < known").drop("known"), "open")
        if open_.isEmpty():
            return best.select("page", "entry", F.transform("path", lambda s: s["ord"]).alias("place"), F.col("link").alias("found"))
        seen = seen.unionByName(open_).groupBy("page", "entry", "at").agg(F.min("path").alias("path"))
        seen = written(seen, "seen")


def _leading(asks: DataFrame, cells: DataFrame) -> DataFrame:
    """(at, entry): the pages from which a row with an entry of the asks as its key can be reached, found upwards from those
    rows; a round for each level, and each pair is gone on from once."""
    entries = asks.select("entry").where("entry is not null").distinct()
    above = cells.where("page is not null and link is not null and page <> link").select(F.col("page").alias("above"), F.col("link").alias("at"))
    new = cells.where("page is not null").join(entries, F.col("row_key") == F.col("entry")).select(F.col("page").alias("at"), "entry")
    new = known = written(new.distinct(), "leads")
    while not new.isEmpty():
        up = new.join(above, "at").select(F.col("above").alias("at"), "entry").distinct()
        new = written(up.join(known, ["at", "entry"], "left_anti"), "leads")
        known = known.unionByName(new)
    return known
