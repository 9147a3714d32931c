"""What a service over the tables asks for, as one class: pages, comparisons, watch lists, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.links import ADDRESS
from .functions.timefmt import until
from .operators import diff, history, lists, ops, tree, watch


class Library:
    """Tables of a library of versioned pages.

    ``versions``: archive, subarchive, fond, opus, case, page, ts, revid, title; ``cells``: page, revid, row_key, row, col,
    text (a text item), link; ``items``: address, status, seq, modified; ``log``: ts, message.
    """

    def __init__(self, versions: DataFrame, cells: DataFrame, items: DataFrame | None = None, log: DataFrame | None = None):
        self.versions, self.cells, self.items, self.log_rows = versions, cells, items, log

    def archives(self) -> DataFrame:
        """All (archive, subarchive) pairs."""
        return self.versions.select("archive", "subarchive").distinct()

    def find(self, **address: str) -> DataFrame:
        """Versions at an address; parts that aren't given are empty. An unknown address gives no rows."""
        return tree.find(self.versions, **{p: address.get(p, "") for p in ADDRESS})

    def page(self, compare: str | None = None, **address: str) -> DataFrame:
        """The newest version's cells; with ``compare``, a cut-off, with their edits since the version as of then."""
        found = self.find(**address)
        newest = history.latest(found.select("page", "revid", "ts"), 1).select("page", "revid")
        now = self.cells.join(newest, ["page", "revid"]).drop("revid")
        if compare is None:
            return now
        then = history.as_of(found.select("page", "revid", "ts"), compare).select("page", "revid")
        return diff.diff_cells(now, self.cells.join(then, ["page", "revid"]).drop("revid"))

    def history(self, most: int = 30, **address: str) -> DataFrame:
        """A page's compressed history."""
        return history.compress(self.find(**address).select("page", "revid", "ts"), most)

    def as_json(self, **address: str) -> DataFrame:
        """The newest version's row as JSON."""
        newest = history.latest(self.find(**address), 1)
        return newest.select(lists.page_json(*ADDRESS, "page", "revid", "title").alias("json"))

    def check(self, last_checked: str, cutoff: str) -> DataFrame:
        """Unresolved changes since the last check."""
        from .functions.links import address_key
        from .functions.timefmt import standard

        newest = watch.summary(self.versions, last_checked, list(ADDRESS))
        updates = newest.select(address_key(*[F.col(p) for p in ADDRESS]).alias("address"), standard(F.col("ts")).alias("modified"))
        return watch.unresolved(updates, self.items, last_checked, cutoff)

    def resolve(self, address: str, deep: bool = False) -> DataFrame:
        """The watch list after an address is resolved, with ``deep`` and all whose text it starts."""
        return watch.resolve(self.items, address, deep)

    def before(self, cutoff: str) -> DataFrame:
        """Versions at or before a cut-off."""
        return self.versions.where(until(F.col("ts"), cutoff))

    def log(self, limit: int = 100) -> DataFrame:
        return ops.tail(self.log_rows, limit, "ts")
