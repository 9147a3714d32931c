"""What a reader of pages asks: which versions can be chosen, what a click leads to, which tasks run, what an answer holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import address_key, is_linked


def eligible_history(minutes: DataFrame, current: DataFrame) -> DataFrame:
    """Versions (page, modified, ...) but for the one that is shown. ``current``: page, lastmod. Pages that aren't shown have
    no row; a null lastmod excludes nothing."""
    return minutes.join(current, "page").where(~F.col("modified").eqNullSafe(F.col("lastmod"))).drop("lastmod")


def is_comparison(refmod: Column, lastmod: Column) -> Column:
    """Whether a page is shown against another version of it."""
    return refmod.isNotNull() & ~refmod.eqNullSafe(lastmod)


def is_clickable(kind: Column, link: Column) -> Column:
    """Whether a row leads to a page: rows of cases and rows without a link don't."""
    return F.coalesce(kind != "case", F.lit(False)) & is_linked(link)


def child_address(kind: Column, child: Column, archive: Column, subarchive: Column, fond: Column, opus: Column) -> Column:
    """Address of the page that a row of a page leads to; null for rows of cases and of other kinds."""
    none = F.lit(None).cast("string")
    return (
        F.when(kind == "archive", address_key(archive, subarchive, child, none, none))
        .when(kind == "fond", address_key(archive, subarchive, fond, child, none))
        .when(kind == "opus", address_key(archive, subarchive, fond, opus, child))
    )


def active_tasks(owners: DataFrame, tasks: DataFrame) -> DataFrame:
    """(user, page, progress, total, running) of each user's tasks. ``owners``: user, task; a pair that repeats counts once;
    ``tasks``: task, page, progress, total, running."""
    return owners.distinct().join(tasks, "task").select("user", "page", "progress", "total", "running")


def _tenths(value: Column) -> Column:
    """A number from 0 in tenths, to the nearest one of what the double holds exactly; of two equally near the even one. Its
    fraction is a whole number of 57th powers of a half wherever a tie can be, so nothing is rounded on the way."""
    whole = F.floor(value)
    part = ((value - whole) * float(1 << 57)).cast("long") * 10
    down = F.shiftright(part, 57)
    rest, half = part - F.shiftleft(down, 57), F.lit(1 << 56)
    return whole * 10 + down + F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)


def progress_line(page: Column, progress: Column, total: Column) -> Column:
    """``page 3/4 75.0%``; without a total the percentage is missing."""
    tenths = _tenths(F.try_divide(progress * F.lit(100.0), total.cast("double")))
    share = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    known = F.concat_ws("/", progress.cast("string"), total.cast("string"))
    return F.concat_ws(" ", page, known, F.when(total > 0, share))


def answers(text: Column, n: Column) -> Column:
    """The strings of a JSON list of ``n`` strings; null for other texts, which a caller counts as a failed answer."""
    found = F.from_json(text, "array<string>")
    shape = F.startswith(F.ltrim(text), F.lit("["))
    return F.when(shape & (F.size(found) == n), found)


def cache_path(name: Column, folder: str = "page_cache") -> Column:
    return F.concat(F.lit(folder + "/"), name)


def watch_key(user: Column, archive: Column, subarchive: Column) -> Column:
    """Key of a user's watch on an archive."""
    return F.concat_ws("/", user, F.concat_ws("-", archive, subarchive))


def collated(text: Column) -> Column:
    """A sort key by the Unicode collation, as readers expect it: case and accents matter last."""
    return F.collate(text, "UNICODE")


def numeric_order(ids: Column) -> Column:
    """An array of numbers written as text, in the order of the numbers; others come first, as they stand."""
    pairs = F.transform(ids, lambda x: F.struct(x.try_cast("bigint").alias("n"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda p: p["x"])
