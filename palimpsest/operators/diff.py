"""Comparison of two versions of a table, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.brackets import once
from ..functions.links import is_linked
from ..functions.text import equal_text, get_text


def link_edit(now: Column, then: Column) -> Column:
    """``changed`` if both are links and differ, ``added`` if only the newer is one."""
    return F.when(is_linked(now) & is_linked(then) & (now != then), "changed").when(is_linked(now) & ~is_linked(then), "added")


def older_rows(then: DataFrame) -> DataFrame:
    """(page, row_key, cells): the cells of the last row of each key of a page. One exchange by page and key serves both
    steps and the join that follows; a row's cells are gathered, a key's rows aren't."""
    cells = F.collect_list(F.struct("col", "text", "link")).alias("cells")
    rows = then.repartition("page", "row_key").groupBy("page", "row_key", "row").agg(cells)
    return rows.groupBy("page", "row_key").agg(F.max_by("cells", "row").alias("cells"))


def diff_cells(now: DataFrame, then: DataFrame) -> DataFrame:
    """``now``'s cells with ``edit`` (added, changed or null) and ``link_edit``.

    Cells are (page, row_key, row, col, text, link), ``text`` a text item. Rows match by page and key, the last of the
    older version's rows of one key; cells by column, the first of a column. A row without a match is all added and has no
    link edits; a cell without a partner in a matched row has none. Null keys match nothing.
    """
    joined = now.join(older_rows(then), ["page", "row_key"], "left")
    other = F.get(F.filter("cells", lambda c: c["col"] == F.col("col")), 0)
    edits = joined.withColumn("__other", other)
    there = F.col("__other").isNotNull()
    edit = F.when(F.col("cells").isNull(), "added").when(there & ~equal_text(F.col("text"), F.col("__other.text")), "changed")
    links = F.when(there, link_edit(F.col("link"), F.col("__other.link")))
    return edits.withColumns({"edit": edit, "link_edit": links}).drop("cells", "__other")


def diff_rows(now: DataFrame, then: DataFrame) -> DataFrame:
    """The same for whole rows (page, row_key, row, cells), cells an array of (col, text, link): ``now``'s rows, each cell with
    ``edit`` and ``link_edit``, and whether a cell has one (``edited``). A row is dealt once, not once a cell, and of the older rows of a key only the last."""
    older = then.groupBy("page", "row_key").agg(F.max_by("cells", "row").alias("__old"))
    return _told(now.join(older, ["page", "row_key"], "left"))


def diff_versions(rows: DataFrame) -> DataFrame:
    """The same for a table of both versions: (page, row_key, row, cells, then), ``then`` the older version's cells; null for
    a row that a version lacks. One window by page and key instead of a join, so a table that is dealt by page already isn't
    dealt again; the rows of one key of a page are in one task, which spills them where they are many."""
    by_key = Window.partitionBy("page", "row_key")
    last = F.max_by("then", F.when(F.col("then").isNotNull(), F.col("row"))).over(by_key)
    matched = F.col("page").isNotNull() & F.col("row_key").isNotNull()
    found = rows.withColumn("__last", last).where(F.col("cells").isNotNull())
    return _told(found.withColumn("__old", F.when(matched, F.col("__last"))).drop("then", "__last"))


def _told(joined: DataFrame) -> DataFrame:
    """Rows with the edits of their cells, by the cells of ``__old``, and whether there is one (``edited``)."""
    alone = F.col("__old").isNull()

    def with_partner(cell: Column, body) -> Column:
        return once(F.get(F.filter("__old", lambda c: c["col"] == cell["col"]), 0), body)

    def differs(cell: Column, other: Column) -> Column:
        return other.isNotNull() & (~equal_text(cell["text"], other["text"]) | link_edit(cell["link"], other["link"]).isNotNull())

    # Where only this is asked for no cell is made, and the first edit of a row is enough.
    edited = F.exists("cells", lambda c: alone | with_partner(c, lambda other: differs(c, other)))
    told = F.transform("cells", lambda c: with_partner(c, lambda other: _edited(c, other, alone)))
    return joined.withColumns({"cells": told, "edited": edited}).drop("__old")


def _edited(cell: Column, other: Column, alone: Column) -> Column:
    """A cell with its edits, by its partner; ``alone``: its row has none."""
    edit = F.when(alone, "added").when(other.isNotNull() & ~equal_text(cell["text"], other["text"]), "changed")
    links = F.when(other.isNotNull(), link_edit(cell["link"], other["link"]))
    return cell.withField("edit", edit).withField("link_edit", links)


def compare_pages(now: DataFrame, then: DataFrame) -> DataFrame:
    """``now``'s pages with what has changed since ``then``, each page one nested row.

    Pages are (page, lastmod, title, description, children): two text items, and an array of rows, each an array of cells
    of a text item and a link. The result has ``refmod``, the older version's lastmod; title and description with
    ``edit``; and the children's cells with ``edit`` and ``link_edit``. Rows match by the text of their first cells, of
    older ones with the same text the last; cells by place, as far as both rows have them. A page without an older version
    has null for all of these. Pages must be distinct; one join.
    """
    # A null text is a key like any other.
    key = lambda row: F.coalesce(F.concat(F.lit("="), get_text(F.get(row, 0)["text"])), F.lit(""))
    old = then.select("page", F.struct("lastmod", "title", "description", "children").alias("__old"))

    def compared(children: Column, old: Column) -> Column:
        """``old``: the older rows and, backwards, their keys."""

        def row(child: Column) -> Column:
            at = F.coalesce(F.array_position(old["keys"], key(child)), F.lit(0))
            partner = F.when(at > 0, F.get(old["rows"], (F.size(old["rows"]) - at).cast("int")))
            return once(partner, lambda other: F.transform(child, lambda cell, i: _edited(cell, F.get(other, i), other.isNull())))

        return F.transform(children, row)

    def marked(item: Column, other: Column) -> Column:
        return item.withField("edit", F.when(F.col("__old").isNotNull() & ~equal_text(item, other), "changed"))

    keys = F.reverse(F.transform("__old.children", key))
    older = F.struct(F.col("__old.children").alias("rows"), keys.alias("keys"))
    nothing = lambda: F.transform("children", lambda c: F.transform(c, lambda x: x.withField("edit", F.lit(None).cast("string")).withField("link_edit", F.lit(None).cast("string"))))
    joined = now.join(old, "page", "left")
    return joined.withColumns(
        {
            "refmod": F.col("__old.lastmod"),
            "title": marked(F.col("title"), F.col("__old.title")),
            "description": marked(F.col("description"), F.col("__old.description")),
            "children": F.when(F.col("__old").isNull(), nothing()).otherwise(once(older, lambda o: compared(F.col("children"), o))),
        }
    ).drop("__old")


def edited_rows(diffed: DataFrame) -> DataFrame:
    """Keys of rows with an edit, of rows that ``diff_rows`` or ``diff_versions`` gives."""
    return diffed.where("edited").select("page", "row_key", "row").distinct()


def any_edit(diffed: DataFrame) -> DataFrame:
    """Whether each page has an edit in a row, of rows that ``diff_rows`` or ``diff_versions`` gives."""
    return diffed.groupBy("page").agg(F.max("edited").alias("any_edit"))


def deleted_rows(now: DataFrame, then: DataFrame) -> DataFrame:
    """Rows of the older version whose key the newer one lacks."""
    return then.select("page", "row_key").distinct().join(now, ["page", "row_key"], "left_anti")
