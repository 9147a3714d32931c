"""Lists of archives and of cells: overrides, row hits, parsed cells, pages as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_text
from .watch import upsert

#: Cyrillic sub-archive letters and the Latin ones that stand for them.
LETTERS = {"Р": "R", "А": "A"}


def latin_sub(sub: Column) -> Column:
    """A sub-archive's name in Latin letters where it is one of the two Cyrillic letters."""
    out = sub
    for cyrillic, latin in LETTERS.items():
        out = F.when(sub == cyrillic, latin).otherwise(out)
    return out


def master_list(found: DataFrame, fonds: DataFrame) -> DataFrame:
    """(tag, sub_key, title): sub-archives that pages name, under Latin letters, and over them the separately listed fonds,
    whose tag and sub-archive are one text joined by a dash; without one the sub-archive is ``_``.

    ``found``: tag, sub_key, title; ``fonds``: name, title.
    """
    parts = F.split("name", "-", 2)
    listed = fonds.select(parts[0].alias("tag"), F.coalesce(F.get(parts, 1), F.lit("_")).alias("sub_key"), "title")
    return upsert(found.withColumn("sub_key", latin_sub(F.col("sub_key"))), listed, ["tag", "sub_key"])


def row_hit(item: Column, link: Column, entry: Column) -> Column:
    """Whether a row is the asked one: by either text of its key, or by the last part of its link."""
    last = F.element_at(F.split(link, "/"), -1)
    return match_text(item, entry) | F.coalesce(F.coalesce(F.try_url_decode(last), last) == entry, F.lit(False))


def parse_number_cell(text: Column) -> Column:
    """(number, url, date) of ``12 (http://x) 1900-01``; absent parts are empty."""
    return F.struct(
        F.regexp_extract(text, r"^\s*([0-9]+)", 1).alias("number"),
        F.regexp_extract(text, r"\((https?://[^)]*)\)", 1).alias("url"),
        F.regexp_extract(text, r"\)\s*([0-9-]+)$", 1).alias("date"),
    )


def page_json(*columns: str) -> Column:
    """Columns as one JSON object; nulls are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def rekey(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(old, new): keys of two lists that share a value. ``entries``: old, value; ``names``: new, value."""
    return entries.join(names, "value").select("old", "new")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` less one occurrence for each row of ``b``."""
    return a.exceptAll(b)


def item_json(item: Column) -> Column:
    """A text item, with ``edit`` if it has been compared, as a struct that JSON shows without what isn't set."""
    shown = [F.when(item["en_set"], item["en"]).alias("en"), item["uk"].alias("uk")]
    return F.struct(*shown)


def page_document(page: DataFrame) -> DataFrame:
    """(page, json): pages as a service answers with them, under the documented keys and no others.

    ``page``: page, archive, subarchive, name, kind, lastmod, link, doc_link, title, description, header (an array of text
    items), children, history (any array). The address is read from the name's parts; ``needs_translation`` is whether any
    text item has no translation. Nulls are left out.
    """
    part = lambda i: F.get(F.split("name", "/"), i)
    child = lambda c: F.transform(c, lambda x: F.struct(*([x["edit"].alias("edit")] if compared else []), x["link"].alias("link"), item_json(x["text"]).alias("text")))
    compared = "edit" in page.schema["children"].dataType.elementType.elementType.fieldNames()
    untold = lambda x: ~x["en_set"]
    needs = (
        untold(F.col("title")) | untold(F.col("description")) | F.exists("header", untold) | F.exists("children", lambda c: F.exists(c, lambda x: untold(x["text"])))
    )
    shown = F.struct(
        "archive", part(3).alias("case"), F.transform("children", child).alias("children"), item_json(F.col("description")).alias("description"), "doc_link", part(1).alias("fond"),
        F.transform("header", item_json).alias("header"), "history", "kind", "lastmod", "link", "name", needs.alias("needs_translation"), part(2).alias("opus"), "subarchive",
        item_json(F.col("title")).alias("title"),
    )
    return page.select("page", F.to_json(shown).alias("json"))
