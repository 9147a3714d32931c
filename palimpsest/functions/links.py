"""Links, titles and addresses of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import brackets
from .text import strip

ADDRESS = ("archive", "subarchive", "fond", "opus", "case")
KINDS = ("archive", "fond", "opus", "case")


def is_linked(url: Column) -> Column:
    """A link that is there and doesn't lead to a page yet to be written."""
    return F.coalesce((url != "") & ~F.contains(url, F.lit("redlink")), F.lit(False))


def link_status(url: Column) -> Column:
    return F.when(is_linked(url), "linked").otherwise("unlinked")


def title_of(url: Column, base: str) -> Column:
    """Title of a page's address: without the base and ``/wiki/``, decoded."""
    plain = F.replace(F.replace(url, F.lit(base), F.lit("")), F.lit("/wiki/"), F.lit(""))
    return F.coalesce(F.try_url_decode(plain), plain)


def old_id(url: Column) -> Column:
    """The version that an address asks for, 0 if none."""
    return F.coalesce(F.regexp_extract(url, r"oldid=(\d+)", 1).try_cast("bigint"), F.lit(0))


def with_namespace(title: Column, namespace: str) -> Column:
    return F.concat(F.lit(namespace + ":"), title)


def expand_target(target: Column, title: Column, base: str = "") -> Column:
    """The address of a link's target seen from a page: ``../`` climbs, ``./`` and a leading ``/`` stay below the page, and
    these lose a slash at their end; other targets stand for themselves. Outer white space goes, double slashes are one,
    spaces are underscores. Several ``../`` climb several levels."""
    clean = F.regexp_replace(F.regexp_replace(strip(target), "//+", "/"), " ", "_")
    ups = F.length(F.regexp_extract(clean, r"^((?:\.\./)*)", 1)) / 3
    parts = F.split(title, "/")
    above = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - ups.cast("int"), F.lit(0))), "/")
    rest = F.regexp_replace(F.regexp_replace(clean, r"^(?:(?:\.\./)+|\./|/)", ""), "/+$", "")
    below = F.concat_ws("/", F.nullif(above, F.lit("")), F.nullif(rest, F.lit("")))
    path = F.when(clean.rlike(r"^(\.\.?)?/"), below).otherwise(clean)
    return F.concat(F.lit(base + "/wiki/"), path)


def percent_encode(text: Column) -> Column:
    """Percent-encoded UTF-8, but for letters, digits and ``_.-~/``."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def history_url(title: Column, site: str, limit: int = 1) -> Column:
    """Address that answers with the ``limit`` newest revisions of a page."""
    query = f"{site}/w/api.php?action=query&format=json&prop=revisions&rvprop=ids|timestamp&rvlimit={limit}&titles="
    return F.concat(F.lit(query), percent_encode(title))


def revision_url(title: Column, revid: Column, site: str) -> Column:
    """Address of one revision of a page."""
    return F.concat(F.lit(f"{site}/w/index.php?title="), percent_encode(title), F.lit("&oldid="), revid.cast("string"))


def content_url(titles: Column, site: str) -> Column:
    """Address that answers with the texts of an array of pages."""
    query = f"{site}/w/api.php?action=query&format=json&prop=revisions&rvprop=content&rvslots=main&titles="
    return F.concat(F.lit(query), F.array_join(F.transform(titles, lambda t: percent_encode(t)), "|"))


def subarchive(anchor_title: Column, href: Column, archive: Column | str) -> Column:
    """Name of the sub-archive that an anchor of an archive's page leads to (the archive by name or as a column): titles of two parts that begin with the
    archive, in either spelling of its spaces, but for publications and pages yet to be written; null for others."""
    parts = F.split(anchor_title, "/")
    archive = F.lit(archive) if isinstance(archive, str) else archive
    own = F.startswith(anchor_title, archive) | F.startswith(F.replace(anchor_title, F.lit(" "), F.lit("_")), archive)
    listed = own & ~F.contains(href, F.lit("redlink")) & (F.size(parts) == 2) & (F.get(parts, 1) != "видання")
    return F.when(listed, F.get(parts, 1))


def is_commons(link: Column) -> Column:
    return F.startswith(F.lower(link), F.lit("c:"))


def is_category(link: Column) -> Column:
    return F.startswith(link, F.lit("Категорія:"))


def commons_url(link: Column, base: str = "https://commons.wikimedia.org/wiki/") -> Column:
    return F.when(is_commons(link), F.concat(F.lit(base), F.replace(link.substr(F.lit(3), F.length(link)), F.lit(" "), F.lit("_"))))


def file_url(link: Column) -> Column:
    """Path of a ``File:`` link; null for other links."""
    return F.when(
        F.startswith(F.lower(link), F.lit("file:")),
        F.concat(F.lit("/wiki/File:"), F.replace(link.substr(F.lit(6), F.length(link)), F.lit(" "), F.lit("_"))),
    )


def first_match(*conditions: Column) -> Column:
    """Number of the first condition that holds, from 0; their number if none does."""
    out = F.lit(len(conditions))
    for i, condition in reversed(list(enumerate(conditions))):
        out = F.when(condition, i).otherwise(out)
    return out


def address_key(*parts: Column) -> Column:
    """Parts joined by commas; null parts are empty."""
    return F.concat_ws(",", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def title_address(tag: Column, sub: Column, title: Column) -> Column:
    """Address of a title: tag, sub-archive and the title's parts after the first, as five parts."""
    parts = F.split(title, "/")
    padded = F.concat(F.array(tag, sub), F.slice(parts, 2, 3), F.array_repeat(F.lit(""), 3))
    return F.array_join(F.slice(padded, 1, 5), ",")


def page_path(*parts: Column) -> Column:
    """Non-empty parts joined by slashes."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "/")


def breadcrumb(*parts: Column) -> Column:
    """Parts up to the first empty one, without a ``_`` sub-archive (the second part)."""
    kept = F.filter(F.array(*parts), lambda x, i: ~((i == 1) & (x == "_")))
    stop = F.array_position(F.transform(kept, lambda x: F.coalesce(x == "", F.lit(True))), True)
    return F.when(stop > 0, F.slice(kept, F.lit(1), (stop - 1).cast("int"))).otherwise(kept)


def kind_of(level: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), level)


def hrefs(html: Column) -> Column:
    """(href, text) of the anchors of a page, in order."""
    whole = F.regexp_extract_all(html, F.lit(r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), 0)
    return F.transform(
        whole,
        lambda a: F.struct(
            F.regexp_extract(a, r'href="([^"]*)"', 1).alias("href"),
            F.regexp_replace(a, r"(?s)<[^>]+>", "").alias("text"),
        ),
    )


def wikilinks(text: Column) -> Column:
    """(target, text) of the ``[[target|text]]`` links of a wikitext, in order and nested in any way; the text is empty where
    there is none. Links in comments and in nowiki aren't any."""
    return F.transform(brackets.links(brackets.shown(text)), lambda x: F.struct(strip(x["title"]).alias("target"), x["text"].alias("text")))


def link_classes(text: Column) -> Column:
    """(commons_links, category_links, internal_links, external_links) of a wikitext, each in order."""
    return brackets.once(F.transform(wikilinks(text), lambda x: x["target"]), lambda targets: _classes(text, targets))


def _classes(text: Column, targets: Column) -> Column:
    commons = F.transform(F.filter(targets, is_commons), lambda t: commons_url(t))
    category = F.filter(targets, lambda t: ~is_commons(t) & is_category(t))
    internal = F.filter(targets, lambda t: ~is_commons(t) & ~is_category(t))
    outside = F.regexp_replace(brackets.shown(text), r"\[\[[^\[\]]*\]\]", " ")
    external = F.regexp_extract_all(outside, F.lit(r"(https?://[^\s\[\]{}|<>\x22]+)"), 1)
    return F.struct(
        commons.alias("commons_links"), category.alias("category_links"), internal.alias("internal_links"), external.alias("external_links")
    )


# A file's name in a template, by itself and in an address.
FILE_NAME = r"(\bFile:[^|}\n\r]+)"
FILE_ADDRESS = r"https?://[^\s|}/]+/wiki/File:([^\s|}]+)"


def file_links(text: Column) -> Column:
    """Distinct ``File:`` links of a wikitext: its links, and of each template parameter the links, the names as they stand
    there and the names in addresses."""
    file = lambda t: F.startswith(F.lower(t), F.lit("file:"))

    def of_value(value: Column) -> Column:
        own = F.filter(F.transform(brackets.links(value), lambda x: x["title"]), file)
        named = F.regexp_extract_all(value, F.lit(FILE_ADDRESS), 1)
        addressed = F.transform(named, lambda n: F.concat(F.lit("File:"), F.replace(n, F.lit("_"), F.lit(" "))))
        return F.concat(own, F.regexp_extract_all(value, F.lit(FILE_NAME), 1), addressed)

    def of_text(read: Column) -> Column:
        linked = F.filter(F.transform(brackets.links(read), lambda x: x["title"]), file)
        return F.array_distinct(F.concat(linked, F.flatten(F.transform(brackets.values(read), of_value))))

    return brackets.once(brackets.shown(text), of_text)


def document_url(classes: Column, notes: Column, title: Column, base: str = "") -> Column:
    """A page's first document: its first internal link, else the first shared file of its notes; both are
    :func:`link_classes`."""
    return F.coalesce(expand_target(F.get(classes["internal_links"], 0), title, base), F.get(notes["commons_links"], 0))


def subtract_links(links: Column, minus: Column) -> Column:
    """Bag difference: each element of ``minus`` takes away one occurrence, the first; absent ones none."""
    return F.transform(
        F.filter(
            F.transform(links, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(links, 1, i + 1), lambda y: y == x)).alias("nth"))),
            lambda s: s["nth"] > F.size(F.filter(minus, lambda y: y == s["x"])),
        ),
        lambda s: s["x"],
    )
