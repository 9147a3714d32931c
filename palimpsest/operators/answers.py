"""Answers of a wiki's service, whole JSON bodies, as tables of pages, texts, histories and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.brackets import once
from ..functions.links import file_links, file_url
from ..functions.timefmt import from_utc

_CHANGES = "array<struct<`from`:string,`to`:string>>"
_REVISION = "struct<revid:bigint,timestamp:string,slots:struct<main:struct<`*`:string>>>"
_PAGE = f"struct<title:string,missing:string,invalid:string,revisions:array<{_REVISION}>>"
#: An answer, as far as it is read; pages are under keys of their own.
ANSWER = (
    f"query struct<normalized:{_CHANGES},redirects:{_CHANGES},pages:map<string,{_PAGE}>>, parse struct<title:string,revid:bigint,wikitext:struct<`*`:string>>, error struct<code:string,info:string>"
)
#: Steps of pointer doubling: enough for chains of as many titles as one answer can have (50).
DOUBLINGS = 6


def read(body: Column) -> Column:
    """The answer in a body; null fields where it has none, all null for what is no JSON."""
    return F.from_json(body, ANSWER)


def final_titles(answer: Column) -> Column:
    """A map from each title that an answer says is written or named otherwise to the title of its page: normalised, then
    redirected, as often as that goes. Chains are followed by doubling; one that ends in a circle stays within it."""
    changes = F.concat(*(F.coalesce(answer["query"][k], F.array().cast(_CHANGES)) for k in ("normalized", "redirects")))
    # Of several that rename one title the last counts.
    firsts = F.filter(
        F.transform(changes, lambda c, i: F.struct(c["from"].alias("key"), c["to"].alias("value"), i.alias("i"))),
        lambda c: c["key"].isNotNull() & c["value"].isNotNull(),
    )
    own = once(firsts, lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda d: (d["key"] == c["key"]) & (d["i"] > c["i"]))))
    step = F.map_from_entries(F.transform(own, lambda c: F.struct(c["key"], c["value"])))
    for _ in range(DOUBLINGS):
        step = once(step, lambda m: F.transform_values(m, lambda _, v: F.coalesce(F.try_element_at(m, v), v)))
    return step


def pages(answers: DataFrame, body: str = "body") -> DataFrame:
    """``answers`` with ``title`` and ``page`` for each page of an answer of the query kind."""
    rest = [c for c in answers.columns if c != body]
    found = answers.select(*rest, F.explode(F.map_values(read(F.col(body))["query"]["pages"])).alias("page"))
    return found.select(*rest, F.col("page.title").alias("title"), "page")


def existence(asked: DataFrame, body: str = "body", titles: str = "titles") -> DataFrame:
    """(title, exists): for each title that was asked for (an array beside the answer), whether its page, by whatever name
    it is now, is there: neither missing nor invalid. A title that the answer doesn't tell of doesn't exist; one that was
    asked for several times exists if any answer has it. Null titles are ignored."""
    told = asked.select(F.col(titles).alias("titles"), read(F.col(body)).alias("a"))
    found = F.map_values("a.query.pages")
    there = F.transform(F.filter(found, lambda p: p["missing"].isNull() & p["invalid"].isNull()), lambda p: p["title"])
    rows = told.select("titles", F.coalesce(there, F.array().cast("array<string>")).alias("there"), final_titles(F.col("a")).alias("final"))
    each = rows.select("there", "final", F.explode(F.array_distinct("titles")).alias("title")).where("title is not null")
    page = F.coalesce(F.try_element_at("final", F.col("title")), F.col("title"))
    return each.groupBy("title").agg(F.max(F.array_contains("there", page)).alias("exists"))


def contents(answers: DataFrame, body: str = "body") -> DataFrame:
    """``answers`` with (title, revid, wikitext, error) of answers of the parse kind; ``error`` is the service's own, or
    ``no answer`` where there is neither. The namespace before the title's first colon is dropped."""
    rest = [c for c in answers.columns if c != body]
    told = answers.select(*rest, read(F.col(body)).alias("a"))
    title = F.regexp_replace("a.parse.title", "^[^:/]*:", "")
    error = F.coalesce("a.error.info", "a.error.code", F.when(F.col("a.parse").isNull(), "no answer"))
    return told.select(*rest, title.alias("title"), F.col("a.parse.revid").alias("revid"), F.col("a.parse.wikitext")["*"].alias("wikitext"), error.alias("error"))


def histories(answers: DataFrame, body: str = "body") -> DataFrame:
    """(title, revid, modified) of all revisions of the pages of answers, the time in standard form."""
    found = pages(answers.select(body), body).select("title", F.explode("page.revisions").alias("r"))
    return found.select("title", "r.revid", from_utc(F.col("r.timestamp")).alias("modified"))


def documents(answers: DataFrame, body: str = "body") -> DataFrame:
    """(title, links): the distinct addresses of the files that each page's text names; none for pages without a text. The
    namespace of the title is dropped."""
    found = pages(answers.select(body), body)
    text = F.get("page.revisions", 0)["slots"]["main"]["*"]
    named = F.array_compact(F.array_distinct(F.transform(file_links(text), file_url)))
    return found.select(F.regexp_replace("title", "^[^:]*:", "").alias("title"), F.coalesce(named, F.array().cast("array<string>")).alias("links"))
