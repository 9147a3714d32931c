"""Columns from elsewhere: document links, existence, translations, labels of table columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import is_linked

REQUIRED, OTHER = ("ID", "DESCRIPTION", "DATE"), "OTHER"


class Translator(Protocol):
    """A function of a batch of texts; raises TimeoutError when it should be asked again."""

    def __call__(self, texts: list[str]) -> list[str | None]: ...


def patiently(call: Callable, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` with up to ``tries`` attempts, 1, 2, 4, ... seconds apart; a batch of nulls if all time out."""

    def run(texts: list[str]) -> list[str | None]:
        for attempt in range(tries):
            try:
                return call(texts)
            except TimeoutError:
                wait(2.0**attempt)
        return [None] * len(texts)

    return run


def translate(texts: DataFrame, translator: Translator, batch: int = 10, workers: int = 8) -> DataFrame:
    """(text, translation) of the distinct texts of column ``text``, asked for in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = patiently(translator)
        for frame in frames:
            given = frame["text"].tolist()
            got = [t for i in range(0, len(given), batch) for t in ask(given[i : i + batch])]
            yield pd.DataFrame({"text": given, "translation": pd.Series(got, dtype=object)})

    distinct = texts.select("text").where("text IS NOT NULL").distinct()
    return distinct.repartition(workers).mapInPandas(run, "text string, translation string")


def set_translations(items: DataFrame, item: str, found: DataFrame) -> DataFrame:
    """``items`` whose unset translations are those of ``found`` (text, translation), null included."""
    ask = F.when(~F.col(item)["en_set"], F.col(item)["uk"])
    joined = items.withColumn("ask", ask).join(found.withColumnRenamed("text", "ask"), "ask", "left")
    new = F.struct(
        F.col(item)["uk"].alias("uk"),
        F.when(F.col(item)["en_set"], F.col(item)["en"]).otherwise(F.col("translation")).alias("en"),
        F.lit(True).alias("en_set"),
    )
    return joined.withColumn(item, new).drop("ask", "translation")


def exists(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``links`` (title, ...) with ``exists``: what ``pages`` (title, exists) says, true for titles that it lacks."""
    return links.join(pages, "title", "left").withColumn("exists", F.coalesce("exists", F.lit(True)))


def fill_document_links(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (title, key_link, doc_link) whose key is linked and whose document isn't get the first file of their page.

    ``files``: title, pos, url.
    """
    first = files.groupBy("title").agg(F.min_by("url", "pos").alias("file"))
    wanting = is_linked(F.col("key_link")) & ~is_linked(F.col("doc_link"))
    joined = rows.join(first, "title", "left")
    return joined.withColumn("doc_link", F.when(wanting, F.coalesce("file", "doc_link")).otherwise(F.col("doc_link"))).drop("file")


def normalise_labels(labels: DataFrame) -> DataFrame:
    """(table, pos, label) with unknown labels and repeats of required ones as OTHER."""
    known = F.col("label").isin(*REQUIRED)
    nth = F.row_number().over(Window.partitionBy("table", "label").orderBy("pos"))
    return labels.withColumn("label", F.when(known & (nth == 1), F.col("label")).otherwise(OTHER))


def label_verdicts(labels: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(table, usable, valid): all required labels are there; and nothing had to be normalised either."""
    known = F.col("label").isin(*required, OTHER)
    repeat = F.col("label").isin(*required) & (
        F.row_number().over(Window.partitionBy("table", "label").orderBy("pos")) > 1
    )
    seen = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), F.collect_set("label"))) == 0
    return (
        labels.withColumn("odd", ~known | repeat)
        .groupBy("table")
        .agg(seen.alias("usable"), F.max("odd").alias("odd"))
        .select("table", "usable", (F.col("usable") & ~F.col("odd")).alias("valid"))
    )


def column_map(labels: DataFrame) -> DataFrame:
    """(table, label, index): the last position of each label."""
    return labels.groupBy("table", "label").agg(F.max("pos").alias("index"))


def default_labels(n: Column) -> Column:
    """Labels when no classifier answers: the required ones and OTHER for the rest, cut to ``n`` columns."""
    some = F.concat(F.array(*[F.lit(r) for r in REQUIRED]), F.array_repeat(F.lit(OTHER), n))
    return F.slice(some, F.lit(1), n)


def classify_columns(samples: DataFrame) -> DataFrame:
    """(table, pos, label) by rule: the first column is the ID, the column with most dates the DATE, and the longest of
    the others the DESCRIPTION. ``samples``: table, pos, value."""
    stats = samples.groupBy("table", "pos").agg(
        F.avg(F.col("value").rlike(r"[0-9]{4}").cast("int")).alias("dates"), F.avg(F.length("value")).alias("width")
    )
    first = F.min("pos").over(Window.partitionBy("table"))
    by_date = F.row_number().over(Window.partitionBy("table", "id").orderBy(F.desc("dates"), "pos"))
    stats = stats.withColumn("id", F.col("pos") == first)
    stats = stats.withColumn("date", ~F.col("id") & (by_date == 1) & (F.col("dates") >= 0.5))
    by_width = F.row_number().over(Window.partitionBy("table", "id", "date").orderBy(F.desc("width"), "pos"))
    label = F.when(F.col("id"), "ID").when(F.col("date"), "DATE").when(by_width == 1, "DESCRIPTION").otherwise(OTHER)
    return stats.select("table", "pos", label.alias("label"))


class Client(Protocol):
    """A function of a batch of questions to a chat model; raises ConnectionError when the service fails."""

    def __call__(self, questions: list[str]) -> list[str | None]: ...


def samples(children: Column, rows: int = 3) -> Column:
    """The original texts of a page's first rows, an array for each."""
    return F.transform(F.slice(children, 1, rows), lambda row: F.transform(row, lambda cell: cell["text"]["uk"]))


def question(header: Column, rows: Column, hints: str = "The ID column is always first.") -> Column:
    """What a chat model is asked for the labels of a table's columns: of a header, an array of text items, and sample rows.
    The same as :func:`prompt` gives of their texts."""
    joined = lambda texts: F.array_join(texts, " | ", "")
    names = F.transform(header, lambda h: h["uk"])
    lines = F.concat(
        F.array(
            F.format_string(f"Label each of the %d columns with one of: {', '.join((*REQUIRED, OTHER))}.", F.size(header)),
            F.concat(F.lit("Header: "), joined(names)),
        ),
        F.transform(rows, lambda r: F.concat(F.lit("Row: "), joined(r))),
        F.array(*map(F.lit, ([hints] if hints else []) + ["Answer with a JSON list of strings."])),
    )
    return F.array_join(lines, "\n")


def answered(pages: DataFrame, client: Client, batch: int = 10, workers: int = 8) -> DataFrame:
    """(page, answer) of (page, question). A task that the service fails gives up for the rest of its pages: their answers
    are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        for frame in frames:
            given, got = frame["question"].tolist(), []
            for i in range(0, len(given), batch):
                part = given[i : i + batch]
                got += breaker.call(lambda part=part: client(part), lambda part=part: [None] * len(part))
            yield pd.DataFrame({"page": frame["page"], "answer": pd.Series(got, dtype=object)})

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("page", "question").repartition(workers).mapInPandas(run, f"page {kind}, answer string")


def classify_pages(pages: DataFrame, client: Client) -> DataFrame:
    """(page, labels, success, header_map): the labels of the columns of pages (page, header, children), asked of a chat
    model by their headers and first rows.

    An answer counts if it is a JSON list of as many labels as there are columns. Labels that aren't known, and repeats of
    required ones, become OTHER; if a required one is missing then, or there is no answer that counts, the default labels
    stand. ``success`` is whether nothing of this was needed. ``header_map`` leads from each label to its last column, from
    0. Pages must be distinct; null headers and children count as empty.
    """
    header = F.coalesce("header", F.array().cast(pages.schema["header"].dataType))
    children = F.coalesce("children", F.array().cast(pages.schema["children"].dataType))
    asked = pages.select("page", F.size(header).alias("n"), question(header, samples(children)).alias("question"))
    told = answered(asked, client)
    labels = F.from_json("answer", "array<string>")
    both = asked.select("page", "n").join(told, "page", "left").withColumn("given", F.when(F.size(labels) == F.col("n"), labels))
    repeat = lambda x, i: F.array_position("given", x) != i + 1
    known = lambda x: F.coalesce(x.isin(*REQUIRED), F.lit(False))
    plain = F.transform("given", lambda x, i: F.when(known(x) & ~repeat(x, i), x).otherwise(OTHER))
    usable = F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "plain")) == 0
    found = both.withColumn("plain", plain).withColumn("usable", F.coalesce(usable, F.lit(False)))
    final = F.when(F.col("usable"), F.col("plain")).otherwise(default_labels(F.col("n")))
    # Nothing became OTHER that wasn't.
    same = F.coalesce(F.col("usable") & (F.col("plain") == F.col("given")), F.lit(False))
    shown = found.select("page", final.alias("labels"), same.alias("success"))
    last = lambda x, i: F.size("labels") - F.array_position(F.reverse("labels"), x) == i
    entries = F.transform("labels", lambda x, i: F.struct(x.alias("label"), i.alias("at"), last(x, i).alias("last")))
    entries = F.transform(F.filter(entries, lambda e: e["last"]), lambda e: F.struct(e["label"], e["at"]))
    return shown.withColumn("header_map", F.map_from_entries(entries))


def prepared(pages: DataFrame, client: Client, files: DataFrame) -> DataFrame:
    """Pages as an export needs them: with their labels and header map, and in each row whose first cell leads to a page
    and whose second leads nowhere, the first file of that page (``files``: title, pos, url) as the second cell's link.
    Pages are (page, header, children); titles are what follows ``/wiki/`` in the first cell's link."""
    first = files.groupBy("title").agg(F.min_by("url", "pos").alias("file"))
    rows = pages.select("page", F.posexplode("children").alias("at", "row"))
    title = F.regexp_replace(F.get("row", 0)["link"], "^/wiki/", "")
    wanting = is_linked(F.get("row", 0)["link"]) & ~is_linked(F.get("row", 1)["link"]) & F.col("file").isNotNull()
    filled = F.transform("row", lambda c, i: F.when(wanting & (i == 1), c.withField("link", F.col("file"))).otherwise(c))
    rows = rows.join(first, title == F.col("title"), "left").select("page", "at", filled.alias("row"))
    rows = rows.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "row"))), lambda r: r["row"]).alias("children"))
    return pages.drop("children").join(rows, "page", "left").join(classify_pages(pages, client), "page")


class Breaker:
    """Skips calls for some hours after a failure; the clock is injected."""

    def __init__(self, hours: float = 4, clock: Callable[[], float] = time.time):
        self.hours, self.clock, self.until = hours, clock, 0.0

    def call(self, function: Callable, fallback: Callable):
        if self.clock() < self.until:
            return fallback()
        try:
            return function()
        except ConnectionError:
            self.until = self.clock() + self.hours * 3600
            return fallback()


def prompt(headers: list[str], rows: list[list[str]], hints: str = "", sample: int = 3) -> str:
    """The question that asks a chat model for the labels of a table's columns."""
    lines = [f"Label each of the {len(headers)} columns with one of: {', '.join((*REQUIRED, OTHER))}."]
    lines += [f"Header: {' | '.join(headers)}"] + [f"Row: {' | '.join(r)}" for r in rows[:sample]]
    return "\n".join(lines + ([hints] if hints else []) + ["Answer with a JSON list of strings."])
