"""A feed of changes, newest first and read by pages, as a Spark stream."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.timefmt import MONTHS, from_message

#: Hits of the first page; each page holds twice as many as the one before, up to LONGEST, which a task reads in pieces.
BATCH = 50
LONGEST = 100_000
PIECE = 10_000
SCHEMA = "title string, link string, data string"

Place = tuple[str, str]


def hit_time(data: Column) -> Column:
    """The time that a hit's line tells: what follows its first ``-`` (all of it without one), in standard form."""
    return from_message(F.btrim(data.substr(F.instr(data, "-") + 1, F.length(data))))


def place_of(hit: dict) -> Place:
    """(time in standard form, title) of a hit; feeds are in descending order of it."""
    data = hit["data"]
    words = data[data.find("-") + 1 :].replace(",", "").split()
    return ",".join(MONTHS.get(w, w.zfill(2) if len(w) == 1 else w) for w in reversed(words)), hit["title"]


class Folder:
    """A feed that is a folder of folders ``page=0``, ``page=1`` and so on, of ``size`` hits each but for the last: a file of
    JSON lines in each. The folder is any that Arrow's file systems know."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def page(self, limit: int, offset: int) -> list[dict]:
        import pyarrow.fs

        system, path = pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        hits: list[dict] = []
        number, skip = divmod(offset, self.size)
        while len(hits) < limit + skip:
            found = system.get_file_info(pyarrow.fs.FileSelector(f"{path}/page={number}", allow_not_found=True))
            names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
            if not names:
                break
            for name in names:
                with system.open_input_stream(name) as file:
                    hits += [json.loads(line) for line in file.readall().decode().splitlines() if line]
            number += 1
        return hits[skip:][:limit]


class Site:
    """A feed at a web address with ``{limit}`` and ``{offset}``, whose answer is a JSON list of hits."""

    def __init__(self, url: str):
        self.url = url

    def page(self, limit: int, offset: int) -> list[dict]:
        with urllib.request.urlopen(self.url.format(limit=limit, offset=offset), timeout=10) as answer:
            return json.loads(answer.read().decode())


def feed_of(options: dict) -> Folder | Site:
    return Site(options["url"]) if "url" in options else Folder(options["path"], int(options.get("hits", 1000)))


class Span(InputPartition):
    """Hits after ``low`` and up to ``high``, to be found from an offset on."""

    def __init__(self, low: Place, high: Place, offset: int, limit: int):
        self.low, self.high, self.offset, self.limit = low, high, offset, limit


class ChangeFeed(DataSource):
    """``spark.readStream.format("change_feed").option("path", folder).option("cutoff", "2024,03")``, or ``url``.

    Rows are (title, link, data), each hit once: those at or after the cut-off first, then batch by batch what is newer
    than the newest hit before. Hits of equal times are in the order of their titles, descending.
    """

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(dict(self.options))


class FeedReader(DataSourceStreamReader):
    """Offsets are places in the feed, by value: new hits move all others to greater offsets, never to another place. The
    driver asks for the last hit of each page, page by page and twice as long each up to LONGEST, until one is older than
    the last batch; the pages' bounds, by value too, are the partitions. A task reads on from its page's offset until it is past
    its lower bound, so that hits that have moved on meanwhile are found, and a batch that is run again has the same hits."""

    def __init__(self, options: dict):
        self.feed, self.cutoff = feed_of(options), options.get("cutoff", "")

    def initialOffset(self) -> dict:
        return {"lastmod": self.cutoff, "title": ""}

    def latestOffset(self) -> dict:
        newest = self.feed.page(1, 0)
        place = max(place_of(newest[0]), (self.cutoff, "")) if newest else (self.cutoff, "")
        return {"lastmod": place[0], "title": place[1]}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low, high = (start["lastmod"], start["title"]), (end["lastmod"], end["title"])
        spans, offset, limit, upper = [], 0, BATCH, high
        while upper > low:
            last = self.feed.page(1, offset + limit - 1)
            lower = max(low, place_of(last[0])) if last else low
            if lower < upper:
                # The hit at the upper bound is the last of the page before.
                spans.append(Span(lower, upper, max(0, offset - 1), limit))
                upper = lower
            elif not last:
                break
            offset, limit = offset + limit, min(2 * limit, LONGEST)
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        offset = partition.offset
        while True:
            hits = self.feed.page(min(partition.limit, PIECE), offset)
            for hit in hits:
                if partition.low < place_of(hit) <= partition.high:
                    yield hit["title"], hit["link"], hit["data"]
            if not hits or place_of(hits[-1]) <= partition.low:
                return
            offset += len(hits)

    def commit(self, end: dict) -> None:
        pass
