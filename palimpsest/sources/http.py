"""A Spark data source of web pages: a row for each address, fetched with retries."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES, TIMEOUT, LONGEST = 5, 10, 30.0


def delay(attempt: int, jitter: float = 0.0) -> float:
    """Seconds to wait after an attempt, from 0: doubling up to a longest, and jitter."""
    return min(LONGEST, 2.0**attempt) + jitter


def get(url: str, opener: Callable = urllib.request.urlopen, wait: Callable[[float], None] = time.sleep) -> str | None:
    """Body of a page; null if it doesn't exist. Other failures are tried again, the last one is raised."""
    for attempt in range(TRIES):
        try:
            with opener(url, timeout=TIMEOUT) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if attempt == TRIES - 1:
                raise
        except OSError:
            if attempt == TRIES - 1:
                raise
        wait(delay(attempt, random.random()))
    return None


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageSource(DataSource):
    """``spark.read.format("web_pages").option("urls", "a b c").option("readers", 5)``; readers bound the concurrency."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options.get("urls", "").split()
        self.readers = max(1, int(options.get("readers", 5)))

    def partitions(self) -> list[Urls]:
        return [Urls(self.urls[i :: self.readers]) for i in range(min(self.readers, len(self.urls)))] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield url, get(url)
