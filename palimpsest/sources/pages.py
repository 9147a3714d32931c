"""Pages of raw HTML or wikitext as nested rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

CELL = "struct<text:string,link:string>"
PAGE = f"title string, description string, header array<string>, children array<array<{CELL}>>, doc_link string, thumb_link string, lastmod string, title_html string"
WIKI = (
    f"title string, template string, description string, dates string, notes string, header array<string>, "
    f"children array<array<{CELL}>>, files array<string>"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Collects the title, as text and as it stands in the page, the description, the first ``table.wikitable``, the first
    figure and the footer's date."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lines = html, [0, *(m.end() for m in re.finditer("\n", html))]
        self.title_at: int | None = None
        self.out = {"title": "", "description": "", "header": [], "children": [], "doc": None, "thumb": None, "lastmod": "", "title_html": ""}
        self.path: list[tuple[str, str]] = []  # (tag, what it holds)
        self.tables = 0
        self.row: list | None = None
        self.head: list | None = None

    def _inside(self, what: str) -> bool:
        return any(w == what for _, w in self.path)

    def _at(self) -> int:
        """Where the tag that is read begins."""
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        what = ""
        if tag == "table":
            if "wikitable" in classes and not self.tables:
                what, self.tables = "table", 1
        elif tag == "span" and "mw-page-title-main" in classes or tag == "h1" and not self.out["title"]:
            what = "title"
            if not self._inside("title") and not self.out["title_html"]:
                self.title_at = self._at() + len(self.get_starttag_text())
        elif a.get("id") == "description":
            what = "description"
        elif a.get("id") == "footer-info-lastmod":
            what = "lastmod"
        elif tag == "figure" and not self.out["doc"]:
            what = "figure"
        elif self._inside("table") and tag == "tr":
            self.row, self.head = [], []
        elif self._inside("table") and tag in ("td", "th") and self.row is not None:
            what = tag
            (self.row if tag == "td" else self.head).append({"text": "", "link": None})
        if tag == "a" and a.get("href"):
            if self._inside("td") and self.row and self.row[-1]["link"] is None:
                self.row[-1]["link"] = a["href"]
            if self._inside("figure") and not self.out["doc"]:
                self.out["doc"] = a["href"]
        if tag == "img" and self._inside("figure") and not self.out["thumb"]:
            self.out["thumb"] = a.get("src")
        if tag not in _VOID:
            self.path.append((tag, what))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.path):
            return
        while True:
            closed, what = self.path.pop()
            if what == "title" and self.title_at is not None and not self._inside("title"):
                self.out["title_html"], self.title_at = self.html[self.title_at : self._at()], None
            if closed == "tr":
                self._end_row()
            if closed == tag:
                return

    def _end_row(self):
        if self.row is None:
            return
        if self.row:
            self.out["children"].append([{"text": c["text"].strip(), "link": c["link"]} for c in self.row])
        elif self.head and not self.out["header"]:
            self.out["header"] = [c["text"].strip() for c in self.head]
        self.row = self.head = None

    def handle_data(self, data):
        for what in ("title", "description", "lastmod"):
            if self._inside(what):
                self.out[what] += data
        if self._inside("td") and self.row:
            self.row[-1]["text"] += data
        elif self._inside("th") and self.head:
            self.head[-1]["text"] += data


def read_html(html: str | None) -> dict:
    """One page; a page without a table has no header and no children. ``title_html`` is what stands between the tags of the
    title, entities and white space as they are."""
    reader = _Reader(html or "")
    reader.feed(html or "")
    reader.close()
    while reader.path:
        reader.handle_endtag(reader.path[-1][0])
    o = reader.out
    return {
        "title": o["title"].strip(),
        "description": o["description"].strip(),
        "header": o["header"],
        "children": o["children"],
        "doc_link": o["doc"],
        "thumb_link": o["thumb"],
        "lastmod": o["lastmod"].strip(),
        "title_html": o["title_html"],
    }


def _apply(raw: DataFrame, column: str, reader, schema: str) -> DataFrame:
    keep = [f for f in raw.schema.fields if f.name != column]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = pd.DataFrame([reader(x) for x in frame[column]], index=frame.index)
            yield pd.concat([frame.drop(columns=[column]), parsed], axis=1)

    return raw.mapInPandas(run, f"{head}, {schema}" if head else schema)


def html_pages(raw: DataFrame, column: str = "html") -> DataFrame:
    """Every page of ``raw`` read; its other columns stay."""
    return _apply(raw, column, read_html, PAGE)


_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]|\[(https?://[^\s\]]+)(?:\s+([^\]]*))?\]")
_FILE = re.compile(r"(?:File|Файл):[^|}\n]+", re.I)


def _plain(text: str) -> str:
    text = _LINK.sub(lambda m: m.group(2) or m.group(1) or m.group(4) or m.group(3) or "", text)
    return re.sub(r"'{2,}|<[^>]+>", "", text).strip("/ ")


def _link(text: str) -> str | None:
    """The first wiki link, else the first outside link."""
    wiki = out = None
    for m in _LINK.finditer(text):
        wiki = wiki or m.group(1)
        out = out or m.group(3)
    return wiki or out


def _template(text: str, prefix: str) -> tuple[str | None, dict[str, str], str]:
    """(name, parameters, text without it) of the first template whose name starts with ``prefix``."""
    at = text.find("{{" + prefix)
    if at < 0:
        return None, {}, text
    depth, i = 0, at
    while i < len(text):
        if text.startswith("{{", i):
            depth, i = depth + 1, i + 2
        elif text.startswith("}}", i):
            depth, i = depth - 1, i + 2
            if not depth:
                break
        else:
            i += 1
    body = text[at + 2 : i - 2] if not depth else text[at + 2 :]
    parts, level, start = [], 0, 0
    for j in range(len(body)):
        two = body[j : j + 2]
        level += (two in ("{{", "[[")) - (two in ("}}", "]]"))
        if body[j] == "|" and level <= 0:
            parts.append(body[start:j])
            start = j + 1
    parts.append(body[start:])
    named = dict(p.split("=", 1) for p in parts[1:] if "=" in p)
    return parts[0].strip(), {k.strip(): v.strip() for k, v in named.items()}, text[:at] + text[i:]


def read_wikitext(text: str | None, prefix: str = "Архіви", title: str = "назва", dates: str = "рік", notes: str = "примітки") -> dict:
    """One page of wikitext: its describing template and its first table. A page without a table gets a row for each of its
    links to sub-pages, or else for each of several file links."""
    text = text or ""
    template, values, rest = _template(text, prefix)
    header, children = [], []
    table = re.search(r"(?s)\{\|[^\n]*wikitable.*?\n(.*?)\n\|\}", rest)
    if table:
        for block in re.split(r"\n\|-[^\n]*", "\n" + table.group(1)):
            cells = []
            for line in block.strip().split("\n"):
                if line.startswith("!") and not header:
                    header = [_plain(h) for h in re.split(r"!!|\|\|", line[1:])]
                elif line.startswith("!"):
                    continue
                elif line.startswith("|") and not line.startswith(("|}", "|+")):
                    cells += line[1:].split("||")
                elif cells and line:
                    cells[-1] += "\n" + line
            if cells:
                children.append([{"text": _plain(c), "link": _link(c)} for c in cells])
    links = [m.group(1) for m in _LINK.finditer(rest) if m.group(1)]
    files = list(dict.fromkeys(f.strip() for f in _FILE.findall(text)))
    if not table:
        subs = [x for x in links if x.startswith("/")]
        rows = subs or [x for x in links if x.lower().startswith("c:")]
        if subs or len(rows) > 1:
            children = [[{"text": x.strip("/ "), "link": x}] for x in rows]
            header = ["link"]
    return {
        "title": None,
        "template": template,
        "description": values.get(title),
        "dates": values.get(dates),
        "notes": values.get(notes),
        "header": header,
        "children": children,
        "files": files,
    }


def wikitext_pages(raw: DataFrame, column: str = "wikitext") -> DataFrame:
    return _apply(raw, column, read_wikitext, WIKI)
