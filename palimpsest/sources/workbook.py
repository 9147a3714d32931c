"""Grids of cells as workbooks, a file for each page, written and read by Spark."""

from __future__ import annotations

import functools
import io
import itertools
import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "page string, row int, col int, text string, link string, style string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: In a job's folder aside, the list of the tasks' folders that are whole.
WHOLE = "_whole.json"
#: Looks of styles: colour of the font, colour of the fill, underlined.
STYLES = {
    "": ("FF000000", None, False),
    "added": ("FF000000", "FFC6EFCE", False),
    "changed": ("FF000000", "FFFFEB9C", False),
    "linked": ("FF0563C1", None, True),
    "unlinked": ("FFC00000", None, False),
}
#: Files that a task reads, so that starting it costs little beside them; rows of an Arrow batch.
FILES, BATCH = 2048, 10_000

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


_SHEET, _TARGETS = "xl/worksheets/sheet1.xml", "xl/worksheets/_rels/sheet1.xml.rels"
_ORDER = list(STYLES)
_LOOKS = {style: f' s="{i}"' for i, style in enumerate(_ORDER)}


@functools.cache
def letters(col: int) -> str:
    out = ""
    while col > 0:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


@functools.cache
def number(name: str) -> int:
    out = 0
    for c in name:
        out = 26 * out + ord(c) - 64
    return out


def _styles() -> str:
    fonts = "".join(f"<font>{'<u/>' if u else ''}<color rgb={quoteattr(c)}/></font>" for c, _, u in STYLES.values())
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    formats, n = "", 2
    for i, (_, fill, _) in enumerate(STYLES.values()):
        if fill:
            fills += f'<fill><patternFill patternType="solid"><fgColor rgb="{fill}"/></patternFill></fill>'
            n += 1
        formats += f'<xf numFmtId="0" fontId="{i}" fillId="{n - 1 if fill else 0}" borderId="0" xfId="0" applyFont="1" applyFill="1"/>'
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="{len(STYLES)}">{fonts}</fonts><fills count="{n}">{fills}</fills><borders count="1"><border/></borders>'
        f'<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(STYLES)}">{formats}</cellXfs></styleSheet>'
    )


@functools.cache
def _frame() -> bytes:
    """The parts that are the same in all files, as a file of their own."""
    app = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{app}.{k}+xml"/>' for p, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="page" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in parts.items():
            file.writestr(name, _HEAD + text)
        file.writestr("xl/styles.xml", _styles())
    return buffer.getvalue()


def workbook(cells: Iterable[tuple]) -> bytes:
    """A file of one sheet of (row, col, text, link, style), in order; a text that starts with = is a formula, styles that
    have no look have none."""
    body, targets, links = [], [], []
    for row, own in itertools.groupby(cells, key=lambda c: c[0]):
        body.append(f'<row r="{row}">')
        for _, col, text, link, style in own:
            at, text = f"{letters(col)}{row}", _BAD.sub("", text or "")
            look = _LOOKS.get(style, "")
            if text[:1] == "=" and len(text) > 1:
                body.append(f'<c r="{at}"{look}><f>{escape(text[1:])}</f></c>')
            else:
                body.append(f'<c r="{at}"{look} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
            if link:
                targets.append(f'<Relationship Id="rId{len(targets) + 1}" Type="{_REL}/hyperlink" Target={quoteattr(_BAD.sub("", link))} TargetMode="External"/>')
                links.append(f'<hyperlink ref="{at}" r:id="rId{len(targets)}"/>')
        body.append("</row>")
    linked = f"<hyperlinks>{''.join(links)}</hyperlinks>" if links else ""
    buffer = io.BytesIO()
    buffer.write(_frame())
    with zipfile.ZipFile(buffer, "a", zipfile.ZIP_DEFLATED, compresslevel=1) as file:
        for name, text in (
            (_SHEET, f'<worksheet xmlns="{_MAIN}" xmlns:r="{_REL}"><sheetData>{"".join(body)}</sheetData>{linked}</worksheet>'),
            (_TARGETS, f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(targets)}</Relationships>'),
        ):
            file.writestr(name, _HEAD + text)
    return buffer.getvalue()


def cells_of(data: bytes) -> Iterator[tuple]:
    """(row, col, text, link, style) of a file that ``workbook`` made."""
    file = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(file.read(_SHEET))
    links = {}
    if (linked := root.find(f"{{{_MAIN}}}hyperlinks")) is not None:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(file.read(_TARGETS))}
        links = {h.get("ref"): targets[h.get(f"{{{_REL}}}id")] for h in linked}
    for row in root.find(f"{{{_MAIN}}}sheetData"):
        for c in row:
            at, look, shown = c.get("r"), c.get("s"), c[0]
            # A formula, or an inline string, whose text is its only child.
            text = f"={shown.text}" if shown.tag == f"{{{_MAIN}}}f" else shown[0].text or ""
            yield int(row.get("r")), number(at.rstrip("0123456789")), text, links.get(at), _ORDER[int(look)] if look else None


def _system(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if re.match("[a-z0-9]+:", path) else f"file://{path}")


def _names(system, folder: str) -> list[str]:
    import pyarrow.fs

    found = system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return [f.base_name for f in found if f.base_name.endswith(".xlsx")]


def _move(system, folder: str, path: str) -> None:
    """Moves the files that are left in a task's folder to their place."""
    for name in _names(system, folder):
        system.move(f"{folder}/{name}", f"{path}/{name}")


def _clean(system, path: str, job: str) -> None:
    import pyarrow.fs

    aside = f"{path}/_aside-{job}"
    if system.get_file_info(aside).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(aside)


def _finish(system, path: str, job: str, files: int) -> None:
    _clean(system, path, job)
    with system.open_output_stream(f"{path}/_SUCCESS") as file:
        file.write(json.dumps({"files": files}).encode())


class Written(WriterCommitMessage):
    """A task's folder and how many files it holds."""

    def __init__(self, folder: str, files: int):
        self.folder, self.files = folder, files


class Workbooks(DataSource):
    """``df.write.format("workbooks").option("path", folder)`` and ``spark.read.format("workbooks")``, in any folder that
    Arrow's file systems know. Writing takes rows of SCHEMA, all of a page together and in order (``write_workbooks`` sees
    to that). Tasks write aside, each in a folder of its own, so one that runs twice does no harm; files go to their place
    when all tasks are done, and then ``_SUCCESS`` tells that they are whole. If a task fails for good nothing is left. The
    driver moves the files, unless an option ``job`` names the folder aside: then they stay there, with a list of the
    folders that are whole, for ``write_workbooks`` to move in tasks."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WorkbookWriter(self.options["path"], self.options.get("job"))

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"])


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str | None):
        self.path, self.job, self.moves = path, job or uuid.uuid4().hex, not job

    def write(self, iterator: Iterator) -> Written:
        system, path = _system(self.path)
        folder, files = f"{path}/_aside-{self.job}/{uuid.uuid4().hex}", 0
        system.create_dir(folder, recursive=True)
        rows = itertools.chain.from_iterable(zip(*[b.column(c).to_pylist() for c in COLUMNS], strict=True) for b in iterator)
        for page, own in itertools.groupby(rows, key=lambda r: r[0]):
            with system.open_output_stream(f"{folder}/{quote(page or '', safe='')}.xlsx") as file:
                file.write(workbook(r[1:] for r in own))
            files += 1
        return Written(folder, files)

    def commit(self, messages: list) -> None:
        system, path = _system(self.path)
        done = [m for m in messages if m]
        if self.moves:
            system.create_dir(path, recursive=True)
            for m in done:
                _move(system, m.folder, path)
            _finish(system, path, self.job, sum(m.files for m in done))
        else:
            system.create_dir(f"{path}/_aside-{self.job}", recursive=True)
            with system.open_output_stream(f"{path}/_aside-{self.job}/{WHOLE}") as file:
                file.write(json.dumps([[m.folder, m.files] for m in done]).encode())

    def abort(self, messages: list) -> None:
        _clean(*_system(self.path), self.job)


class Some(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Some]:
        names = sorted(_names(*_system(self.path)))
        return [Some(names[i : i + FILES]) for i in range(0, len(names), FILES)] or [Some([])]

    def read(self, partition: Some) -> Iterator:
        import pyarrow as pa

        system, path = _system(self.path)
        types = [pa.int32() if t == "int" else pa.string() for _, t in (x.split() for x in SCHEMA.split(", "))]

        def cells() -> Iterator[tuple]:
            for name in partition.names:
                with system.open_input_stream(f"{path}/{name}") as file:
                    data = file.readall()
                page = unquote(name[:-5])
                for cell in cells_of(data):
                    yield (page, *cell)

        found = cells()
        while rows := list(itertools.islice(found, BATCH)):
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, COLUMNS)


def write_workbooks(grid: DataFrame, path: str) -> None:
    """Writes a file for each page of (page, row, col, text, link, style). A page is a sheet, so it fits in a task. Files are
    moved to their place by tasks, one for each that has written some; the driver knows folders, not files."""
    spark, job = grid.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(Workbooks)
    rows = grid.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))])
    rows = rows.repartition("page").sortWithinPartitions("page", "row", "col")
    rows.write.format("workbooks").mode("append").option("path", path).option("job", job).save()
    system, place = _system(path)

    def move(batches: Iterator) -> Iterator:
        own, to = _system(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                _move(own, folder, to)
            yield batch

    try:
        with system.open_input_stream(f"{place}/_aside-{job}/{WHOLE}") as file:
            done = json.loads(file.readall())
        if folders := [(folder,) for folder, files in done if files]:
            listed = spark.createDataFrame(folders, "folder string").repartition(len(folders))
            listed.mapInArrow(move, "folder string").write.format("noop").mode("overwrite").save()
        _finish(system, place, job, sum(files for _, files in done))
    finally:
        _clean(system, place, job)


def read_workbooks(spark, path: str) -> DataFrame:
    """The cells of the files in a folder, as they were written; a null text is empty."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbooks").option("path", path).load()
