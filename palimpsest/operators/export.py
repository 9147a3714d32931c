"""Spreadsheet exports: a template's cells and a page's rows make a grid, which a small writer turns into a file."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import link_status
from ..functions.text import unescaped
from ..functions.timefmt import display_day

# A token of a template, ``{name[index]:modifier}``.
TOKEN = r"\{([A-Za-z0-9_.]+)(?:\[([A-Za-z_][A-Za-z0-9_]*|[0-9]+)\])?(?::([A-Za-z_]+))?\}"


def tokens(text: Column) -> Column:
    """(name, index, modifier) of the ``{name[index]:modifier}`` tokens of a template cell; absent parts are empty."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1),
        lambda t: F.struct(
            F.regexp_extract(t, TOKEN, 1).alias("name"),
            F.regexp_extract(t, TOKEN, 2).alias("index"),
            F.regexp_extract(t, TOKEN, 3).alias("modifier"),
        ),
    )


def column_index(labels: Column, index: Column) -> Column:
    """A token's index as a column number: a number as it stands, else the label's."""
    return F.coalesce(index.try_cast("int"), F.try_element_at(labels, index))


def first_child_row(template: DataFrame) -> DataFrame:
    """The first row of a template (row, col, text) that has a child or empty token."""
    names = F.transform(tokens(F.col("text")), lambda t: t["name"])
    return template.where(F.arrays_overlap(names, F.array(F.lit("child"), F.lit("empty")))).agg(F.min("row").alias("first"))


def prototypes(template: DataFrame) -> DataFrame:
    """(style, row, col): the cells of a template whose look stands for a style, by their ``{edit:style}`` token."""
    found = template.select("row", "col", F.explode(tokens(F.col("text"))).alias("t")).where("t.name = 'edit'")
    return found.groupBy(F.col("t.modifier").alias("style")).agg(F.max(F.struct("row", "col")).alias("at")).select("style", "at.*")


def page_fields(text: str, field) -> Column:
    """A text whose tokens are what ``field`` has, a column, for their names; others stay, as do those it has null for."""
    parts, at = [], 0
    for m in re.finditer(TOKEN, text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(field(m[1]), F.lit(m[0]))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def grid(template: DataFrame, children: DataFrame, first: int, pages: DataFrame | None = None, base: str = "") -> DataFrame:
    """(page, row, col, text, link, style): a template for each page, its row ``first`` once for each child.

    ``template``: row, col, text, a fixed form of bounded size; ``children``: page, ord, cells (array of structs of text,
    link and, if told, edit); ``pages``: page, kind, id, parent, fields (a map by names, dotted ones too), and, if told,
    header (a map from column labels to positions).

    In the row ``first`` the tokens of a cell are taken one after another. ``{child[i]}``, by position or label, is the
    child's cell, with its ``edit`` as style; ``:linked`` gives the first cell's link and the style ``linked`` or
    ``unlinked``, ``:doc_link`` the same of the second cell; ``:link_status`` of the first cell is told instead of a
    text; ``:sheetname`` puts the child's sheet in the token's place in the form's text; ``{empty}`` is empty. So the last token that gives a
    text has the cell. Cells that no token of a child is in are there once. Elsewhere, and in the first child's row, other
    tokens are the page's fields, or stay; ``:linked`` gives the page's ``url``, ``:date`` the cell as a day. ``{edit:x}``
    cells have their style and stay. Entities are decoded; cells and labels that a child lacks are empty. Rows below move
    down by as many rows as there are children. ``__COL__`` in a formula is the column over all children; a formula in the
    row ``first`` is copied down.
    """
    form = [r.asDict() for r in template.orderBy("row", "col").collect()]
    found = [m for c in form for m in re.finditer(TOKEN, c["text"] or "")]
    names = {m[1]: f"__field{i}" for i, m in enumerate(found)}
    labels = {m[2]: f"__place{i}" for i, m in enumerate(found) if m[2] and not m[2].isdigit()}
    nothing = F.lit(None).cast("string")
    # Entities are decoded once: a child's before its page is told to it, a page's fields before they meet its children.
    sheets = any(m[3] == "sheetname" for m in found)
    plain = F.transform("cells", lambda c: c.withField("text", unescaped(c["text"])))
    numbered = children.select("page", "ord", plain.alias("cells")).withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("ord")) - 1)
    numbered = numbered.withColumn("n", F.count("*").over(Window.partitionBy("page")).cast("int"))
    told = pages.columns if pages is not None else []
    page = {k: F.col(k) if k in told else nothing for k in (["kind", "id", "parent"] if sheets else [])}
    field = lambda name: F.try_element_at("fields", F.lit(name)) if "fields" in told else nothing
    page |= {column: unescaped(field(name)) for name, column in names.items()}
    page["__url"] = field("url")
    page |= {c: F.try_element_at("header", F.lit(k)) if "header" in told else F.lit(None).cast("int") for k, c in labels.items()}
    if pages is not None:
        numbered = numbered.join(pages.select("page", *[v.alias(k) for k, v in page.items()]), "page", "left")
    else:
        numbered = numbered.withColumns(page)
    empty = lambda c: F.coalesce(c, F.lit(""))
    edits = "edit" in children.schema["cells"].dataType.elementType.fieldNames()
    nth, shown = F.col("nth"), lambda name: F.col(names[name])

    def struct(row: Column, col: int, value: Column, link: Column = nothing, style: Column = nothing) -> Column:
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.alias("text"), link.alias("link"), style.alias("style"))

    def page_cell(row: Column, col: int, text: str) -> Column:
        """A cell that tells of the page."""
        found = [m.groups() for m in re.finditer(TOKEN, text)]
        looks = [modifier for name, _, modifier in found if name == "edit"]
        if looks:
            return struct(row, col, F.lit(text), style=F.lit(looks[-1]).cast("string"))
        if not found and text[:1] == "=":
            return struct(row, col, fill_formula(F.lit(text), F.lit(_letters(col)), F.lit(first), F.col("n")))
        modifiers = {modifier for *_, modifier in found}
        value = page_fields(text, shown)
        if "date" in modifiers:
            value = F.coalesce(display_day(value), value)
        linked = "linked" in modifiers
        return struct(row, col, value, F.col("__url") if linked else nothing, F.lit("linked") if linked else nothing)

    def child_cell(col: int, text: str) -> Column:
        """A cell of the row ``first`` for one child; null where there is none."""
        row, found = F.lit(first) + nth, list(re.finditer(TOKEN, text))
        if not found and text[:1] == "=":
            span = fill_formula(F.lit("__COL__"), F.lit(_letters(col)), F.lit(first), F.col("n"))
            return struct(row, col, F.replace(moved_formula(text, nth), F.lit("__COL__"), span))
        if not any(m[1] in ("child", "empty") for m in found):
            return F.when(nth == 0, page_cell(row, col, text))
        url = lambda i: child_url(F.get("cells", F.lit(i))["link"], base)
        value, link, style, form_text = F.when(nth == 0, F.lit(text)), nothing, nothing, F.lit(text)
        for m in found:
            name, index, modifier = m.groups()
            if name == "empty":
                value = F.lit("")
            elif name == "child":
                if index is not None:
                    place = F.lit(int(index)) if index.isdigit() else F.col(labels[index])
                    at = F.get("cells", place)
                    value = empty(at["text"])
                    style = F.coalesce(at["edit"], style) if edits else style
                if modifier in ("linked", "doc_link"):
                    target = url(0 if modifier == "linked" else 1)
                    style = link_status(target)
                    link = F.when(style == "linked", target)
                elif modifier == "link_status":
                    value = link_status(url(0))
                elif modifier == "sheetname":
                    child = empty(F.get("cells", F.lit(0))["text"])
                    value = F.replace(form_text, F.lit(m[0]), sheet_name(F.col("kind"), child, F.col("id"), F.col("parent")))
            else:
                sub = F.coalesce(shown(name), F.lit(m[0]))
                value = F.when(nth == 0, F.replace(value, F.lit(m[0]), sub)).otherwise(value)
                form_text = F.replace(form_text, F.lit(m[0]), sub)
        return struct(row, col, value, link, style)

    kind = "array<struct<row:int,col:int,text:string,link:string,style:string>>"
    body = F.array(*[child_cell(c["col"], c["text"] or "") for c in form if c["row"] == first]).cast(kind)
    below = lambda r: F.lit(r) + (F.col("n") if r > first else 0)
    frame = F.array(*[page_cell(below(c["row"]), c["col"], c["text"] or "") for c in form if c["row"] != first]).cast(kind)
    # The first child carries the cells around the table, so a page is dealt out once.
    both = F.filter(F.when(nth == 0, F.concat(frame, body)).otherwise(body), lambda c: c.isNotNull() & c["text"].isNotNull())
    return numbered.select("page", F.explode(both).alias("c")).select("page", "c.*")


def fill_formula(formula: Column, letter: Column, first: Column, n: Column) -> Column:
    """A formula whose ``__COL__`` stands for the cells of its own column over the n rows from ``first``."""
    span = F.concat(letter, first.cast("string"), F.lit(":"), letter, (first + n - 1).cast("string"))
    return F.replace(formula, F.lit("__COL__"), span)


_REFERENCE = re.compile(r"(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(])")


def moved_formula(formula: str, down: Column) -> Column:
    """A formula as it reads when copied ``down`` rows: relative rows of its references move along, ``$`` rows don't, and
    neither does what stands in quotes."""
    parts, at = [], 0
    for i, piece in enumerate(re.split(r'("[^"]*")', formula)):
        if i % 2 == 0:
            for m in _REFERENCE.finditer(piece):
                if not m[3]:
                    parts += [F.lit(piece[at : m.start(4)]), (F.lit(int(m[4])) + down).cast("string")]
                    at = m.end(4)
            piece, at = piece[at:], 0
        parts.append(F.lit(piece))
    return F.concat(*parts)


def child_url(link: Column, base: str = "") -> Column:
    """Address of a link of a row; null without one."""
    return F.concat(F.lit(base), link)


def sheet_name(kind: Column, child: Column, page: Column, parent: Column) -> Column:
    """Sheet of a child of a page, by the page's kind."""
    of_fond = F.concat(parent, F.lit(" "), page, F.lit("-"), child)
    return F.when(kind == "archive", F.concat(F.lit("Fund "), child)).when(kind == "fond", of_fond).otherwise(F.concat(F.lit("sheetname-"), child))


def report_line(kind: Column, name: Column, modified: Column) -> Column:
    return F.concat_ws(",", kind, F.replace(name, F.lit(","), F.lit("")), modified)


def _letters(col: int) -> str:
    out = ""
    while col > 0:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(sheets: dict[str, list[tuple[int, int, str]]]) -> bytes:
    """An xlsx file of sheets of (row, col, text), rows and columns from 1; a text that starts with = is a formula."""
    buffer = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
    links = "http://schemas.openxmlformats.org/package/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    bad = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as file:
        app = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{app}.worksheet+xml"/>' for i in range(1, len(sheets) + 1)
        )
        file.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{app}.sheet.main+xml"/>{parts}</Types>',
        )
        file.writestr("_rels/.rels", f'{head}<Relationships xmlns="{links}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        file.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        file.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{links}">{targets}</Relationships>')
        for i, cells in enumerate(sheets.values(), 1):
            rows: dict[int, list[tuple[int, str]]] = {}
            for row, col, text in cells:
                rows.setdefault(row, []).append((col, bad.sub("", text or "")))
            body = ""
            for row, items in sorted(rows.items()):
                body += f'<row r="{row}">'
                for col, text in sorted(items):
                    at = f"{_letters(col)}{row}"
                    body += (
                        f'<c r="{at}"><f>{escape(text[1:])}</f></c>'
                        if text.startswith("=")
                        else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
                    )
                body += "</row>"
            file.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()
