"""Workbooks as a Spark data source: ``spark.read.format("workbook")``, and a writer of plain ones.

    register(spark)
    spark.read.format("workbook").load(path)                              # cells
    spark.read.format("workbook").option("part", "objects").load(path)    # what lies over ranges

A file is opened where it is and only the members that a query needs are read, as
streams: a task has a file, or one sheet of a file beyond ``splitBytes``.  Filters on
``sheet`` leave sheets out before they are read, those on ``row`` end the reading of a
sheet.  Files must be where pyarrow reads them; ``read_workbooks`` reads any store.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quillon.sources import workbook as W

_M = W._MAIN
# The format's relations, and the extent of a sheet.
_TABLE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/table"
_ROWS, _COLS = 1_048_576, 16_384

OBJECTS = "file string, sheet string, sheet_idx int, kind string, name string, ref string, min_row int, min_col int, max_row int, max_col int, info map<string, string>, error string"
STYLES = "file string, sheet string, sheet_idx int, row int, col int, format string, bold boolean, italic boolean, color string, fill string, error string"
SHEETS = "file string, sheet string, sheet_idx int, visible boolean, error string"
PARTS = {"cells": W.SCHEMA, "objects": OBJECTS, "styles": STYLES, "sheets": SHEETS}


def box(ref: str) -> tuple[int, int, int, int] | None:
    """First row and column, last row and column of ``A1``, ``A1:B2``, ``A:B`` or ``1:2``, ``$`` allowed; None for others."""
    found = re.fullmatch(r"([A-Z]{0,3})(\d*)(?::([A-Z]{0,3})(\d*))?", ref.replace("$", "").upper())
    if not found or not (found[1] or found[2]):
        return None
    number = lambda letters: sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters)))
    c1, r1 = found[1], found[2]
    c2, r2 = (found[3], found[4]) if ":" in ref else (c1, r1)
    rows = (int(r1) if r1 else 1, int(r2) if r2 else _ROWS)
    cols = (number(c1) if c1 else 1, number(c2) if c2 else _COLS)
    return min(rows), min(cols), max(rows), max(cols)


def _relations(z: zipfile.ZipFile, member: str) -> dict[str, tuple[str, str]]:
    """Id to type and member of what a sheet refers to."""
    name = posixpath.join(posixpath.dirname(member), "_rels", posixpath.basename(member) + ".rels")
    if name not in z.namelist():
        return {}
    base = posixpath.dirname(member)
    return {r.get("Id"): (r.get("Type", ""), posixpath.normpath(posixpath.join(base, r.get("Target"))).lstrip("/")) for r in ElementTree.fromstring(z.read(name))}


def sheet_objects(z: zipfile.ZipFile, member: str) -> Iterator[tuple[str, str | None, str, dict]]:
    """``kind, name, ref, info`` of a sheet: merged ranges, hidden rows and columns, validations, conditional formats, tables."""
    with z.open(member) as f:
        for _, e in ElementTree.iterparse(f):
            tag = e.tag.removeprefix(_M)
            if tag == "mergeCell":
                yield "merged", None, e.get("ref"), {}
            elif tag == "row":
                if e.get("hidden") in ("1", "true"):
                    yield "hidden_rows", None, f"{e.get('r')}:{e.get('r')}", {}
                e.clear()
            elif tag == "col" and e.get("hidden") in ("1", "true"):
                letters = [_letters(int(e.get(x))) for x in ("min", "max")]
                yield "hidden_columns", None, ":".join(letters), {}
            elif tag in ("dataValidation", "conditionalFormatting"):
                rules = [e] if tag == "dataValidation" else e.findall(f"{_M}cfRule")
                for rule in rules:
                    info = {k: v for k, v in rule.attrib.items() if k != "sqref"} | _formulas(rule)
                    for ref in (e.get("sqref") or "").split():
                        yield "validation" if rule is e else "conditional_format", None, ref, info
    for kind, target in _relations(z, member).values():
        if kind == _TABLE and target in z.namelist():
            t = ElementTree.fromstring(z.read(target))
            columns = [x.get("name", "") for x in t.iter(f"{_M}tableColumn")]
            yield "table", t.get("displayName") or t.get("name"), t.get("ref"), {"name": t.get("name", ""), "columns": "\n".join(columns)}


def _formulas(rule) -> dict[str, str]:
    """The formulas of a rule: formula1 and formula2, or formula (the first of several)."""
    out: dict[str, str] = {}
    for x in rule:
        if x.tag.startswith(f"{_M}formula"):
            out.setdefault(x.tag.removeprefix(_M), x.text or "")
    return out


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def defined_names(z: zipfile.ZipFile) -> Iterator[tuple[str, str | None, str, dict]]:
    """``name, sheet, ref, info`` of the names of a workbook, a row for each range that one stands for."""
    root = ElementTree.fromstring(z.read("xl/workbook.xml"))
    names = [s.get("name") for s in root.iter(f"{_M}sheet")]
    for e in root.iter(f"{_M}definedName"):
        local = e.get("localSheetId")
        info = {"text": e.text or "", "scope": names[int(local)] if local is not None else ""}
        for part in re.findall(r"(?:'(?:[^']|'')*'|[^,'])+", e.text or ""):
            sheet, _, ref = part.rpartition("!")
            if box(ref) and sheet:
                yield e.get("name"), sheet[1:-1].replace("''", "'") if sheet.startswith("'") else sheet, ref, info


def _styles(z: zipfile.ZipFile) -> list[tuple]:
    """Number format, bold, italic, colour and fill of each cell style."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    formats = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_M}numFmt")}
    listed = lambda tag: list(root.find(f"{_M}{tag}") or [])
    on = lambda font, tag: (x := font.find(f"{_M}{tag}")) is not None and x.get("val", "1") not in ("0", "false")
    colour = lambda e: None if e is None else e.get("rgb") or (f"theme {e.get('theme')}" if e.get("theme") else None)
    fonts = [(on(x, "b"), on(x, "i"), colour(x.find(f"{_M}color"))) for x in listed("fonts")]
    fills = [colour(x.find(f"{_M}patternFill/{_M}fgColor")) for x in listed("fills")]
    out = []
    for x in listed("cellXfs"):
        i, font, fill = (int(x.get(k, 0)) for k in ("numFmtId", "fontId", "fillId"))
        own = fonts[font] if font < len(fonts) else (False, False, None)
        out.append((formats.get(i, f"built-in {i}" if i else "General"), *own, fills[fill] if fill < len(fills) else None))
    return out


class _Part(InputPartition):
    def __init__(self, path: str, sheet: int | None):
        self.path, self.sheet = path, sheet


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: str, split: int, glob: str):
        self.path, self.part, self.split, self.glob = path, part, split, glob
        self.sheets: set | None = None
        self.first, self.last = 1, sys.maxsize  # a file may hold more rows than a sheet may have: none is left out unasked

    def pushFilters(self, filters):
        """Filters on sheet and row narrow what is read; Spark applies all of them again."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("sheet",) and isinstance(f, (EqualTo, In)):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.sheets = own if self.sheets is None else self.sheets & own
            elif name == ("row",) and self.part in ("cells", "styles"):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, value - isinstance(f, LessThan))
            yield f

    def partitions(self):
        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(at)
        files = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and fnmatch.fnmatch(x.base_name, self.glob)]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            if x.size <= self.split:
                out.append(_Part(x.path, None))
                continue
            try:  # only large files are opened here, for their list of sheets
                with store.open_input_file(x.path) as f, zipfile.ZipFile(f) as z:
                    out += [_Part(x.path, i) for i, (name, _) in enumerate(W._parts(z)) if self.sheets is None or name in self.sheets]
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                out.append(_Part(x.path, None))
        return out or [_Part("", None)]

    def read(self, partition):
        if not partition.path:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        width = len(PARTS[self.part].split(", ")) - (1 if self.part == "objects" else 0)
        try:
            with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                W.check_archive(z)
                for row in self._rows(z, partition):
                    yield partition.path, *row, None
        except (ValueError, KeyError, IndexError, AttributeError, TypeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            yield partition.path, *[None] * (width - 2), f"{type(e).__name__}: {e}"

    def _rows(self, z: zipfile.ZipFile, partition: _Part) -> Iterator[tuple]:
        wanted = [(i, name, member) for i, (name, member) in enumerate(W._parts(z)) if (partition.sheet is None or i == partition.sheet) and (self.sheets is None or name in self.sheets)]
        if not wanted:
            return
        if self.part == "sheets":
            hidden = [s.get("state", "visible") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet")]
            for i, name, _ in wanted:
                yield name, i, hidden[i] == "visible"
        elif self.part == "objects":
            for i, name, member in wanted:
                for kind, own, ref, info in sheet_objects(z, member):
                    yield name, i, kind, own, ref, *(box(ref) or [None] * 4), info
            places = {name: i for i, name, _ in wanted}
            for own, sheet, ref, info in defined_names(z):
                if sheet in places:
                    yield sheet, places[sheet], "name", own, ref, *box(ref), info
        elif self.part == "styles":
            styles = _styles(z)
            for i, name, member in wanted:
                for row, col, style in _style_refs(z, member, self.first, self.last):
                    if style < len(styles):
                        yield name, i, row, col, *styles[style]
        else:
            strings, formats = W._strings(z), W._formats(z)
            for i, name, member in wanted:
                for cell in W.sheet_cells(z, member, strings, formats, self.last):
                    if cell[0] >= self.first:
                        yield name, i, *cell


def _style_refs(z: zipfile.ZipFile, member: str, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    with z.open(member) as f:
        for _, c in ElementTree.iterparse(f):
            if c.tag == f"{_M}c" and c.get("s"):
                row, col = W._place(c.get("r"))
                if row > last:
                    return
                if row >= first:
                    yield row, col, int(c.get("s"))
            if c.tag == f"{_M}row":
                c.clear()


class WorkbookSource(DataSource):
    """Options: ``path``, ``part`` (a key of PARTS, ``cells`` if unset), ``splitBytes`` (8 MB), ``pathGlobFilter`` (``*.xlsx``).

    A file that cannot be read, or is beyond the limits of an archive, is a row with ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _part(self) -> str:
        part = self.options.get("part", "cells")
        if part not in PARTS:
            raise ValueError(f"part is one of {sorted(PARTS)}, not {part}")
        return part

    def schema(self) -> str:
        return PARTS[self._part()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._part(), int(self.options.get("splitbytes", 8 << 20)), self.options.get("pathglobfilter", "*.xlsx"))


def register(spark: SparkSession) -> None:
    """Make ``format("workbook")`` known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)


def workbook_bytes(sheets: dict[str, list[tuple]], objects: dict[str, list[tuple]]) -> bytes:
    """A plain workbook: of each sheet its cells ``row, col, value`` in order of row and column (numbers,
    booleans, text; text that starts with ``=`` is a formula) and its objects ``kind, name, ref``."""
    ns = f'xmlns="{_M[1:-1]}" xmlns:r="{W._REL[1:].partition("}")[0]}"'
    out = io.BytesIO()
    tables = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = [(s, n, ref) for s, own in objects.items() for kind, n, ref in own if kind == "name"]
        quoted = lambda s: escape("'" + s.replace("'", "''") + "'")
        defined = "".join(f"<definedName name={quoteattr(n)}>{quoted(s)}!{ref}</definedName>" for s, n, ref in names)
        listed = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{listed}</sheets>" + (f"<definedNames>{defined}</definedNames>" if defined else "") + "</workbook>")
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, (sheet, cells) in enumerate(sheets.items(), 1):
            own = objects.get(sheet, [])
            refs = lambda kind, own=own: [x for x in own if x[0] == kind]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f"<worksheet {ns}><sheetData>".encode())
                row = None
                for r, c, v in cells:
                    if r != row:
                        f.write((("</row>" if row is not None else "") + f'<row r="{r}">').encode())
                        row = r
                    f.write(_cell(f"{_letters(c)}{r}", v).encode("utf-8", "replace"))
                f.write((("</row>" if row is not None else "") + "</sheetData>").encode())
                merged = "".join(f'<mergeCell ref="{ref}"/>' for _, _, ref in refs("merged"))
                f.write((f"<mergeCells>{merged}</mergeCells>" if merged else "").encode())
                checks = "".join(f'<dataValidation type="list" sqref="{ref}"><formula1>{escape(n or "")}</formula1></dataValidation>' for _, n, ref in refs("validation"))
                f.write((f"<dataValidations>{checks}</dataValidations>" if checks else "").encode())
                f.write(b"</worksheet>")
            related = []
            for _, n, ref in refs("table"):
                tables += 1
                z.writestr(f"xl/tables/table{tables}.xml", f'<table {ns} id="{tables}" name={quoteattr(n)} displayName={quoteattr(n)} ref="{ref}"/>')
                related.append(f'<Relationship Id="t{tables}" Type="{_TABLE}" Target="../tables/table{tables}.xml"/>')
            if related:
                z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", f"<Relationships>{''.join(related)}</Relationships>")
    return out.getvalue()


def _cell(ref: str, v) -> str:
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if v.startswith("="):
        return f'<c r="{ref}"><f>{escape(v[1:])}</f></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'


_WRITTEN = "file string, sheets int, cells long"


def write_workbooks(cells: DataFrame, objects: DataFrame, folder: str) -> DataFrame:
    """Write each ``file`` of ``cells(file, sheet, sheet_idx, row, col, num, str, formula)`` and
    ``objects(file, sheet, kind, name, ref)`` to ``folder``; returns ``file, sheets, cells``.

    A workbook is made by one task, in memory: it is one file of at most a million rows a
    sheet by its format.  Files are written under another name and renamed, so a task that
    runs again does no harm.  Objects: merged, validation (its list is the name), table, name.
    """

    def run(key, cells, objects):
        store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        cells = cells.sort_by([("sheet_idx", "ascending"), ("row", "ascending"), ("col", "ascending")])
        sheets: dict[str, list] = {}
        for c in cells.to_pylist():
            v = c["formula"] or (c["str"] if c["str"] is not None else c["num"])
            if v is not None:
                sheets.setdefault(c["sheet"], []).append((c["row"], c["col"], v))
        over: dict[str, list] = {}
        for o in objects.to_pylist():
            over.setdefault(o["sheet"], []).append((o["kind"], o["name"], o["ref"]))
        name = key[0].as_py()
        path = posixpath.join(at, f"{name}.xlsx")
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{path}.part") as f:
            f.write(workbook_bytes(sheets, over))
        store.move(f"{path}.part", path)
        return pa.table({"file": [name], "sheets": pa.array([len(sheets)], pa.int32()), "cells": [sum(map(len, sheets.values()))]})

    left = cells.select("file", "sheet", "sheet_idx", "row", "col", "num", "str", "formula")
    right = objects.select(*[F.col(x).alias(x) for x in ("file", "sheet", "kind", "name", "ref")])  # new names, should both sides come from one table
    return left.groupBy("file").cogroup(right.groupBy("file")).applyInArrow(run, _WRITTEN)
