"""Workbooks (.xlsx) as a data source of Spark: read in partitions of a sheet's rows, written a file a task.

A workbook is a ZIP of XML.  A sheet's XML is cut into ranges of bytes, as text files are: a partition reads the rows whose element
begins in its range.  The member is inflated from its start, which is fast; only the partition's own rows are parsed.  Of the
shared strings a partition keeps all if they are ``MOST_STRINGS`` bytes at most, else those that a batch of rows refers to, read again for each.  Only the columns of the schema are read (pruning), and conditions
are applied before a batch leaves the reader, in the source's own process.  They are an option, ``where``, and not taken from the
plan: Spark 4.1 keeps what a Python reader was told for later queries of the same DataFrame, which would then lack rows.

    read_sheets(spark, "/data/*.xlsx", "tariff string, net_mass double", header=1, where=[("net_mass", ">", 10)])

Options of reading.  ``path``: a file, a folder or a pattern on a path that all workers mount.  ``sheet``: a name; ``kind``: import or
export, the first sheet whose name speaks of it, else the first one; without both the first sheet.  ``header``: number of
the row with names, from 0; -1: none.  ``positions``: which columns the schema's fields are, by number from 0, instead of by name.
``partitionbytes``: bytes of a sheet's XML in a partition.  ``where``: JSON list of [field, sign, value]: = > >= < <= in starts ends
contains null filled; all must hold, and null fulfils only ``null``.

Defined cases.  A field without such a column is null, as are empty cells, errors and what a field's type can't hold.  Names are compared
without case and white space at the ends; of equal names the first column counts.  Texts read as they are written, numbers
in string fields without needless decimals, days and times (by their format) as ISO texts.  Rows without cells are left out.  Missing
row or cell references count on from the one before (the sheet is then one partition).  An empty sheet has no rows.

Options of writing.  ``sheet``: name of the sheet (``Sheet1``); ``preamble``: lines above the names, separated by line breaks; ``notes``: text
of another sheet in front.  A task writes one file, and one more each 1,048,576 rows; files of attempts that don't count are
removed.  Control characters are written as _xHHHH_, as the format has it.
"""

from __future__ import annotations

import functools
import glob
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import IO, Any
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from customsloom.sources.records import pick_sheet
from customsloom.sources.shared import local_path

BATCH_ROWS, CHUNK = 8_192, 1 << 20
#: Rows of a sheet, and distinct texts of a written file that are shared; further texts are written in place.
MOST_ROWS, MOST_SHARED = 1_048_576, 50_000
#: Bytes of XML of shared strings that a partition reads once and keeps.
MOST_STRINGS = 16 << 20
#: Built-in formats of days and times.  Fixed values.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ROW = re.compile(rb"<(?:\w+:)?row[\s/>]")
_END = re.compile(rb"</(?:\w+:)?sheetData\s*>")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_TO_ESCAPE = re.compile(rf"[\x00-\x08\x0b-\x1f{chr(0xFFFE)}{chr(0xFFFF)}]|_(?=x[0-9A-Fa-f]{{4}}_)")


def column_number(reference: str) -> int:
    """Of a cell's reference (``AB12``), from 0."""
    n = 0
    for c in reference:
        if not "A" <= c <= "Z":
            break
        n = n * 26 + ord(c) - 64
    return n - 1


@functools.lru_cache(1024)
def column_letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


@functools.lru_cache(1024)
def _local(tag: str) -> str:
    return re.sub(r"^(?:\{.*\}|\w+:)", "", tag)


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _escaped(text: str) -> str:
    return escape(_TO_ESCAPE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


@dataclass
class Book:
    """What a workbook's small members say: sheets in order with their members, the shared strings' member, date styles, first day."""

    sheets: dict[str, str]
    strings: str | None
    dated: frozenset[int]
    origin: datetime

    @classmethod
    def of(cls, z: zipfile.ZipFile) -> Book:
        names = {n.lower(): n for n in z.namelist()}
        book = ElementTree.fromstring(z.read(names["xl/workbook.xml"]))
        parts = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for r in ElementTree.fromstring(z.read(names["xl/_rels/workbook.xml.rels"])):
                target = r.get("Target", "")
                parts[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        sheets, early = {}, True
        for e in book.iter():
            if _local(e.tag) == "sheet":
                place = next((v for k, v in e.attrib.items() if k.endswith("}id")), None)
                sheets[e.get("name", "")] = names.get(parts.get(place, "").lower(), "")
            elif _local(e.tag) == "workbookPr":
                early = e.get("date1904") not in ("1", "true")
        return cls({k: v for k, v in sheets.items() if v}, names.get("xl/sharedstrings.xml"), cls._dates(z, names), datetime(1899, 12, 30) if early else datetime(1904, 1, 1))

    @staticmethod
    def _dates(z: zipfile.ZipFile, names: dict[str, str]) -> frozenset[int]:
        if "xl/styles.xml" not in names:
            return frozenset()
        root = ElementTree.fromstring(z.read(names["xl/styles.xml"]))
        own = {int(e.get("numFmtId")) for e in root.iter() if _local(e.tag) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower()))}
        cells = next((e for e in root.iter() if _local(e.tag) == "cellXfs"), [])
        return frozenset(i for i, e in enumerate(cells) if int(e.get("numFmtId", 0)) in DATE_FORMATS | own)

    def pick(self, sheet: str | None, kind: str | None) -> str:
        """The member of the sheet asked for."""
        if not self.sheets:
            raise ValueError("no sheet")
        if sheet is not None:
            if sheet not in self.sheets:
                raise ValueError(f"no sheet {sheet!r}; there are {', '.join(self.sheets)}")
            return self.sheets[sheet]
        return self.sheets[pick_sheet(list(self.sheets), kind) if kind else next(iter(self.sheets))]


def row_pieces(stream: IO[bytes], lo: int, hi: int) -> Iterator[bytes]:
    """The bytes of whole rows that begin from lo to before hi, some rows at a time."""
    held, base = b"", 0
    while True:
        chunk = stream.read(CHUNK)
        held += chunk
        if base + len(held) <= lo and chunk:
            base, held = base + len(held), b""
            continue
        end = _END.search(held) if not chunk or b"sheetData" in held else None
        starts = [m.start() for m in _ROW.finditer(held, max(0, lo - base), end.start() if end else len(held)) if base + m.start() >= lo]
        mine = [s for s in starts if base + s < hi]
        if mine:
            # a row is whole as the next one, or the end of rows, has been seen
            beyond = next((s for s in starts if base + s >= hi), end.start() if end else None)
            stop = beyond if beyond is not None else mine[-1] if chunk else len(held)
            if stop > mine[0]:
                yield held[mine[0] : stop]
            if beyond is not None or not chunk:
                return
            base, held = base + stop, held[stop:]
        elif end or not chunk or starts:
            return
        else:  # a tag may be cut by the end of the chunk
            keep = min(len(held), 64)
            base, held = base + len(held) - keep, held[len(held) - keep :]


def cells_of(pieces: Iterable[bytes]) -> Iterator[tuple[int | None, list[tuple[int | None, str, int, str]]]]:
    """(row number, cells (column, type, style, text)) of each row element; None where a reference is missing."""
    out: list = []
    state: dict[str, Any] = {"row": None, "cells": None, "cell": None, "text": None, "phonetic": 0}

    def begin(tag: str, attributes: dict[str, str]) -> None:
        tag = _local(tag)
        if tag == "row":
            state["row"], state["cells"] = int(attributes["r"]) if "r" in attributes else None, []
        elif tag == "c":
            state["cell"] = [column_number(attributes["r"]) if "r" in attributes else None, attributes.get("t", "n"), int(attributes.get("s", 0)), None]
        elif tag == "rPh":
            state["phonetic"] += 1
        elif tag in ("v", "t") and state["cell"] is not None and not state["phonetic"]:
            state["text"] = []

    def end(tag: str) -> None:
        tag = _local(tag)
        if tag in ("v", "t") and state["text"] is not None:
            state["cell"][3] = (state["cell"][3] or "") + "".join(state["text"])
            state["text"] = None
        elif tag == "rPh":
            state["phonetic"] -= 1
        elif tag == "c":
            state["cells"].append(tuple(state["cell"]))
            state["cell"] = None
        elif tag == "row":
            out.append((state["row"], state["cells"]))

    def text(x: str) -> None:
        if state["text"] is not None:
            state["text"].append(x)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, text
    parser.Parse(b"<rows>")
    for piece in pieces:
        parser.Parse(piece)
        yield from out
        out.clear()
    parser.Parse(b"</rows>", True)
    yield from out


def shared_strings(z: zipfile.ZipFile, member: str | None, wanted: set[int] | None) -> dict[int, str]:
    """The wanted ones of the shared strings, by number; the others are passed over.  All if wanted is None."""
    found: dict[int, str] = {}
    if member is None or wanted is not None and not wanted:
        return found
    n, most = -1, None if wanted is None else max(wanted)
    with z.open(member) as f:
        inside, phonetic = [], 0
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            tag = _local(e.tag)
            if tag == "rPh":
                phonetic += 1 if event == "start" else -1
            elif event == "start" and tag == "si":
                n, inside = n + 1, []
            elif event == "end" and tag == "t" and not phonetic:
                inside.append(e.text or "")
            elif event == "end" and tag == "si":
                if wanted is None or n in wanted:
                    found[n] = _unescaped("".join(inside))
                e.clear()
                if most is not None and n >= most:
                    break
    return found


def _moment(serial: float, origin: datetime) -> datetime | None:
    try:
        return origin + timedelta(seconds=round(serial * 86_400, 3))
    except OverflowError:
        return None


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def value_of(cell: tuple[int | None, str, int, str | None], strings: dict[int, str], book: Book, kind: pa.DataType) -> Any:
    """A cell as a value of a type; None where it has none."""
    _, t, style, raw = cell
    if raw is None or t == "e":
        return None
    text, number, moment = None, None, None
    if t == "s":
        text = strings.get(int(raw))
    elif t in ("inlineStr", "str"):
        text = _unescaped(raw)
    elif t == "d":
        text = raw
    else:
        number = _number(raw)
        if number is not None and t == "n" and (style in book.dated or pa.types.is_date(kind) or pa.types.is_timestamp(kind)):
            moment = _moment(number, book.origin)
    if pa.types.is_string(kind):
        if text is not None:
            return text or None
        if t == "b":
            return "true" if number else "false"
        if moment is not None:
            return moment.date().isoformat() if moment == datetime(moment.year, moment.month, moment.day) else moment.isoformat(sep=" ")
        return None if number is None else str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)
    if pa.types.is_date(kind) or pa.types.is_timestamp(kind):
        if text is not None:
            try:
                moment = datetime.fromisoformat(text.strip())
            except ValueError:
                return None
        return None if moment is None else moment.date() if pa.types.is_date(kind) else moment
    if text is not None:
        number = _number(text.strip())
        if pa.types.is_boolean(kind) and text.strip().lower() in ("true", "false"):
            number = float(text.strip().lower() == "true")
    if number is None or number != number:
        return None
    if pa.types.is_boolean(kind):
        return bool(number)
    if pa.types.is_integer(kind):
        return int(number) if number == int(number) and -(2 ** (kind.bit_width - 1)) <= number < 2 ** (kind.bit_width - 1) else None
    return number


@dataclass
class Range(ds.InputPartition):
    path: str
    lo: int
    hi: int


def _files(path: str) -> list[str]:
    at = local_path(path)
    found = sorted(glob.glob(os.path.join(at, "*.xlsx"))) if os.path.isdir(at) else sorted(glob.glob(at))
    if not found:
        raise FileNotFoundError(f"no workbook at {path}")
    return found


_COMPARE = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
_PARTS = {"starts": pc.starts_with, "ends": pc.ends_with, "contains": pc.match_substring}


def passes(column: pa.Array, sign: str, value: Any) -> pa.Array:
    """Where a condition holds; null is no."""
    if sign in ("null", "filled"):
        return pc.is_null(column) if sign == "null" else pc.is_valid(column)
    if sign in _PARTS:
        return _PARTS[sign](column, value)
    if sign == "in":
        return pc.is_in(column, value_set=pa.array([v for v in value if v is not None]).cast(column.type))
    if sign not in _COMPARE:
        raise ValueError(f"no such condition: {sign}")
    return _COMPARE[sign](column, pa.scalar(value).cast(column.type))


class SheetReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.where = dict(options), schema, json.loads(options.get("where", "[]"))
        if missing := [c for c, *_ in self.where if c not in schema.names]:
            raise ValueError(f"conditions on fields that aren't read: {', '.join(missing)}")
        self.header = int(options.get("header", 0))
        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> Sequence[ds.InputPartition]:
        step, out = int(self.options.get("partitionbytes", 16 << 20)), []
        for path in _files(self.options["path"]):
            with zipfile.ZipFile(path) as z:
                member = Book.of(z).pick(self.options.get("sheet"), self.options.get("kind"))
                size = z.getinfo(member).file_size
                with z.open(member) as f:
                    numbered = next((number is not None for number, _ in cells_of(self._first(f))), True)
            ends = [*range(step, size, step), size] if numbered else [size]
            out += [Range(path, lo, hi) for lo, hi in zip([0, *ends], ends, strict=False)]
        return out

    @staticmethod
    def _first(f: IO[bytes]) -> Iterator[bytes]:
        for piece in row_pieces(f, 0, 1 << 62):
            first = re.search(rb"<(?:\w+:)?row[^>]*/>|</(?:\w+:)?row>", piece)
            yield piece[: first.end()] if first else b""
            return

    def _columns(self, z: zipfile.ZipFile, member: str, book: Book) -> dict[int, int]:
        """Field of each column that is read."""
        if "positions" in self.options:
            return {int(p): i for i, p in enumerate(self.options["positions"].split(",")) if p.strip()}
        if self.header < 0:
            return {i: i for i in range(len(self.schema))}
        own: dict[str, int] = {}
        for column, name in header_names(z, member, book, self.header):
            own.setdefault(name.strip().lower(), column)
        return {own[n]: i for i, n in enumerate(x.strip().lower() for x in self.schema.names) if n in own}

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Range)
        with zipfile.ZipFile(partition.path) as z:
            book = Book.of(z)
            member = book.pick(self.options.get("sheet"), self.options.get("kind"))
            columns = self._columns(z, member, book)
            rows: list[dict[int, tuple]] = []
            few = book.strings is not None and z.getinfo(book.strings).file_size <= MOST_STRINGS
            strings = shared_strings(z, book.strings, None) if few else None
            with z.open(member) as f:
                number = 0
                for at, cells in cells_of(row_pieces(f, partition.lo, partition.hi)):
                    number = number + 1 if at is None else at
                    if number <= self.header + 1 or not cells:
                        continue
                    mine, column = {}, -1
                    for cell in cells:
                        column = column + 1 if cell[0] is None else cell[0]
                        if column in columns:
                            mine[columns[column]] = cell
                    if any(c[3] is not None for c in cells):
                        rows.append(mine)
                    if len(rows) >= BATCH_ROWS:
                        yield from self._batch(z, book, rows, strings)
                        rows = []
            yield from self._batch(z, book, rows, strings)

    def _batch(self, z: zipfile.ZipFile, book: Book, rows: list[dict[int, tuple]], strings: dict[int, str] | None = None) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        if strings is None:
            strings = shared_strings(z, book.strings, {int(c[3]) for r in rows for c in r.values() if c[1] == "s" and c[3] is not None})
        arrays = []
        for i, field in enumerate(self.arrow):
            arrays.append(pa.array([value_of(r[i], strings, book, field.type) if i in r else None for r in rows], field.type))
        batch = pa.RecordBatch.from_arrays(arrays, schema=self.arrow)
        for name, sign, *value in self.where:
            batch = batch.filter(passes(batch.column(name), sign, value[0] if value else None))
        if batch.num_rows:
            yield batch


def header_names(z: zipfile.ZipFile, member: str, book: Book, header: int) -> list[tuple[int, str]]:
    """(column, name) of the row of names."""
    with z.open(member) as f:
        number = 0
        for at, cells in cells_of(row_pieces(f, 0, 1 << 62)):
            number = number + 1 if at is None else at
            if number > header + 1:
                break
            if number == header + 1:
                strings = shared_strings(z, book.strings, {int(c[3]) for c in cells if c[1] == "s" and c[3] is not None})
                out, column = [], -1
                for c in cells:
                    column = column + 1 if c[0] is None else c[0]
                    out.append((column, value_of(c, strings, book, pa.string()) or f"_c{column}"))
                return out
    return []


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class SheetWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.options, self.names, self.overwrite = dict(options), schema.names, overwrite
        self.folder = local_path(self.options["path"])
        self.before = sorted(glob.glob(f"{self.folder}/*.xlsx")) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ds.WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        context = TaskContext.get()
        files: list[str] = []
        book: Workbook | None = None
        try:
            for batch in iterator:
                at = 0
                while at < batch.num_rows:
                    if book is None or book.room == 0:
                        if book is not None:
                            book.close()
                        files.append(f"{self.folder}/.{uuid.uuid4().hex}.part-{context.partitionId() if context else 0:05d}-{len(files):03d}.xlsx")
                        book = Workbook(files[-1], self.names, self.options)
                    part = batch.slice(at, book.room)
                    book.add(part)
                    at += part.num_rows
        finally:
            if book is not None:
                book.close()
        return Written(files)

    def commit(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        run = uuid.uuid4().hex[:8]
        for old in self.before:
            os.remove(old)
        for m in messages:
            for f in m.files if isinstance(m, Written) else []:
                os.replace(f, f"{self.folder}/{os.path.basename(f)[34:-5]}-{run}.xlsx")

    def abort(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        for m in messages:
            for f in m.files if isinstance(m, Written) else []:
                if os.path.exists(f):
                    os.remove(f)


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE, _TYPE = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"


class Workbook:
    """One written file: rows go to the sheet as they come, the texts that are shared at its end."""

    def __init__(self, path: str, names: list[str], options: dict[str, str]):
        self.zip = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=3)
        self.shared: dict[str, int] = {}
        self.uses = 0
        self.sheets = [options.get("sheet", "Sheet1")]
        if "notes" in options:
            self.sheets.insert(0, "Notes")
            with self.zip.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{self._cell(0, 1, options["notes"])}</row></sheetData></worksheet>'.encode())
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.row = 0
        for line in options["preamble"].split("\n") if "preamble" in options else []:
            self._line([line] if line else [])
        self._line(names)

    @property
    def room(self) -> int:
        return MOST_ROWS - self.row

    def _cell(self, column: int, row: int, value: Any) -> str:
        at = f'r="{column_letters(column)}{row}"'
        if isinstance(value, bool):
            return f'<c {at} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, datetime | date):
            days = datetime(value.year, value.month, value.day) - datetime(1899, 12, 30)
            part = (value.hour * 3600 + value.minute * 60 + value.second + value.microsecond / 1e6) / 86_400 if isinstance(value, datetime) else 0
            return f'<c {at} s="{2 if isinstance(value, datetime) else 1}"><v>{days.days + part!r}</v></c>'
        if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
            return f"<c {at}><v>{value!r}</v></c>"
        text = str(value)
        if text not in self.shared and len(self.shared) >= MOST_SHARED:
            return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{_escaped(text)}</t></is></c>'
        self.uses += 1
        return f'<c {at} t="s"><v>{self.shared.setdefault(text, len(self.shared))}</v></c>'

    def _line(self, values: Iterable[Any]) -> None:
        self.row += 1
        cells = "".join(self._cell(i, self.row, v) for i, v in enumerate(values) if v is not None)
        self.sheet.write(f'<row r="{self.row}">{cells}</row>'.encode())

    def add(self, batch: pa.RecordBatch) -> None:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            self._line(row)

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        with self.zip.open("xl/sharedStrings.xml", "w") as f:
            f.write(f'{_HEAD}<sst xmlns="{_MAIN}" count="{self.uses}" uniqueCount="{len(self.shared)}">'.encode())
            for text in self.shared:
                f.write(f'<si><t xml:space="preserve">{_escaped(text)}</t></si>'.encode())
            f.write(b"</sst>")
        put, n = self.zip.writestr, len(self.sheets)
        put("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        put("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{_escaped(s)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(self.sheets)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n))
        put("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{n + 1}" Type="{_REL}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId{n + 2}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        put("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in range(n))
        put("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{parts}<Override PartName="/xl/sharedStrings.xml" ContentType="{_TYPE}.sharedStrings+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>')
        self.zip.close()


class Sheets(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> StructType:
        """The names of the first file's row of names, all as strings."""
        with zipfile.ZipFile(_files(self.options["path"])[0]) as z:
            book = Book.of(z)
            member = book.pick(self.options.get("sheet"), self.options.get("kind"))
            names, seen = [], set()
            for _, name in header_names(z, member, book, int(self.options.get("header", 0))):
                if name.strip().lower() not in seen:
                    seen.add(name.strip().lower())
                    names.append(name.strip())
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return SheetReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        return SheetWriter(self.options, schema, overwrite)


def read_sheets(spark: SparkSession, path: str, schema: str | None = None, where: list[tuple] | None = None, **options: object) -> DataFrame:
    """Rows of the workbooks at a path; options as the module says."""
    spark.dataSource.register(Sheets)
    if where:
        options["where"] = json.dumps(where)
    reader = spark.read.format("sheets").options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load(path)


def write_sheets(rows: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Rows as workbooks, a file a task."""
    rows.sparkSession.dataSource.register(Sheets)
    rows.write.format("sheets").options(**{k: str(v) for k, v in options.items()}).mode(mode).save(path)


#: Layouts of declaration sheets: row of names, and the columns of country of export and import, tariff, description and mass.  Fixed values.
LAYOUTS = {"export": (1, "0,1,3,4,5"), "import": (2, "0,1,2,3,4")}
RECORD = "export_country string, import_country string, tariff string, description string, net_mass string"


def read_declarations(spark: SparkSession, path: str, kind: str, where: list[tuple] | None = None) -> DataFrame:
    """Declaration rows of the sheets of a kind, by place where the layout has at least five columns (with conditions, if any), else by the names' aliases."""
    from customsloom.sources.records import by_alias

    header, positions = LAYOUTS[kind]
    named = read_sheets(spark, path, kind=kind, header=header)
    if len(named.columns) >= 5:
        return read_sheets(spark, path, RECORD, where, kind=kind, header=header, positions=positions)
    if kind == "import":
        raise ValueError(f"a sheet of imports has five columns, not {len(named.columns)}")
    rows = by_alias(named)
    return rows.select(*(f.split(" ")[0] for f in RECORD.split(", ")))
