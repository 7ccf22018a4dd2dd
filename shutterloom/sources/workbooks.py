"""Workbooks: tables written as sheets of one .xlsx file, and sheets read as cells. Only the parts of the format that tables need.

Tasks turn rows into markup, which passes through the driver a piece at a time, straight into the archive; a sheet that
reaches the format's limit of rows goes on in another. Markup names no places: rows and cells stand in order, and an empty
cell keeps its place. A sheet is read as a stream, so a task holds some cells beside the file as it is packed.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from datetime import date, datetime
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet, its header included: a limit of the format.
SHEET_ROWS = 1_048_576
#: Rows of a piece of markup, cells handed on at once, and bytes of markup read at once.
PIECE, CELLS_AT_ONCE, READ = 5_000, 20_000, 1 << 18
CELLS = "file string, sheet string, row int, col int, value string"
# Names of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_UNSEEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


class _Stored(io.RawIOBase):
    """A file of any Hadoop file system, written from its start to its end."""

    def __init__(self, spark: SparkSession, path: str):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def column_name(number: int) -> str:
    """1 as A, 27 as AA."""
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(name: str) -> int:
    out = 0
    for ch in name:
        out = out * 26 + ord(ch) - 64
    return out


def cell(value: object) -> str:
    """A cell's markup: numbers and booleans as such, lists joined, all else as text; an empty cell for null."""
    if value is None or value == "" or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, (list, tuple)):
        value = ", ".join("" if v is None else str(v) for v in value)
    elif isinstance(value, datetime):
        value = value.replace(tzinfo=None).isoformat()
    elif isinstance(value, date):
        value = value.isoformat()
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNSEEN.sub("", str(value)))}</t></is></c>'


def row_markup(values: Sequence[object]) -> str:
    return f"<row>{''.join(map(cell, values))}</row>"


def _pieces(df: DataFrame) -> Iterator[tuple[int, bytes]]:
    """(rows, their markup) in the order of `df`, made and packed by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                part = batch.slice(start, PIECE)
                text = "".join(map(row_markup, zip(*[c.to_pylist() for c in part.columns], strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([zlib.compress(text.encode(), 1)], pa.binary())], ["n", "packed"])

    for r in df.mapInArrow(run, "n int, packed binary").toLocalIterator(prefetchPartitions=False):
        yield r.n, zlib.decompress(r.packed)


def _cut(markup: bytes, rows: int) -> tuple[bytes, bytes]:
    """The first `rows` rows of markup, and the rest."""
    end = b"</row>"
    parts = markup.split(end)
    return end.join(parts[:rows]) + end, end.join(parts[rows:])


def sheet_name(name: str, taken: set[str]) -> str:
    """A name that the format allows and no sheet has yet."""
    clean = re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"
    out, n = clean, 2
    while out.lower() in taken:
        out, n = f"{clean[:27]} ({n})", n + 1
    taken.add(out.lower())
    return out


def write_workbook(sheets: Mapping[str, DataFrame], path: str, most: int = SHEET_ROWS) -> list[str]:
    """One sheet per table, in order, under its column names; the sheets' names.

    A table keeps the order of its rows. Nulls are empty cells; a table without rows is a sheet with its header.
    """
    return [n for names in write_sheets(sheets, path, most).values() for n in names]


def write_sheets(sheets: Mapping[str, DataFrame], path: str, most: int = SHEET_ROWS) -> dict[str, list[str]]:
    """As write_workbook(), with the names of the sheets of each table: more than one where it has `most` rows or more."""
    spark = next(iter(sheets.values())).sparkSession
    taken: set[str] = set()
    names: list[str] = []
    written: dict[str, list[str]] = {}
    buffered = io.BufferedWriter(_Stored(spark, path), 1 << 20)
    with zipfile.ZipFile(buffered, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, df in sheets.items():
            pieces, rest = _pieces(df), None
            written[name] = []
            while True:
                names.append(sheet_name(name, taken))
                written[name].append(names[-1])
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{row_markup(df.columns)}'.encode())
                    room = most - 1
                    while rest := rest or next(pieces, None):
                        n, markup = rest
                        if n > room:
                            first, markup = _cut(markup, room) if room else (b"", markup)
                            out.write(first)
                            rest = n - room, markup
                            break
                        out.write(markup)
                        room, rest = room - n, None
                    out.write(b"</sheetData></worksheet>")
                if rest is None:
                    break
        parts = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{parts}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{kinds}</Types>')
    buffered.close()
    return written


def _sheet_cells(part: io.BufferedIOBase, strings: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, col, text) of the cells of a sheet that hold something. A row or cell that names no place follows the one before."""
    out: list[tuple[int, int, str]] = []
    row = col = 0
    kind, inside, text = None, False, []
    tags = {f"{_MAIN} {t}": t for t in ("row", "c", "t", "v")}

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal row, col, kind, inside
        tag = tags.get(tag)
        if tag == "row":
            row, col = int(attributes["r"]) if "r" in attributes else row + 1, 0
        elif tag == "c":
            kind, col = attributes.get("t"), col + 1
            text.clear()
            if at := attributes.get("r"):
                letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", at).groups()
                row, col = int(digits), column_number(letters)
        elif tag:
            inside = (tag == "t") == (kind == "inlineStr")

    def end(tag: str) -> None:
        nonlocal inside
        tag = tags.get(tag)
        if tag in ("t", "v"):
            inside = False
        elif tag == "c" and text:
            value = "".join(text)
            if kind != "inlineStr":
                value = strings[int(value)] if kind == "s" else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
            if value:
                out.append((row, col, value))

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: text.append(data) if inside else None
    while data := part.read(READ):
        parser.Parse(data)
        yield from out
        out.clear()
    parser.Parse(b"", True)
    yield from out


def cells_of(content: bytes | io.IOBase, sheets: Sequence[str] | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, text) of every cell of a workbook, or of some of its sheets, that holds something, sheets in their order."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in item.iter(f"{{{_MAIN}}}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
            if sheets is not None and sheet.get("name") not in sheets:
                continue
            target = targets[sheet.get(f"{{{_OFFICE}}}id")]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                for found in _sheet_cells(part, strings):
                    yield sheet.get("name"), *found


def read_cells(spark: SparkSession, path: str, sheets: Sequence[str] | None = None) -> DataFrame:
    """CELLS of all workbooks under `path`, or of some of their sheets, through Spark's reader; a file that
    is no workbook has none, one that breaks off has those before."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())])

    def batch(file: str, cells: list[tuple]) -> pa.RecordBatch:
        columns = [[file] * len(cells), *zip(*cells, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.types, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches:
            for file, content in zip(frame.column(0), frame.column(1), strict=True):
                cells: list[tuple] = []
                try:
                    for found in cells_of(pa.BufferReader(content.as_buffer()), sheets):
                        cells.append(found)
                        if len(cells) == CELLS_AT_ONCE:
                            yield batch(file.as_py(), cells)
                            cells = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, expat.ExpatError):
                    pass
                if cells:
                    yield batch(file.as_py(), cells)

    return files.mapInArrow(run, CELLS)


def read_back(spark: SparkSession, path: str, parts: Mapping[str, Sequence[str]], most: int = SHEET_ROWS) -> DataFrame:
    """CELLS of what write_sheets() wrote (`parts` is its result, or some of it): each table as one sheet under its name,
    the rows of sheets that go on numbered on."""
    where = {n: (name, k) for name, names in parts.items() for k, n in enumerate(names)}
    cells = read_cells(spark, path, list(where))
    name, place = (F.create_map(*[F.lit(x) for n, at in where.items() for x in (n, at[k])])[F.col("sheet")] for k in (0, 1))
    cells = cells.withColumn("_name", name).withColumn("_place", place).where((F.col("_place") == 0) | (F.col("row") > 1))
    return cells.select("file", F.col("_name").alias("sheet"), (F.col("row") + F.col("_place") * (most - 1)).cast("int").alias("row"), "col", "value")


def as_table(cells: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """A sheet's rows below its header, as text, under the given names of its first columns."""
    rows = cells.where((F.col("sheet") == sheet) & (F.col("row") > 1))
    return rows.groupBy("file", "row").pivot("col", list(range(1, len(columns) + 1))).agg(F.first("value")).select("row", *[F.col(str(k)).alias(n) for k, n in enumerate(columns, 1)])
