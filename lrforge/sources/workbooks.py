"""Workbooks (.xlsx) as a Spark data source: spark.read.format("workbooks") and df.write.format("workbooks").

Reading: a sheet is a partition, the largest first. Its XML is parsed a piece at a time, and
shared strings lie in a temporary file with their offsets, so that a task holds some thousand
cells, whatever the sheet's size. XML in the form that is written here is taken apart by array
operations, as long as it keeps that form to the byte; all other XML goes through a parser. A sheet or file that can't be read is one row with its error.

Writing: rows (scenario_id, sheet, row_idx, col_idx, value), a workbook a scenario.
write_workbooks deals blocks of rows; tasks write the deflated XML of their blocks, and a task a
workbook strings these together as they are. Attempts write below a staging folder of their
job; the driver moves the files of successful ones to their places, or removes the folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import PurePosixPath
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lrforge.functions.text import na_to_null
from lrforge.schemas import CELLS
from lrforge.sources.stores import store_of

# Name spaces and content types of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
NS, REL = f"{{{MAIN}}}", f"{{{OFFICE}}}"

PIECE, COPIED, SPOOLED, NAME_LENGTH = 1 << 19, 1 << 22, 1 << 24, 31
BLOCK_ROWS, LEVEL = 1 << 14, 3
BEGIN, END = f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode(), b"</sheetData></worksheet>"
FINAL = b"\x03\x00"  # an empty last block of a deflated stream
CRC = 0xEDB88320
# What stands around rows, references and texts as they are written, and characters that only a parser reads rightly.
ROW_BEGIN, ROW_END, CELL_BEGIN = b'<row r="', b"</row>", b'<c r="'
TEXT_BEGIN, TEXT_END = b'" t="inlineStr"><is><t xml:space="preserve">', b"</t></is></c>"
CONTROLS, NO_CHARACTERS = bytes(i for i in range(32) if i not in (9, 10)), (b"\xef\xbf\xbe", b"\xef\xbf\xbf")
ENTITY = re.compile(b"&(?!amp;|lt;|gt;)")
INDEX = "scenario_id string, sheet string, block long, file string, start long, length long, size long, crc long"
SCHEMA = f"{CELLS}, header string, error string"


def column_number(reference: str) -> int:
    """Zero-based column of a cell reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def _text(node: ElementTree.Element) -> str:
    """Text of an inline or shared string: its own and its runs' t, without phonetic hints."""
    return "".join(t.text or "" for part in (node, *node.iter(f"{NS}r")) for t in part.findall(f"{NS}t"))


def _pulled(stream: Any, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end; what came before them is let go."""
    above: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(node)
            continue
        above.pop()
        if node.tag == f"{NS}{tag}":
            yield node
            if above:
                above[-1].clear()


class SharedStrings:
    """The strings of a workbook by number, in a temporary file; eight bytes each stay in memory."""

    def __init__(self, book: zipfile.ZipFile):
        self.offsets, self.file = array("Q", [0]), tempfile.SpooledTemporaryFile(SPOOLED)
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                for node in _pulled(stream, "si"):
                    self.file.write(_text(node).encode())
                    self.offsets.append(self.file.tell())

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.offsets) - 1:
            raise ValueError(f"no shared string {i}")
        self.file.seek(self.offsets[i])
        return self.file.read(self.offsets[i + 1] - self.offsets[i]).decode()


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path in the archive) of the sheets, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{NS}sheet"):
        target = targets[sheet.get(f"{REL}id")]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else str(PurePosixPath("xl") / target)))
    return out


def _rows(book: zipfile.ZipFile, path: str, done: int = 0) -> Iterator[list[ElementTree.Element]]:
    """Rows of a sheet after the first done, those of a piece of its XML at once, parsed without a call for each element.

    The last row so far waits, as it may go on. XML that breaks off is read again row by row, up to the break.
    """
    at = 0
    with book.open(path) as stream:
        builder = ElementTree.TreeBuilder()
        parser = ElementTree.XMLParser(target=builder)
        try:
            while piece := stream.read(PIECE):
                parser.feed(piece)
                root = builder.close()  # what is built so far; building goes on
                sheet = None if root is None else root.find(f"{NS}sheetData")
                if sheet is not None and len(sheet) > 1:
                    found = sheet[:-1]
                    del sheet[:-1]
                    yield found[max(done - at, 0) :]
                    at += len(found)
            sheet = parser.close().find(f"{NS}sheetData")
            if sheet is not None:
                yield sheet[max(done - at, 0) :]
            return
        except ElementTree.ParseError:
            pass
    with book.open(path) as stream:
        for n, row in enumerate(_pulled(stream, "row")):
            if n >= max(done, at):
                yield [row]


Cells = tuple[np.ndarray, np.ndarray, pa.Array]


class Columns(dict):
    """Columns by the letters of a reference, each worked out once."""

    def __missing__(self, letters: str) -> int:
        n = self[letters] = column_number(letters)
        return n


def _are(data: np.ndarray, at: np.ndarray, mark: bytes) -> bool:
    """Whether a mark stands at all of these places."""
    if not len(at):
        return True
    if at.min() < 0 or at.max() + len(mark) > len(data):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(data, len(mark))[at] == np.frombuffer(mark, np.uint8)).all())


def _whole_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray | None:
    """Numbers of one to nine digits between places, or None if one isn't such a number."""
    lengths, out = end - start, np.zeros(len(start), np.int64)
    if len(start) and (lengths.min() < 1 or lengths.max() > 9):
        return None
    for p in range(int(lengths.max(initial=0))):
        there = lengths > p
        digits = data[start[there] + p].astype(np.int64) - 48
        if ((digits < 0) | (digits > 9)).any():
            return None
        out[there] = out[there] * 10 + digits
    return out


def _regular_cells(raw: bytes) -> tuple[Cells, int] | None:
    """Cells and number of rows of XML that cells as write_workbooks writes them make up to the last byte; None of any other."""
    data = np.frombuffer(raw, np.uint8)
    begins, ends = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    if len(begins) != len(ends) or len(raw) >= 1 << 31 or not ((begins < ends).all() and (ends[:-1] < begins[1:]).all()):
        return None
    tags = np.flatnonzero(data[begins + 1] == ord("c"))
    if not len(tags) or tags[-1] + 5 >= len(begins):
        return None
    cell, text, text_end = begins[tags], ends[tags + 2] + 1, begins[tags + 3]
    reference, reference_end, after = cell + len(CELL_BEGIN), text - len(TEXT_BEGIN), text_end + len(TEXT_END)
    if not (_are(data, cell, CELL_BEGIN) and _are(data, reference_end, TEXT_BEGIN) and _are(data, text_end, TEXT_END)) or raw[after[-1] :] != ROW_END:
        return None
    opened = np.append(True, cell[1:] != after[:-1])
    row_end, row = np.append(-len(ROW_END), after[:-1])[opened], cell[opened]
    number = _whole_numbers(data, row_end + len(ROW_END + ROW_BEGIN), row - 2)
    if number is None or not (_are(data, row_end[1:], ROW_END + ROW_BEGIN) and raw.startswith(ROW_BEGIN) and _are(data, row - 2, b'">')):
        return None
    letters, columns, going = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64), np.ones(len(cell), bool)
    for p in range(4):
        at = data[reference + p].astype(np.int64) - 64
        going &= (at >= 1) & (at <= 26)
        columns, letters = np.where(going, columns * 26 + at, columns), letters + going
    own = _whole_numbers(data, reference + letters, reference_end)
    rows = number[np.cumsum(opened) - 1]
    if own is None or letters.min() < 1 or (own != rows).any():
        return None
    sizes = text_end - text
    offsets = np.append(0, np.cumsum(sizes))
    places = np.arange(offsets[-1]) + np.repeat(text - offsets[:-1], sizes)
    texts = pa.StringArray.from_buffers(len(cell), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[places]))
    if b"&" in raw:
        for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            texts = pc.replace_substring(texts, entity, c)
    rows, columns = rows - 1, columns - 1
    if not sizes.all():
        rows, columns, texts = rows[sizes > 0], columns[sizes > 0], texts.filter(pa.array(sizes > 0))
    return (rows, columns, texts), len(number)


def _regular(book: zipfile.ZipFile, path: str) -> Iterator[Cells]:
    """Cells of a sheet as long as its XML is as write_workbooks writes it; then how many rows these were and the last one's number, or None at the sheet's end."""
    done, last, left = 0, -1, b""
    with book.open(path) as stream:
        if stream.read(len(BEGIN)) != BEGIN:
            return done, last
        while piece := stream.read(PIECE):
            left += piece
            end = left.rfind(ROW_END) + len(ROW_END)
            if end < len(ROW_END):
                continue
            raw, left = left[:end], left[end:]
            if len(raw.translate(None, CONTROLS)) < len(raw) or any(x in raw for x in NO_CHARACTERS) or b"&" in raw and ENTITY.search(raw):
                return done, last
            try:
                raw.isascii() or raw.decode()
            except UnicodeDecodeError:
                return done, last
            if (found := _regular_cells(raw)) is None:
                return done, last
            done, last = done + found[1], int(raw[raw.rfind(ROW_BEGIN) + len(ROW_BEGIN) :].split(b'"', 1)[0]) - 1
            yield found[0]
    return None if left == END else (done, last)


def cells_of(book: zipfile.ZipFile, path: str) -> Iterator[Cells]:
    """Rows, columns and texts of the cells with text of one sheet, a piece at a time."""
    strings: SharedStrings | None = None
    by_letters, is_tag, t_tag, v_tag, c_tag = Columns(), f"{NS}is", f"{NS}t", f"{NS}v", f"{NS}c"
    if (rest := (yield from _regular(book, path))) is None:
        return
    done, at = rest
    for found in _rows(book, path, done):
        rows, columns, texts = [], [], []
        failed = None
        try:
            for row in found:
                if row.tag != f"{NS}row":
                    continue
                at = int(row.get("r")) - 1 if row.get("r") else at + 1
                column = -1
                for cell in row.iter(c_tag):
                    reference, kind = cell.get("r"), cell.get("t")
                    column = by_letters[reference.rstrip("0123456789")] if reference else column + 1
                    if kind == "inlineStr":
                        inline = cell.find(is_tag)
                        if inline is None:
                            continue
                        text = inline[0].text if len(inline) == 1 and inline[0].tag == t_tag else _text(inline)
                    else:
                        value = cell.find(v_tag)
                        if value is None:
                            continue
                        text = value.text
                        if kind == "s":
                            strings = strings or SharedStrings(book)
                            text = strings[int(text)]
                    if text:
                        rows.append(at)
                        columns.append(column)
                        texts.append(text)
        except Exception as e:  # noqa: BLE001 - cells before it count
            failed = e
        yield np.array(rows, np.int64), np.array(columns, np.int64), pa.array(texts, pa.string())
        if failed:
            raise failed


class Names(dict):
    def __missing__(self, column: int) -> str:
        return f"Unnamed: {column}"


def with_headers(cells: Iterable[Cells]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Cells below a sheet's first row, numbered from 0, with their column's name there.

    A name that comes again gets .1, .2 and so on, as a column without one is called Unnamed and its number.
    """
    first, names, seen = None, Names(), {}
    for rows, columns, texts in cells:
        if first is None and len(rows):
            first = int(rows[0])
        if (rows == first).any():
            for i in np.flatnonzero(rows == first).tolist():
                column, text = int(columns[i]), texts[i].as_py()
                n = seen[text] = seen.get(text, -1) + 1
                names[column] = text if not n else f"{text}.{n}"
            below = rows != first
            rows, columns, texts = rows[below], columns[below], texts.filter(pa.array(below))
        there, nth = np.unique(columns, return_inverse=True)
        yield rows - (first or 0) - 1, columns, texts, pa.array([names[int(c)] for c in there], pa.string()).take(pa.array(nth))


@dataclass
class Sheet(InputPartition):
    file: str
    name: str | None = None
    path: str | None = None
    error: str | None = None
    size: int = 0

    def __post_init__(self) -> None:
        super().__init__(None)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.header = options["path"], options.get("header", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """A sheet each; of files only the directory and the list of sheets are read here."""
        store, top = store_of(self.folder)
        found = store.get_file_info(top)
        files = [top] if found.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".xlsx"))
        hidden = lambda f: any(p.startswith((".", "_")) for p in PurePosixPath(f[len(top) :]).parts)
        out: list[InputPartition] = []
        for file in files:
            if hidden(file):
                continue
            try:
                with store.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                    sizes = {i.filename: i.file_size for i in book.infolist()}
                    out += [Sheet(file, name, path, size=sizes.get(path, 0)) for name, path in sheets_of(book)]
            except Exception as e:  # noqa: BLE001 - a bad file is data
                out.append(Sheet(file, error=f"{type(e).__name__}: {e}"))
        return sorted(out, key=lambda sheet: -sheet.size) or [Sheet("")]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        scenario = PurePosixPath(partition.file).stem
        if partition.error:
            yield self._batch(scenario, None, error=partition.error)
        if not partition.path:
            return
        try:
            store, _ = store_of(self.folder)
            with store.open_input_file(partition.file) as f, zipfile.ZipFile(f) as book:
                cells = cells_of(book, partition.path)
                for found in with_headers(cells) if self.header else cells:
                    yield self._batch(scenario, partition.name, *found)
        except Exception as e:  # noqa: BLE001 - a bad sheet is data
            yield self._batch(scenario, partition.name, error=f"{type(e).__name__}: {e}")

    @staticmethod
    def _batch(scenario: str, sheet: str | None, row: Any = (), column: Any = (), text: Any = (), header: Any = None, error: str | None = None) -> pa.RecordBatch:
        if error:
            row = column = text = [None]
        n = len(row)
        constant = lambda v: pa.repeat(pa.scalar(v, pa.string()), n)
        columns = [constant(scenario), constant(sheet), pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(text, pa.string()), constant(None) if header is None else pa.array(header, pa.string()), constant(error)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, the highest bit the lowest power."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ CRC if b & 1 else b >> 1
    return product


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two texts one after the other, of their own and the size of the second."""
    power, square, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = _times(square, power)
        square, n = _times(square, square), n >> 1
    return _times(power, first) ^ second


def _ids(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def sheet_xml(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str, int], bytes]]:
    """XML of cells that come by scenario and sheet, rows ascending, with (scenario, sheet, block of rows).

    A block's rows are opened and closed within it. A cell without a value isn't written,
    but its sheet is.
    """
    key = row = None
    for batch in batches:
        if not batch.num_rows:
            continue
        scenario, sheet, at, column, value = (batch.column(batch.schema.get_field_index(c)) for c in ("scenario_id", "sheet", "row_idx", "col_idx", "value"))
        there, rows = value.is_valid().to_numpy(zero_copy_only=False), at.to_numpy(zero_copy_only=False).astype(np.int64)
        blocks = rows // BLOCK_ROWS
        new = np.zeros(len(rows), bool)
        for ids in (_ids(scenario), _ids(sheet), blocks):
            new[1:] |= ids[1:] != ids[:-1]
        keys = {int(i): (scenario[i].as_py(), sheet[i].as_py(), int(blocks[i])) for i in (0, *np.flatnonzero(new))}
        run = np.cumsum(new)[there]
        opened, kept = np.zeros(len(rows), bool), rows[there]
        if len(kept):
            opened[there] = np.append(run[0] > 0 or keys[0] != key or kept[0] != row, (kept[1:] != kept[:-1]) | (run[1:] != run[:-1]))
        if any(pc.any(pc.match_substring(value, c)).as_py() for c in "&<>"):
            for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                value = pc.replace_substring(value, c, entity)
        number = pc.cast(pa.array(rows + 1), pa.string())
        columns, nth = np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)
        letters = pa.array([column_name(int(c)) for c in columns]).take(pa.array(nth))
        begun = pc.if_else(pa.array(opened), pc.binary_join_element_wise('</row><row r="', number, '">', ""), "")
        xml = pc.fill_null(pc.binary_join_element_wise(begun, '<c r="', letters, number, '" t="inlineStr"><is><t xml:space="preserve">', value, "</t></is></c>", ""), "")
        offsets, data = np.frombuffer(xml.buffers()[1], np.int32)[xml.offset : xml.offset + len(xml) + 1], memoryview(xml.buffers()[2] or b"")
        starts = list(keys)
        for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
            if keys[start] != key:
                if row is not None:
                    yield key, b"</row>"
                key, row = keys[start], None
            part = data[offsets[start] : offsets[end]]
            yield key, part[len("</row>") if row is None else 0 :]
            written = rows[start:end][there[start:end]]
            row = int(written[-1]) if len(written) else row
    if row is not None:
        yield key, b"</row>"


def _deflated(data: bytes) -> bytes:
    """A part of a deflated stream that any other part may precede and follow."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_FULL_FLUSH)


class BookFile:
    """One workbook on its way into a stream: sheets one after the other, rows in order."""

    def __init__(self, stream: Any):
        self.book, self.names, self.sheet = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), [], None

    def _end_sheet(self) -> None:
        if self.sheet:
            self.sheet.write(END)
            self.sheet.close()
        self.sheet = None

    def _named(self, name: str) -> str:
        self._end_sheet()
        cut = name[:NAME_LENGTH]
        if cut.lower() in (n.lower() for n in self.names):
            raise ValueError(f"two sheets are called {cut!r}")
        self.names.append(cut)
        return f"xl/worksheets/sheet{len(self.names)}.xml"

    def begin(self, name: str) -> None:
        """A sheet whose XML follows by write."""
        self.sheet = self.book.open(self._named(name), "w", force_zip64=True)
        self.sheet.write(BEGIN)

    def write(self, xml: bytes) -> None:
        self.sheet.write(xml)

    def strung(self, name: str, blocks: list[dict], copied: Callable[[dict, Any], None]) -> None:
        """A sheet of blocks that are deflated already; copied writes a block's bytes to a stream."""
        begin, end = (_deflated(x) for x in (BEGIN, END))
        sheet = zipfile.ZipInfo(self._named(name))
        sheet.compress_type, sheet.CRC = zipfile.ZIP_DEFLATED, zlib.crc32(BEGIN)
        for block in blocks:
            sheet.CRC = joined_crc(sheet.CRC, block["crc"], block["size"])
        sheet.CRC = joined_crc(sheet.CRC, zlib.crc32(END), len(END))
        sheet.file_size = len(BEGIN) + sum(b["size"] for b in blocks) + len(END)
        sheet.compress_size = len(begin) + sum(b["length"] for b in blocks) + len(end) + len(FINAL)
        out = self.book.fp
        sheet.header_offset = out.tell()
        out.write(sheet.FileHeader())
        out.write(begin)
        for block in blocks:
            copied(block, out)
        out.write(end + FINAL)
        self.book.filelist.append(sheet)
        self.book.NameToInfo[sheet.filename] = sheet
        self.book.start_dir = out.tell()

    def close(self) -> None:
        self._end_sheet()
        n = range(1, len(self.names) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in n)
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, self.names, strict=True))
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        for path, text in (
            ("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>{parts}</Types>'),
            ("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
            ("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>'),
        ):
            self.book.writestr(path, HEAD + text)
        self.book.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]  # names below the attempt's folder, which are those below the target
    attempt: str = ""


class WorkbookWriter(DataSourceArrowWriter):
    """Rows come grouped by scenario and sheet, rows and columns ascending, as write_workbooks deals them."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = store_of(self.folder)
        attempt = f"{self.staging}/{uuid.uuid4().hex}"
        files: list[str] = []
        book = stream = scenario = sheet = None
        for (s, name), part in self._parts(iterator):
            if s != scenario or book is None:
                if book:
                    book.close()
                    stream.close()
                if f"{s}.xlsx" in files:
                    raise ValueError(f"rows of {s} don't come together")
                files.append(f"{s}.xlsx")
                store.create_dir(f"{top}/{attempt}", recursive=True)
                stream = store.open_output_stream(f"{top}/{attempt}/{files[-1]}")
                book, scenario, sheet = BookFile(stream), s, None
            if name != sheet:
                self._begin(book, name, part)
                sheet = name
            self._add(book, part)
        if book:
            book.close()
            stream.close()
        return Written(files, attempt)

    def _parts(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str], Any]]:
        for (scenario, sheet, _), xml in sheet_xml(iterator):
            yield (scenario, sheet), xml

    def _begin(self, book: BookFile, name: str, part: Any) -> None:
        book.begin(name)

    def _add(self, book: BookFile, part: Any) -> None:
        book.write(part)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = store_of(self.folder)
        done = [(m.attempt, f) for m in messages if m for f in m.files]
        names = [f for _, f in done]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one scenario lie in several partitions")
        if self.overwrite and store.get_file_info(top).type == fs.FileType.Directory:
            for old in store.get_file_info(fs.FileSelector(top)):
                if old.path.endswith(".xlsx") and old.base_name not in names:
                    store.delete_file(old.path)
        for attempt, file in done:
            store.move(f"{top}/{attempt}/{file}", f"{top}/{file}")
        self._clean(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*store_of(self.folder))

    def _clean(self, store: fs.FileSystem, top: str) -> None:
        if store.get_file_info(f"{top}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.staging}")


class BlockWriter(WorkbookWriter):
    """Instead of cells come the places of their blocks, as write_blocks made them, in order; a part is a sheet's list of them."""

    def _parts(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str], list[dict]]]:
        rows = (row for batch in iterator for row in batch.to_pylist())
        for key, blocks in groupby(rows, lambda b: (b["scenario_id"], b["sheet"])):
            yield key, list(blocks)

    def _begin(self, book: BookFile, name: str, part: list[dict]) -> None:
        store, top = store_of(self.folder)

        def copied(block: dict, out: Any) -> None:
            with store.open_input_file(f"{top}/{block['file']}") as f:
                f.seek(block["start"])
                left = block["length"]
                while left:
                    data = f.read(min(left, COPIED))
                    if not data:
                        raise ValueError(f"{block['file']} ends early")
                    out.write(data)
                    left -= len(data)

        book.strung(name, part, copied)

    def _add(self, book: BookFile, part: list[dict]) -> None:
        pass


def write_blocks(folder: str, staging: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's cells that writes the deflated XML of its blocks to one file and gives their places."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(folder)
        file, out, places, names = f"{staging}/{uuid.uuid4().hex}", None, [], [f.split()[0] for f in INDEX.split(", ")]
        at = 0
        for key, parts in groupby(sheet_xml(batches), lambda p: p[0]):
            out = out or store.open_output_stream(f"{top}/{file}")
            packer, start, size, crc = zlib.compressobj(LEVEL, zlib.DEFLATED, -15), at, 0, 0
            for _, xml in parts:
                at += out.write(packer.compress(xml))
                size, crc = size + len(xml), zlib.crc32(xml, crc)
            at += out.write(packer.flush(zlib.Z_FULL_FLUSH))
            places.append((*key, file, start, at - start, size, crc))
        if out:
            out.close()
            kinds = [pa.int64() if f.endswith("long") else pa.string() for f in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*places, strict=True), kinds, strict=True)], names=names)

    return write


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> WorkbookWriter:
        return (BlockWriter if self.options.get("blocks") == "true" else WorkbookWriter)(self.options, overwrite)


def scan_workbooks(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Cells of all .xlsx files below a path, a sheet a task, with an error column; scenario_id is the file's name without its ending.

    header: a sheet's first row with a cell names the columns (column header), and rows below it count
    from 0. Texts that stand for no value are no cells, and sheets without cells give no
    row; a sheet or file that can't be read gives one row with its error.
    """
    spark.dataSource.register(Workbooks)
    cells = spark.read.format("workbooks").option("header", str(header).lower()).load(path)
    return cells.withColumn("value", na_to_null(F.col("value"))).where("value is not null or error is not null")


def write_workbooks(cells: DataFrame, folder: str, overwrite: bool = False) -> None:
    """One workbook a scenario below folder, which all executors reach; sheets by name, each streamed.

    Existing workbooks of the same scenarios are replaced, all others too if overwrite.
    Blocks of BLOCK_ROWS rows are dealt to tasks, sorted and deflated there; then a task a
    workbook copies their bytes. So neither a scenario nor a sheet is one task's work.
    """
    cells.sparkSession.dataSource.register(Workbooks)
    store, top = store_of(folder)
    staging = f"_staging-{uuid.uuid4().hex}"
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that blocks aren't put together by compressed size and sorted at once
    block = F.floor(F.col("row_idx") / BLOCK_ROWS)
    dealt = cells.select(*[f.split()[0] for f in CELLS.split(", ")]).repartition(n, "scenario_id", "sheet", block).sortWithinPartitions("scenario_id", "sheet", "row_idx", "col_idx")
    places = dealt.mapInArrow(write_blocks(folder, staging), INDEX).repartition(min(n, 4 * cells.sparkSession.sparkContext.defaultParallelism), "scenario_id").sortWithinPartitions("scenario_id", "sheet", "block")
    store.create_dir(f"{top}/{staging}", recursive=True)
    try:
        places.write.format("workbooks").option("blocks", "true").mode("overwrite" if overwrite else "append").save(folder)
    finally:
        store.delete_dir(f"{top}/{staging}")
