"""Data sources for ``spark.read.format`` and ``df.write.format``: folders of requirement files, and reports as workbooks.

``requirement_files`` reads the files of a folder page by page, a group of files to a
partition. ``workbook`` writes rows to sheets: each task its own file under a name that
readers don't see, which the commit gives its final one, so that a failed task or job
leaves nothing. Register both by ``register(spark)``.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import package
from .files import SUFFIXES, docx_pages

PAGES = "doc_id string, path string, page int, text string, error string"
#: Bytes of files that a partition reads, and rows of a sheet (a format's fixed value).
GROUP_BYTES, SHEET_ROWS = 64 << 20, 1_048_576
#: Characters that a sheet may not have, and the longest text of a cell.
_CONTROL = {c: None for c in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFE, 0xFFFF]}
CELL_CHARS = 32_767


def _files(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Group(InputPartition):
    paths: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("group_bytes", GROUP_BYTES))
        self.readers = {"docx": docx_pages, "txt": lambda b: b.decode("utf-8", "replace").split("\f")}

    def partitions(self) -> list[Group]:
        """Files by name, in groups of about the bytes of a partition."""
        from pyarrow import fs

        files, base = _files(self.path)
        found = sorted((x.path, x.size or 0) for x in files.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and x.path.rsplit(".", 1)[-1].lower() in SUFFIXES)
        groups, size = [], 0
        for path, n in found:
            if not groups or size + n > self.bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Group(g) for g in groups] or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        files, _ = _files(self.path)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            stem, suffix = name.rsplit(".", 1)[0].strip(), name.rsplit(".", 1)[-1].lower()
            for gap in (", ", ",\t"):
                stem = stem.replace(gap, "_")
            try:
                if suffix not in self.readers:
                    raise ValueError(f"no reader for {suffix}")
                with files.open_input_file(path) as f:
                    pages = self.readers[suffix](f.read())
            except Exception as e:  # noqa: BLE001  whatever is wrong with a file, it is one row
                yield stem, path, None, None, f"{type(e).__name__}: {e}"
                continue
            for i, text in enumerate(pages, start=1):
                yield stem, path, i, text, None


class RequirementFiles(DataSource):
    """Options: path (a folder), group_bytes."""

    @classmethod
    def name(cls) -> str:
        return "requirement_files"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


# --------------------------------------------------------------------------- workbooks

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    # A text stays text, whatever it begins with: a formula would be another element.
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value).translate(_CONTROL)[:CELL_CHARS], quote=False)}</t></is></c>'


def write_workbook(out, columns: list[str], rows: Iterator, sheet: str, most: int = SHEET_ROWS) -> int:
    """Streams rows to the sheets of a workbook; a full sheet goes on in another one. Returns the number of rows."""
    total, names, rows, row = 0, [], iter(rows), None
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        done = False
        while not done:
            names.append(sheet[:31] if not names else f"{sheet[:27]} {len(names) + 1}")
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                put = lambda s: f.write(s.encode())  # noqa: B023, E731
                put(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData><row>{"".join(map(_cell, columns))}</row>')
                n = 1
                if row is not None:
                    put(f"<row>{''.join(map(_cell, row))}</row>")
                    n, total = n + 1, total + 1
                for row in rows:
                    if n == most:
                        break
                    put(f"<row>{''.join(map(_cell, row))}</row>")
                    n, total = n + 1, total + 1
                else:
                    done = True
                put("</sheetData></worksheet>")
        refs = range(1, len(names) + 1)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(refs, names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in refs) + "</Relationships>")
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in refs) + "</Types>")
    return total


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.path, self.sheet, self.columns, self.overwrite = options["path"].rstrip("/"), options.get("sheet", "Sheet"), schema.names, overwrite

    def write(self, rows: Iterator) -> Written:
        files, base = _files(self.path)
        files.create_dir(base, recursive=True)
        own = f"{base}/.{uuid.uuid4().hex}"
        try:
            with files.open_output_stream(own) as f:
                n = write_workbook(f, self.columns, rows, self.sheet)
        except BaseException:
            files.delete_file(own)
            raise
        return Written(own, n)

    def commit(self, messages: list) -> None:
        files, base = _files(self.path)
        from pyarrow import fs

        old = [x.path for x in files.get_file_info(fs.FileSelector(base)) if x.path.endswith(".xlsx")] if self.overwrite else []
        run = uuid.uuid4().hex[:8]
        some = [m for m in messages if m and m.rows] or [m for m in messages if m][:1]  # a report without rows is one sheet with its header
        for i, m in enumerate(some):
            files.move(m.path, f"{base}/part-{i:05d}-{run}.xlsx")
        for path in [*old, *(m.path for m in messages if m and m not in some)]:
            files.delete_file(path)

    def abort(self, messages: list) -> None:
        files, _ = _files(self.path)
        for m in messages:
            if m:
                files.delete_file(m.path)


class Workbook(DataSource):
    """Options: path (a folder), sheet (the name of the sheets)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    package.send(spark)
    spark.dataSource.register(RequirementFiles)
    spark.dataSource.register(Workbook)
