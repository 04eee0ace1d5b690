"""Spreadsheets (.xlsx) as a Spark data source, by the standard library's zip and XML readers.

``spark.read.format("xlsx")`` after :func:`register`, or :func:`read` and :func:`write`. A sheet is one partition and is
streamed; a workbook holds at most 1,048,576 rows, so that a partition is bounded by the format. Columns of several files
meet by name; without a schema all are strings, as in the CSV sources. Writing has two phases: tasks write files to a
staging folder below the target, and only when all have succeeded are they moved to their names, so that a failed task or
job leaves no file. A file whose rows take more than ``promote_bytes``, or that holds what a sheet can't, becomes Parquet.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PROMOTE_BYTES = 10 * 1024 * 1024
# Limits of the format, its first day, its built-in date formats, and its names.
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
EPOCH, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
FIRST_DAY = datetime.datetime(1900, 3, 1)  # before it the format counts a day that never was
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HIDDEN = re.compile(r"_x[0-9A-Fa-f]{4}_|[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\r]")
_SHOWN = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _shown(text: str) -> str:
    """Characters that XML can't hold are written by their code."""
    return _SHOWN.sub(lambda m: chr(int(m[1], 16)), text)


def _hidden(text: str) -> str:
    return _HIDDEN.sub(lambda m: f"_x005F{m[0]}" if len(m[0]) > 1 else f"_x{ord(m[0]):04X}_", text)


# ---- reading --------------------------------------------------------------------------------------------------------


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """Plain or rich text of a cell or shared string; phonetic hints don't count."""
    return _shown("".join(t.text or "" for t in node.iterfind(f"{MAIN}t")) + "".join(t.text or "" for r in node.iterfind(f"{MAIN}r") for t in r.iterfind(f"{MAIN}t")))


class Workbook:
    """A workbook that is being read."""

    def __init__(self, file: object):
        self.zip = zipfile.ZipFile(file)
        top = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(links[s.get(f"{{{RELATIONS}}}id")]) for s in top.iter(f"{MAIN}sheet")}
        about = top.find(f"{MAIN}workbookPr")
        self.epoch = EPOCH_1904 if about is not None and about.get("date1904") in ("1", "true") else EPOCH
        self.shared = self._shared() if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._dates() if "xl/styles.xml" in self.zip.namelist() else []

    def _shared(self) -> list[str]:
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{MAIN}si":
                    out.append(_text(node))
                    node.clear()
        return out

    def _dates(self) -> list[bool]:
        """Whether each cell style shows a date."""
        top = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]hms]*\]', "", f.get("formatCode", "").lower()))) for f in top.iter(f"{MAIN}numFmt")}
        styles = top.find(f"{MAIN}cellXfs")
        return [own.get(n := int(x.get("numFmtId", 0)), n in DATE_FORMATS) for x in (styles if styles is not None else [])]

    def value(self, cell: ElementTree.Element) -> object:
        kind, found = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            inner = cell.find(f"{MAIN}is")
            return _text(inner) if inner is not None else ""
        if found is None or found.text is None:
            return "" if kind == "str" else None
        raw = found.text
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "str":
            return _shown(raw)
        if kind == "b":
            return raw.strip() in ("1", "true")
        if kind == "e":
            return None
        if kind == "d":
            return datetime.datetime.fromisoformat(raw).replace(tzinfo=None)
        number = float(raw) if re.search(r"[.eEn]", raw) else int(raw)
        style = int(cell.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return self.epoch + datetime.timedelta(microseconds=round(number * 86_400_000_000))
        return number

    def rows(self, sheet: str) -> Iterator[list[object]]:
        """Values of each row, streamed; rows that the file leaves out are empty."""
        at = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{MAIN}row":
                    number = int(node.get("r", at + 1))
                    while at + 1 < number:
                        at += 1
                        yield []
                    at = number
                    out: list[object] = []
                    for cell in node.iterfind(f"{MAIN}c"):
                        i = _column(cell.get("r")) if cell.get("r") else len(out)
                        out += [None] * (i + 1 - len(out))
                        out[i] = self.value(cell)
                    yield out
                    node.clear()


def _names(header: list[object]) -> list[str]:
    """Column names of a header row: blank ones by their place, repeated ones with a number."""
    out: list[str] = []
    for i, cell in enumerate(header):
        name = base = plain(cell) or f"_c{i}"
        k = 1
        while name in out:
            name, k = f"{base}.{k}", k + 1
        out.append(name)
    return out


def plain(value: object) -> str | None:
    """A value as text: whole numbers without a point, booleans in lower case, dates as ISO."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


def cast(value: object, kind: T.DataType) -> object:
    """A cell as a value of a Spark type; what it can't be is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return plain(value)
        if value == "":
            return None
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}.get(plain(value).lower())
        if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            day = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(value)
            return day.date() if isinstance(kind, T.DateType) else day.replace(tzinfo=datetime.timezone.utc) if isinstance(kind, T.TimestampType) else day.replace(tzinfo=None)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-kind.scale))
        if isinstance(kind, T.IntegralType):
            number = float(value) if isinstance(value, str) and not re.fullmatch(r"-?\d+", value) else value
            return int(number) if int(number) == float(number) or isinstance(number, int) else None
        return float(value)
    except (ValueError, TypeError, ArithmeticError):
        return None


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str


def _open(path: str) -> object:
    files, at = fs.FileSystem.from_uri(path)
    return files.open_input_file(at)


def _paths(options: dict) -> list[str]:
    """Files of the options ``paths`` (a JSON list) or ``path`` (a file, or a folder whose .xlsx files count)."""
    if "paths" in options:
        return json.loads(options["paths"])
    files, at = fs.FileSystem.from_uri(options["path"])
    if files.get_file_info(at).type != fs.FileType.Directory:
        return [options["path"]]
    inside = [i.path for i in files.get_file_info(fs.FileSelector(at, recursive=True)) if i.extension == "xlsx" and not re.search(r"/[._][^/]*(/|$)", i.path[len(at) :])]
    return sorted(options["path"].rstrip("/") + p[len(at.rstrip("/")) :] for p in inside)


class XlsxReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> Sequence[InputPartition]:
        wanted, out = self.options.get("sheet"), []
        for path in _paths(self.options):
            with _open(path) as f:
                sheets = list(Workbook(f).sheets)
            out += [Sheet(path, s) for s in (sheets if wanted == "*" else [s for s in sheets if s == wanted] if wanted else sheets[:1])]
        return out

    def read(self, partition: Sheet) -> Iterator[tuple]:
        extra = {self.options.get("filecolumn", "_path"): partition.path, self.options.get("sheetcolumn", "_sheet"): partition.sheet}
        with _open(partition.path) as f:
            book = Workbook(f)
            rows = book.rows(partition.sheet)
            place = {name: i for i, name in enumerate(_names(next(rows, [])))}
            fields = [(place.get(x.name), extra.get(x.name), x.dataType) for x in self.schema.fields]
            for row in rows:
                yield tuple(cast(row[i] if i < len(row) else None, kind) if i is not None else own for i, own, kind in fields)


# ---- writing --------------------------------------------------------------------------------------------------------


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value: object) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, decimal.Decimal)) or (isinstance(value, float) and abs(value) != float("inf")):
        return f'<c r="{ref}"><v>{value!r}</v></c>' if not isinstance(value, decimal.Decimal) else f'<c r="{ref}"><v>{value}</v></c>'
    if isinstance(value, datetime.date):
        day = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
        if day >= FIRST_DAY:
            return f'<c r="{ref}" s="{1 if value is day else 2}"><v>{(day - EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
        value = value.isoformat(" ") if value is day else value.isoformat()
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_hidden(str(value)))}</t></is></c>'


def workbook_bytes(names: Sequence[str], rows: Iterator[Sequence[object]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with a header row; nulls and NaN are cells that aren't there."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    letters = [_letters(i) for i in range(len(names))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATIONS}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>')
        styles = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for n in (0, 22, 14))
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{styles}</cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            for n, row in enumerate([list(names)], 1):
                f.write(f'<row r="{n}">{"".join(_cell(f"{c}{n}", v) for c, v in zip(letters, row, strict=True))}</row>'.encode())
            for n, row in enumerate(rows, 2):
                f.write(f'<row r="{n}">{"".join(_cell(f"{c}{n}", v) for c, v in zip(letters, row, strict=True))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (where it is, where it goes), both below the target


class _File:
    """One file's rows: held until they are too many for a sheet, then handed to a Parquet writer as they come."""

    def __init__(self, writer: XlsxWriter, name: str):
        self.writer, self.name, self.held, self.bytes, self.rows, self.parquet = writer, name, [], 0, 0, None
        self.staged = f"{writer.staging}/{uuid.uuid4().hex}"

    def add(self, batch: pa.RecordBatch) -> None:
        longest = max([0, *[pa.compute.max(pa.compute.utf8_length(c)).as_py() or 0 for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]])
        self.bytes, self.rows = self.bytes + batch.nbytes, self.rows + batch.num_rows
        if self.parquet is None and (self.bytes > self.writer.promote or self.rows >= MOST_ROWS or longest > MOST_CHARS):
            files, at = fs.FileSystem.from_uri(f"{self.writer.path}/{self.staged}")
            self.parquet = pq.ParquetWriter(at, batch.schema, filesystem=files)
            for b in self.held:
                self.parquet.write_batch(b)
            self.held = []
        if self.parquet is not None:
            self.parquet.write_batch(batch)
        else:
            self.held.append(batch)

    def close(self) -> tuple[str, str]:
        if self.parquet is not None:
            self.parquet.close()
            return self.staged, f"{self.name}.parquet"
        names = self.writer.columns
        rows = (row for b in self.held for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        files, at = fs.FileSystem.from_uri(f"{self.writer.path}/{self.staged}")
        with files.open_output_stream(at, compression=None) as f:
            f.write(workbook_bytes(names, rows))
        return self.staged, f"{self.name}.xlsx"


class XlsxWriter(DataSourceArrowWriter):
    """Writes the rows of each value of the column ``filecolumn`` to the file that it names, or each task's rows to one."""

    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.by = options["path"].rstrip("/"), options.get("filecolumn")
        self.columns = [f.name for f in schema.fields if f.name != self.by]
        self.promote = int(options.get("promotebytes", PROMOTE_BYTES))
        self.staging = f"_staging-{uuid.uuid4().hex}"
        files, at = fs.FileSystem.from_uri(f"{self.path}/{self.staging}")
        files.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        now, done = None, []
        for batch in iterator:
            names = batch.column(batch.schema.get_field_index(self.by)).to_pylist() if self.by else [f"part-{TaskContext.get().partitionId():05d}"] * batch.num_rows
            body = batch.select(self.columns)
            low = 0
            for high in range(1, batch.num_rows + 1):
                if high < batch.num_rows and names[high] == names[low]:
                    continue
                if now is None or now.name != names[low]:
                    if now is not None:
                        done.append(now.close())
                    now = _File(self, names[low])
                now.add(body.slice(low, high - low))
                low = high
        if now is not None:
            done.append(now.close())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for at, to in [pair for m in messages if m is not None for pair in m.files]:
            files.create_dir(f"{root}/{to}".rpartition("/")[0], recursive=True)
            other = f"{root}/{to}".rpartition(".")[0] + (".xlsx" if to.endswith(".parquet") else ".parquet")
            if files.get_file_info(other).type == fs.FileType.File:  # the same rows, written before in the other format
                files.delete_file(other)
            files.move(f"{root}/{at}", f"{root}/{to}")
        files.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        """Strings under all names that the headers have, in their order."""
        wanted, names = self.options.get("sheet"), {}
        for path in _paths(self.options):
            with _open(path) as f:
                book = Workbook(f)
                for s in list(book.sheets) if wanted == "*" else [s for s in book.sheets if s == wanted] if wanted else list(book.sheets)[:1]:
                    names |= dict.fromkeys(_names(next(book.rows(s), [])))
        extra = [self.options[c] for c in ("filecolumn", "sheetcolumn") if c in self.options]
        return T.StructType([T.StructField(n, T.StringType()) for n in [*names, *extra]])

    def reader(self, schema: T.StructType) -> XlsxReader:
        return XlsxReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(XlsxSource)


def read(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, sheet: str | None = None, file_column: str | None = None, sheet_column: str | None = None) -> DataFrame:
    """Rows of workbooks, by name: their first sheets, the named one, or all (``*``); with the file and sheet as columns if asked."""
    register(spark)
    options = {"sheet": sheet, "filecolumn": file_column, "sheetcolumn": sheet_column} | ({"path": paths[0]} if len(paths) == 1 else {"paths": json.dumps(paths)})
    reader = spark.read.format("xlsx").options(**{k: v for k, v in options.items() if v is not None})
    return (reader.schema(schema) if schema is not None else reader).load()


def write(df: DataFrame, path: str, file: str | None = None, order: Sequence[str] = (), promote_bytes: int = PROMOTE_BYTES) -> None:
    """Workbooks below ``path``: one for each value of the column ``file``, which is its path there without suffix, or one a task.

    Rows of a file are in ``order``. Times are written as the session's time zone shows them, nested columns as JSON. A
    file that is there already is replaced. No rows: no files.
    """
    register(df.sparkSession)
    kinds = dict(df.dtypes)
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in kinds.items() if t == "timestamp"} | {c: F.to_json(c) for c, t in kinds.items() if t.startswith(("array", "struct", "map"))})
    if file:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), file).sortWithinPartitions(file, *order)
    options = {"path": path, "promotebytes": str(promote_bytes)} | ({"filecolumn": file} if file else {})
    df.write.format("xlsx").options(**options).mode("append").save()
