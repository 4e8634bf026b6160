"""A-04: workbook (.xlsx) source and a writer for staging.

Reading: ``binaryFile`` lists the workbooks; ``mapInPandas`` parses each one
(one workbook per row, so workbooks are parsed in parallel across tasks)
with the standard library (zip + XML, row by row) and emits one row per sheet
row: path, sheet, row number, header names and cell texts, dates as ISO
text.  ``sheet_table`` then selects named columns from those arrays - a
map-only plan, no pivot shuffle.  A single workbook is indivisible (one task),
so reading takes a size limit.

Writing (used to stage test inputs): rows grouped by a workbook key are
written by ``applyInPandas`` as minimal .xlsx files with inline strings,
through ``pyarrow.fs`` to the filesystem that the session's configuration
gives for the target.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import safe_name, stem

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}

LONG_SCHEMA = ("path string, sheet string, sheet_no int, row long, header array<string>, "
               "cells array<string>")
ROWS_PER_CHUNK = 10_000


# ---- parsing ---------------------------------------------------------------

# ---- fixed values: built-in number formats that show dates or times, and the
# first day of the two date systems (serial 0)
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH_1900, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
# ---------------------------------------------------------------------------


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{NS['m']}}}t"))


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or time: day, month, year, hour or
    second letters outside quotes, brackets (but elapsed time) and escapes."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code, flags=re.I)
    return bool(re.search("[dmyhs]", bare, flags=re.I)) and "general" not in bare.lower()


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", NS)}
    formats = [int(x.get("numFmtId", 0)) for x in root.findall("m:cellXfs/m:xf", NS)]
    return {i for i, f in enumerate(formats) if f in DATE_FORMATS or is_date_format(custom.get(f, ""))}


def serial_date(text: str, epoch: dt.datetime) -> str:
    """A date serial as ISO text (milliseconds rounded away, as spreadsheets show it)."""
    try:
        serial = float(text)
        if epoch is EPOCH_1900 and 0 <= serial < 60:
            serial += 1  # that system counts a 29 February 1900
        value = epoch + dt.timedelta(seconds=round(serial * 86400))
    except (ValueError, OverflowError):
        return text
    return value.strftime("%Y-%m-%d %H:%M:%S")


def _cell(c, shared: list[str], dates: set[int], epoch: dt.datetime) -> str | None:
    kind, v = c.get("t"), c.find("m:v", NS)
    if kind == "inlineStr":
        return _text(c.find("m:is", NS))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind in (None, "n") and int(c.get("s", 0)) in dates:
        return serial_date(v.text, epoch)
    return v.text


def parse_workbook(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Yield (sheet name, row number, cell texts) for every row of every sheet.

    Sheets are parsed row by row and each row is let go; rows and cells without
    a reference follow the one before."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in root.findall("m:si", NS)]
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", NS)}
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    properties = wb.find("m:workbookPr", NS)
    late = properties is not None and properties.get("date1904") in ("1", "true")
    epoch, dates = EPOCH_1904 if late else EPOCH_1900, date_styles(z)
    for sheet in wb.find("m:sheets", NS).findall("m:sheet", NS):
        target = targets[sheet.get(f"{{{NS['r']}}}id")].lstrip("/")
        number = 0
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as part:
            for _, row in ET.iterparse(part):
                if row.tag != f"{{{NS['m']}}}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: dict[int, str | None] = {}
                at = -1
                for c in row.findall("m:c", NS):
                    at = _col_index(c.get("r")) if c.get("r") else at + 1
                    cells[at] = _cell(c, shared, dates, epoch)
                width = max(cells) + 1 if cells else 0
                yield sheet.get("name"), number, [cells.get(i) for i in range(width)]
                row.clear()


def read_workbooks(spark: SparkSession, root: str | list[str], limit_mb: float | None = None) -> DataFrame:
    """Long rows (path, sheet, sheet_no, row, header, cells) of every .xlsx
    under ``root`` (or of the given workbook paths); row 1 of each sheet is
    its header, ``sheet_no`` the sheet's position in its workbook.  A workbook
    over ``limit_mb`` raises before any is read."""
    reader = spark.read.format("binaryFile")
    if isinstance(root, str):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx")
    files = reader.load(root)
    if limit_mb is not None:
        large = files.select("path", "length").where(F.col("length") > int(limit_mb * 1048576)).head()
        if large:
            raise ValueError(f"{large.path} has {large.length} bytes; the limit is {limit_mb} MB")
    return parse_workbooks(files)


def parse_workbooks(files: DataFrame, header_rows: bool = False) -> DataFrame:
    """Long rows of the workbooks in a ``binaryFile`` frame (path, content).

    With ``header_rows`` each sheet's header is a row of its own, without cells,
    and the other rows don't repeat it; so a sheet with a header only is seen."""
    columns = ["path", "sheet", "sheet_no", "row", "header", "cells"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows leave in chunks of ROWS_PER_CHUNK, so Python memory holds one
        # workbook's bytes and one chunk, not a whole batch of workbooks
        out = []
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                header: dict[str, list[str]] = {}
                order: dict[str, int] = {}
                for sheet, r, cells in parse_workbook(bytes(content)):
                    order.setdefault(sheet, len(order))
                    if r == 1:
                        header[sheet] = [c if c is not None else "" for c in cells]
                        if header_rows:
                            out.append((path, sheet, order[sheet], r, header.pop(sheet), None))
                        continue
                    out.append((path, sheet, order[sheet], r,
                                None if header_rows else header.get(sheet, []), cells))
                    if len(out) >= ROWS_PER_CHUNK:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return files.select("path", "content").mapInPandas(parse, LONG_SCHEMA)


def cell(name: str) -> Column:
    """The text of the named column in a long workbook row (null if absent)."""
    idx = F.array_position(F.col("header"), F.lit(name))
    # a row's cells stop at its last present cell: later positions are null
    return F.when(idx > 0, F.try_element_at(F.col("cells"), idx.cast("int")))


def sheet_table(long_rows: DataFrame, schema) -> DataFrame:
    """Typed rows of the given schema (names from the header row), plus the
    source path, sheet and the safe table name ``<file stem>_<sheet>``."""
    cols = [cell(f.name).try_cast(f.dataType) if f.dataType.simpleString() != "string"
            else cell(f.name) for f in schema.fields]
    cols = [c.alias(f.name) for c, f in zip(cols, schema.fields)]
    table = safe_name(F.concat(safe_name(stem(F.col("path"))), F.lit("_"), F.col("sheet")))
    return long_rows.select(F.col("path"), F.col("sheet"), table.alias("table_name"), *cols)


# ---- writing (staging) -----------------------------------------------------

def _letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _sheet_xml(columns: list[str], rows: list[tuple], late: bool, references: bool) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>',
           f'<worksheet xmlns="{NS["m"]}"><sheetData>']
    for r, values in enumerate([tuple(columns)] + rows, start=1):
        cells = []
        for c, v in enumerate(values):
            at = f' r="{_letters(c)}{r}"' if references else ""
            if v is None:
                if not references:
                    cells.append("<c/>")
                continue
            if isinstance(v, dt.datetime):
                serial = (v - (EPOCH_1904 if late else EPOCH_1900)).total_seconds() / 86400
                cells.append(f'<c{at} s="1"><v>{serial!r}</v></c>')
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c{at}><v>{repr(v) if isinstance(v, float) else v}</v></c>')
            else:
                cells.append(f'<c{at} t="inlineStr"><is><t xml:space="preserve">'
                             f'{escape(str(v))}</t></is></c>')
        out.append((f'<row r="{r}">' if references else "<row>") + "".join(cells) + "</row>")
    out.append("</sheetData></worksheet>")
    return "".join(out)


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]], late: bool = False,
                   references: bool = True) -> bytes:
    """A minimal .xlsx holding the given sheets (name -> (columns, rows)), in the
    1904 date system if ``late``, with or without row and cell references."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        overrides = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/'
            f'vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/'
                   'package/2006/content-types"><Default Extension="rels" ContentType="application/'
                   'vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" '
                   'ContentType="application/xml"/><Override PartName="/xl/workbook.xml" '
                   'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.'
                   f'main+xml"/>{overrides}</Types>')
        z.writestr("_rels/.rels",
                   f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{NS["pr"]}">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/'
                   '2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheet_tags = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>'
                             for i, n in enumerate(sheets, start=1))
        z.writestr("xl/workbook.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS["m"]}" '
                   f'xmlns:r="{NS["r"]}">{"<workbookPr date1904=" + chr(34) + "1" + chr(34) + "/>" if late else ""}'
                   f'<sheets>{sheet_tags}</sheets></workbook>')
        z.writestr("xl/styles.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{NS["m"]}">'
                   '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/'
                       f'officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>'
                       for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{NS["pr"]}">'
                   f'{rels}</Relationships>')
        for i, (cols, rows) in enumerate(sheets.values(), start=1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(cols, rows, late, references))
    return buf.getvalue()


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with the scheme that the session's configuration gives it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def _write_bytes(uri: str, data: bytes) -> None:
    from pyarrow import fs as pafs

    filesystem, inner = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(inner) as out:
        out.write(data)


def write_workbooks(df: DataFrame, file_col: str, sheet_col: str, root: str,
                    columns: list[str], late: str | None = None,
                    header_only: str | None = None) -> DataFrame:
    """Write one workbook per value of ``file_col`` (one sheet per value of
    ``sheet_col``) under ``root``; returns (file, rows) per workbook.  Each
    workbook is built by one task, so callers keep workbook keys small.
    Workbooks whose name contains ``late`` use the 1904 date system and leave
    out cell references; each gets a last sheet ``header_only`` without rows, if
    that is given."""
    target = _qualified(df.sparkSession, root.rstrip("/"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf[file_col].iloc[0])
        sheets = {}
        for sheet, part in pdf.groupby(sheet_col, sort=True):
            rows = [tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp)
                          else (v.item() if hasattr(v, "item") else v) for v in rec)
                    for rec in part[columns].itertuples(index=False)]
            sheets[str(sheet)] = (columns, rows)
        if header_only is not None:
            sheets[header_only] = (columns, [])
        odd = late is not None and late in name
        _write_bytes(f"{target}/{name}.xlsx", workbook_bytes(sheets, odd, not odd))
        return pd.DataFrame({"file": [name], "rows": [len(pdf)]})

    return df.groupBy(file_col).applyInPandas(build, "file string, rows long")
