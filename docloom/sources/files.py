"""Document files as rows of text units."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import rules
from docloom.config import Settings
from docloom.functions.markup import html_text, markdown_text

UNIT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("paragraph_number", T.IntegerType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

# fixed values: file suffixes and the format each one is read as
FORMATS = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "txt", "md": "markdown", "csv": "csv",
    "xlsx": "excel", "xls": "excel", "html": "html", "json": "json",
}

# bytes of a PDF -> text of each page; set by the user, since no PDF library is required
PageReader = Callable[[bytes], list[str]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def _pretty(document: str) -> str | None:
    try:
        return json.dumps(json.loads(document), indent=2)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def pretty_json(documents: pd.Series) -> pd.Series:
    """Indented JSON; null for text that is no JSON."""
    return documents.map(_pretty, na_action="ignore")


def _table_text(head: str, frame: pd.DataFrame) -> str:
    columns = ", ".join(map(str, frame.columns))
    return f"{head}\nColumns: {columns}\nRows: {len(frame)}\n\n{frame.to_string(index=False)}"


def _csv(content: bytes, name: str) -> Iterator[dict]:
    frame = pd.read_csv(io.BytesIO(content))
    yield {
        "text": _table_text("CSV Data Summary:", frame), "chunk_id": f"{name}_csv", "rows": len(frame),
        "columns": [str(c) for c in frame.columns],
    }


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(content: bytes, name: str) -> Iterator[dict]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    for number, paragraph in enumerate(body.findall(f"{_W}p"), 1):
        signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        text = "".join((e.text or "") if e.tag == f"{_W}t" else signs.get(e.tag, "") for e in paragraph.iter())
        if text.strip():
            yield {"text": text, "chunk_id": f"{name}_para_{number}", "paragraph_number": number}


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_index(ref: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", ref).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _cell(cell, shared: list[str]):
    kind, value = cell.get("t"), cell.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in cell.iter(f"{_S}t"))
    if value is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind in ("str", "e"):
        return value.text
    number = float(value.text)
    return int(number) if number.is_integer() else number


def _sheets(content: bytes) -> Iterator[tuple[str, pd.DataFrame]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        items = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_S}si")
        shared = ["".join(x.text or "" for x in item.iter(f"{_S}t")) for item in items]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = links[sheet.get(f"{_R}id")].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        rows = []
        for row in ElementTree.fromstring(book.read(part)).iter(f"{_S}row"):
            cells = {_column_index(c.get("r")): _cell(c, shared) for c in row.findall(f"{_S}c")}
            rows.append(cells)
        width = max((max(r) + 1 for r in rows if r), default=0)
        table = [[r.get(i) for i in range(width)] for r in rows]
        header = [f"Unnamed: {i}" if h is None else h for i, h in enumerate(table[0])] if table else []
        yield sheet.get("name"), pd.DataFrame(table[1:], columns=header).infer_objects()


def _excel(content: bytes, name: str) -> Iterator[dict]:
    if content[:2] != b"PK":
        raise ValueError("the old binary Excel format is not supported")
    for sheet, frame in _sheets(content):
        yield {
            "text": _table_text(f"Sheet: {sheet}", frame), "chunk_id": f"{name}_{sheet}", "sheet_name": sheet,
            "rows": len(frame), "columns": [str(c) for c in frame.columns],
        }


def _pdf(reader: PageReader | None):
    def read(content: bytes, name: str) -> Iterator[dict]:
        if reader is None:
            raise ValueError("pass a pdf_reader to read PDF files")
        for number, text in enumerate(reader(content), 1):
            if text.strip():
                yield {"text": text, "chunk_id": f"{name}_page_{number}", "page_number": number}

    return read


def _parse(readers: dict):
    """Binary formats, one file at a time; a broken file becomes an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name, kind, content in zip(batch["path"], batch["stem"], batch["format"], batch["content"]):
                base = {"source": path, "format": kind}
                try:
                    rows += [{**base, **unit} for unit in readers[kind](content, name)]
                except Exception as error:
                    rows.append({**base, "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=UNIT.names).astype(object).where(lambda d: d.notna(), None)

    return run


def _units(df: DataFrame, kind: str, text: Column, ending: str, raw: Column | None = None) -> DataFrame:
    given = {
        "text": text, "source": F.col("path"), "format": F.lit(kind), "raw": raw,
        "chunk_id": F.concat(F.col("stem"), F.lit(ending)),
    }
    return df.where(F.col("format") == kind).select(
        *[
            (given[f.name] if given.get(f.name) is not None else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in UNIT.fields
        ]
    )


def _errors(files: DataFrame, error: Column) -> DataFrame:
    """One error row per file."""
    given = {"source": F.col("path"), "format": F.col("format"), "error": error}
    return files.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in UNIT.fields])


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files with path, length, suffix and format; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _described(files).drop("content")


def _described(files: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return files.withColumn("suffix", suffix(F.col("path"))).withColumn("stem", stem(F.col("path"))).withColumn(
        "format", F.element_at(kinds, F.col("suffix"))
    )


def parse_files(files: DataFrame, pdf_reader: PageReader | None = None) -> DataFrame:
    """Text units of files given as ``path, content`` rows (batch or streaming).

    Text formats are decoded by column expressions; binary formats go through one
    parser per file. A file of an unknown format gives an error row.
    """
    files = _described(files)
    content = F.col("content").cast("string")
    texts = files.where(F.is_valid_utf8(content))
    plain = _units(texts, "txt", content, "_full")
    marked = _units(texts, "markdown", markdown_text(content), "_md", content)
    pages = _units(texts, "html", html_text(content), "_html")
    objects = _units(texts, "json", F.concat(F.lit("JSON Data:\n"), pretty_json(content)), "_json", content)
    objects = objects.withColumn("error", F.when(F.col("text").isNull(), F.lit("Invalid JSON")))
    undecoded = _errors(
        files.where(F.col("format").isin("txt", "markdown", "html", "json") & ~F.is_valid_utf8(content)), F.lit("Not valid UTF-8 text")
    )
    readers = {"csv": _csv, "docx": _docx, "excel": _excel, "pdf": _pdf(pdf_reader)}
    binary = (
        files.where(F.col("format").isin(list(readers)))
        .select("path", "stem", "format", "content")
        .mapInPandas(_parse(readers), UNIT)
    )
    unknown = _errors(files.where(F.col("format").isNull()), F.format_string(rules.UNSUPPORTED_FORMAT.replace("{}", "%s"), F.col("suffix")))
    out = plain
    for part in (marked, pages, objects, undecoded, binary, unknown):
        out = out.unionByName(part)
    return out


def read_documents(
    spark: SparkSession, path: str | list[str], pdf_reader: PageReader | None = None, strict: bool = False,
    max_bytes: int = Settings.max_upload_bytes,
) -> DataFrame:
    """Units of all files under ``path``.

    Files over ``max_bytes`` are never loaded: the length filter is applied by the file
    source, and their error rows come from the listing. ``strict`` raises for a suffix
    that is not supported instead of giving an error row.
    """
    if strict:
        bad = listing(spark, path).where(F.col("format").isNull()).select("suffix").first()
        if bad:
            raise ValueError(rules.UNSUPPORTED_FORMAT.format(bad["suffix"]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    units = parse_files(files.where(F.col("length") <= max_bytes).select("path", "content"), pdf_reader)
    large = listing(spark, path).where(F.col("length") > max_bytes)
    return units.unionByName(_errors(large, F.lit(rules.SIZE_EXCEEDED.format(max_bytes // (1024 * 1024)))))


def check_uploads(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Upload checks of a listing: ``filename, success, error`` per file."""
    kind = suffix(F.col("path"))
    error = F.when(
        ~kind.isin(list(settings.upload_types)), F.format_string(rules.TYPE_NOT_SUPPORTED.replace("{}", "%s"), kind)
    ).when(
        F.col("length") > settings.max_upload_bytes,
        F.lit(rules.SIZE_EXCEEDED.format(settings.max_upload_bytes // (1024 * 1024))),
    )
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), error.isNull().alias("success"), error.alias("error")
    )
