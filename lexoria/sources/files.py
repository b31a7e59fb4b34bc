"""Document files as tables: text, PDF (where a library is installed), DOCX, XLSX, url lists, front matter.

Files are read by Spark (binaryFile), so that they may be in any store; formats are parsed in Arrow
batches by the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes read as text; the others have readers of their own.
TEXT_SUFFIXES = (".txt", ".md", ".csv", ".json", ".py", ".js", ".html", ".xml")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(data: bytes) -> str:
    """UTF-8; strict for a file that begins with front matter, else invalid bytes are dropped."""
    strict = data.startswith((b"---", b"\xef\xbb\xbf---"))
    return data.decode("utf-8", "strict" if strict else "ignore")


def read_docx(data: bytes) -> str:
    """Paragraphs that are not empty, joined by a blank line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n\n".join(p for p in paragraphs if p)


def read_pdf(data: bytes) -> str:
    """Page texts that are not empty, joined by a blank line. Needs pypdf."""
    from pypdf import PdfReader

    return "\n\n".join(t for p in PdfReader(io.BytesIO(data)).pages if (t := (p.extract_text() or "").strip()))


READERS = dict.fromkeys(TEXT_SUFFIXES, read_text) | {".docx": read_docx, ".pdf": read_pdf}


def read_documents(spark: SparkSession, folder: str, recursive: bool = False, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, suffix, text, error) of the files with a known suffix; a file that cannot be read has
    an error and no text, and stops nothing else. ``excluded`` names folders that are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    for name in excluded:
        files = files.filter(~F.col("path").contains(f"/{name}/"))
    files = files.withColumn("_low", F.lower("path")).dropDuplicates(["_low"]) if recursive else files
    return parse_files(files)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, suffix, text, error) of files (path, content) with a known suffix, as read_documents."""
    known = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))).filter(F.col("suffix").isin(list(READERS)))

    # Text in valid UTF-8 is what its bytes say, and needs no Python worker to hold the file again.
    plain = F.coalesce(F.col("suffix").isin(*TEXT_SUFFIXES) & F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    marked = known.select("path", "suffix", "content", plain.alias("_plain"))
    read = marked.withColumn("_read", _parsed(F.col("suffix"), F.when(~F.col("_plain"), F.col("content")), F.col("_plain")))
    return read.select("path", "suffix", F.when(F.col("_plain"), F.col("content").cast("string")).otherwise(F.col("_read.text")).alias("text"), F.col("_read.error").alias("error"))


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _parsed(suffix: pa.Array, content: pa.Array, plain: pa.Array) -> pa.Array:
    texts, errors = [], []
    for s, data, done in zip(suffix, content, plain, strict=True):
        text = error = None
        if not done.as_py():
            try:
                text = READERS[s.as_py()](data.as_py())
            except Exception as e:  # a broken file is reported in its row
                error = f"{type(e).__name__}: {e}"[:500]
        texts.append(text)
        errors.append(error)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): distinct urls of all lines that are neither blank nor comments."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"https?://[^\s<>\"']+"), F.lit(0))).alias("url")).distinct()


def sheet_rows(data: bytes, sheet: int = 1) -> list[tuple[int, dict[str, str]]]:
    """(row number, header -> value) of the rows of a sheet that are not empty; the first such row
    is the header."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out, header = [], None
    for row in root.iter(f"{{{ns['m']}}}row"):
        cells = {}
        for c in row.findall("m:c", ns):
            v = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
            text = shared[int(text)] if c.get("t") == "s" and text else text
            if text.strip():
                cells[re.match("[A-Z]+", c.get("r", "A"))[0]] = text.strip()
        if not cells:
            continue
        if header is None:
            header = cells
        else:
            out.append((int(row.get("r", 0)), {header[k]: v for k, v in cells.items() if k in header}))
    return out


def xlsx_rows(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, cells) of a workbook's sheet."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, n, c) for p, data in zip(pdf["path"], pdf["content"], strict=True) for n, c in sheet_rows(data, sheet)]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row int, cells map<string,string>")


def front_matter(text: str) -> tuple[str | None, str, int]:
    """(front matter, body, line at which the body begins). A byte order mark is refused."""
    if text.startswith("﻿"):
        raise ValueError("a byte order mark before the front matter")
    lines = text.split("\n")
    if lines[0].rstrip("\r") != "---":
        return None, text, 1
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip("\r") == "---":
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :]), i + 2
    raise ValueError("the front matter is not closed")
