"""Markdown and HTML: sections, structure, text, chunks. Parsers run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions.batches import by_parts

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_HEAD = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_KEY = re.compile(r"\s*\{#([A-Za-z0-9][A-Za-z0-9_.-]*)\}$")


@dataclass
class Section:
    level: int  # 0 for what stands before the first heading
    title: str
    key: str | None
    path: str
    line: int
    text: str


def split_sections(text: str) -> list[Section]:
    """The preamble and one section a heading, blank ones dropped. Headings inside fences do not
    count; an open fence runs to the end. path joins the titles of the open outer headings."""
    out: list[Section] = []
    open_titles: dict[int, str] = {}
    head, body, fence = (0, "", None, "", 1), [], ""

    def close():
        content = "\n".join(body).strip()
        if content:
            out.append(Section(*head, content))

    for number, line in enumerate(text.splitlines(), 1):
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m := _FENCE.match(line):
            fence = m[1]
        elif m := _HEAD.match(line):
            close()
            title, level = (m[2] or "").strip(), len(m[1])
            key = _KEY.search(title)
            title = title[: key.start()] if key else title
            open_titles = {k: v for k, v in open_titles.items() if k < level} | {level: title}
            head, body = (level, title, key[1] if key else None, " > ".join(open_titles[k] for k in sorted(open_titles)), number), []
        body.append(line)
    close()
    return out


def fence_left_open(text: str) -> int | None:
    """The line of the fence that nothing closes."""
    fence, at = "", None
    for number, line in enumerate(text.splitlines(), 1):
        m = _FENCE.match(line)
        if m and not fence:
            fence, at = m[1], number
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence, at = "", None
    return at


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, section_index, level, title, section_key, heading_path, line, content)."""

    @by_parts(text)
    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(n, i, s.level, s.title, s.key, s.path, s.line, s.text) for n, t in enumerate(part.column(text).to_pylist()) for i, s in enumerate(split_sections(t or ""))]
        yield _rows(part, rows, [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()], ["section_index", "level", "title", "section_key", "heading_path", "line", "content"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, section_index int, level int, title string, section_key string, heading_path string, line int, content string")


def _rows(part: pa.RecordBatch, rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """Rows (place in the part, *values) with the doc_id of their place."""
    places, *columns = zip(*rows, strict=True) if rows else [()] * (len(kinds) + 1)
    ids = part.column("doc_id").cast(pa.int64()).take(pa.array(places, pa.int32()))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])


def split_text(text: str, size: int = 1_200, overlap: int = 300) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the best of: paragraph, line, sentence, space,
    anywhere; each next piece begins up to ``overlap`` characters before, at a word."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", ". ", " "):
                at = text.rfind(mark, start + max(1, size // 2, overlap + 1), end)
                if at > start:
                    end = at + len(mark)
                    break
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        back = max(start + 1, end - overlap)
        space = text.find(" ", back, end)
        start = space + 1 if space >= 0 else back if overlap else end
    return out


def chunks(docs: DataFrame, text: str = "text", size: int = 1_200, overlap: int = 300) -> DataFrame:
    """(doc_id, chunk_index, content, token_count, n_chunks): n_chunks counts the text's chunks."""

    @by_parts(text)
    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        split = [split_text((t or "").replace("\x00", ""), size, overlap) for t in part.column(text).to_pylist()]
        rows = [(n, i, c, len(c.split()), len(pieces)) for n, pieces in enumerate(split) for i, c in enumerate(pieces)]
        yield _rows(part, rows, [pa.int32(), pa.string(), pa.int32(), pa.int64()], ["chunk_index", "content", "token_count", "n_chunks"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, chunk_index int, content string, token_count int, n_chunks long")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.og, self.h1, self.title, self.inside, self.skip = [[]], "", "", "", [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        if tag == "meta" and a.get("property") == "og:title" and not self.og:
            self.og = (a.get("content") or "").strip()
        if tag in ("title", "h1"):
            self.inside.append(tag)
        if tag in ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "nav", "header", "footer", "body", "head"):
            self.lines.append([])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.skip:
            self.skip -= 1
        if tag in self.inside:
            self.inside.remove(tag)
        if tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "nav", "title"):
            self.lines.append([])

    def handle_data(self, data):
        if self.skip:
            return
        if "title" in self.inside:
            self.title += data
        else:
            if "h1" in self.inside and len(self.h1) < 500:
                self.h1 += data
            self.lines[-1].append(data)


def html_text(html: str) -> tuple[str, str]:
    """(title, text): og:title before h1 before title; scripts and styles dropped, white space
    collapsed in each line, empty lines dropped."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = [" ".join("".join(x).split()) for x in p.lines]
    return p.og or " ".join(p.h1.split()) or " ".join(p.title.split()), "\n".join(x for x in lines if x)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, title, text) of HTML pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [html_text(h or "") for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [g[0] for g in got], "text": [g[1] for g in got]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string")


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n", -1)


def table_rows(text: Column) -> Column:
    return F.filter(F.transform(lines(text), F.trim), lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1))


def list_items(text: Column) -> Column:
    item = r"^\s*(?:[-*+]|\d+[.)])\s+(.*\S)\s*$"
    return F.transform(F.filter(lines(text), lambda x: x.rlike(item)), lambda x: F.regexp_extract(x, item, 1))


def code_blocks(text: str) -> list[str]:
    """Contents of fenced blocks; an unclosed one is kept."""
    out, fence, body = [], "", []
    for line in text.splitlines():
        m = _FENCE.match(line)
        if fence and m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            out.append("\n".join(body))
            fence, body = "", []
        elif fence:
            body.append(line)
        elif m:
            fence = m[1]
    return [*out, "\n".join(body)] if fence else out


def level_jumps(section_rows: DataFrame) -> DataFrame:
    """(doc_id, jumps): headings more than one level below the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("section_index")
    j = section_rows.filter("level > 0").withColumn("p", F.lag("level").over(w))
    return j.groupBy("doc_id").agg(F.count_if(F.col("level") > F.col("p") + 1).alias("jumps"))


def entities(text: Column) -> Column:
    """struct of upper-case identifiers, endpoints, status codes and lines that speak of errors;
    distinct in order, with the limits 30, 30, 20 and 12."""
    found = lambda pattern, limit: F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, limit)
    errors = F.slice(F.array_distinct(F.filter(F.transform(lines(text), F.trim), lambda x: F.lower(x).rlike("erro|falha|error"))), 1, 12)
    return F.struct(found(r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]*[A-Z0-9]\b", 30).alias("parameters"), found(r"/[a-z]+/[A-Za-z0-9_/-]+", 30).alias("endpoints"), found(r"\b[1-5][0-9]{2}\b", 20).alias("statuses"), errors.alias("error_terms"))
