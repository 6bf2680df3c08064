"""Documents as bytes, and sections of HTML, Markdown, JSON and CSV (SRC-2 to SRC-8)."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
MAX_DEPTH = 20
_SECTIONS = "array<struct<level:int,heading:string,path:array<string>,text:string>>"


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """(path, name, size, mime_type, content) of files (SRC-2)."""
    kinds = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "json": "application/json", "csv": "text/csv", "txt": "text/plain", "pdf": "application/pdf"}
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    name = F.element_at(F.split("path", "/"), -1)
    mime = F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(name, r"\."), -1))), F.lit("application/octet-stream"))
    return spark.read.format("binaryFile").load(glob).select("path", name.alias("name"), F.col("length").alias("size"), mime.alias("mime_type"), "content")


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes to text by the first encoding that fits (SRC-3)."""

    def one(raw: bytes | None) -> str | None:
        for name in ENCODINGS if raw is not None else ():
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one)


class _Outline:
    """Sections in order, each with the headings it stands under (SRC-6)."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []
        self.sections: list[dict] = []
        self.open(0, "")

    def open(self, level: int, heading: str) -> None:
        if level:
            while self.stack and self.stack[-1][0] >= level:
                self.stack.pop()
            self.stack.append((level, heading))
        self.sections.append({"level": level, "heading": heading, "path": [h for _, h in self.stack], "text": []})

    def done(self, joiner: str) -> list[dict]:
        made = [s | {"text": joiner.join(s["text"]).strip()} for s in self.sections]
        return [s for s in made if s["heading"] or s["text"]]


class _Html(HTMLParser):
    SKIPPED = {"script", "style", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.outline, self.hidden, self.title, self.level = _Outline(), 0, [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.level, self.title = int(tag[1]), []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif self.level and tag == f"h{self.level}":
            self.outline.open(self.level, " ".join(" ".join(self.title).split()))
            self.level = 0

    def handle_data(self, data: str) -> None:
        words = " ".join(data.split())
        if words and not self.hidden:
            (self.title if self.level else self.outline.sections[-1]["text"]).append(words)


def html_sections(html: str | None) -> list[dict]:
    parser = _Html()
    parser.feed(html or "")
    parser.close()
    return parser.outline.done(" ")


def markdown_sections(text: str | None) -> list[dict]:
    outline, fenced = _Outline(), False
    for line in (text or "").split("\n"):
        fence = line.lstrip().startswith(("```", "~~~"))
        heading = None if fenced or fence else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        fenced ^= fence
        if heading:
            outline.open(len(heading[1]), heading[2])
        else:
            outline.sections[-1]["text"].append(line)
    return outline.done("\n")


def json_lines(text: str | None) -> str | None:
    """One 'path: value' line per leaf; deeper than the cap, the rest as JSON."""

    def walk(at: str, x: object, depth: int) -> list[str]:
        if depth < MAX_DEPTH and isinstance(x, dict) and x:
            return [line for k, v in x.items() for line in walk(f"{at}.{k}" if at else str(k), v, depth + 1)]
        if depth < MAX_DEPTH and isinstance(x, list) and x:
            return [line for k, v in enumerate(x) for line in walk(f"{at}[{k}]", v, depth + 1)]
        value = x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        return [f"{at}: {value}" if at else value]

    try:
        return None if text is None else "\n".join(walk("", json.loads(text), 0))
    except (ValueError, RecursionError):
        return None


def csv_lines(text: str | None) -> str | None:
    if text is None:
        return None
    csv.field_size_limit((1 << 31) - 1)  # a cell may be a whole text
    out = []
    for row in csv.reader(io.StringIO(text)):
        if any(c.strip() for c in row):
            out.append("\t".join(c.strip() for c in row))
    return "\n".join(out)


def _sections(df: DataFrame, col: str, parse) -> DataFrame:
    @F.pandas_udf(_SECTIONS)
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(parse)

    keys = [c for c in df.columns if c != col]
    found = df.select(*keys, F.posexplode(run(col)).alias("section", "_s"))
    return found.select(*keys, "section", "_s.level", "_s.heading", "_s.path", "_s.text")


def parse_html(df: DataFrame, col: str = "html") -> DataFrame:
    """A row per section between headings, without scripts and styles (SRC-4, SRC-6)."""
    return _sections(df, col, html_sections)


def parse_markdown(df: DataFrame, col: str = "text") -> DataFrame:
    """A row per section under '#' headings outside fenced code (SRC-5, SRC-6)."""
    return _sections(df, col, markdown_sections)


@F.pandas_udf(T.StringType())
def flatten_json(text: pd.Series) -> pd.Series:
    """SRC-7; null for what is not JSON."""
    return text.map(json_lines)


#: Characters of text that a task holds before it hands them on.
_FLUSH = 1 << 22


def csv_to_text(df: DataFrame, col: str = "text") -> DataFrame:
    """``df`` with the CSV in ``col`` as text: rows tab-joined, blank ones dropped (SRC-8).

    One text at a time, handed on by some megabytes, however many rows a batch has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, begin, held, size = batch.schema.get_field_index(col), 0, [], 0
            for i in range(batch.num_rows):
                held.append(csv_lines(batch[at][i].as_py()))
                size += len(held[-1] or "")
                if size > _FLUSH or i + 1 == batch.num_rows:
                    columns = [pa.array(held, pa.string()) if k == at else c for k, c in enumerate(batch.slice(begin, len(held)).columns)]
                    yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
                    begin, held, size = i + 1, [], 0

    return df.mapInArrow(run, df.schema)
