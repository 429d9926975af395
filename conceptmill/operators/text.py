"""Notes: sections, chunks, tolerant JSON. Sequential per document, parallel over documents."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmill.functions import scalar as S

# Heading and fence patterns, separator, least chunk size, room kept beside a prefix.
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(?:```|~~~)")
PARAGRAPHS = re.compile(r"\n\s*\n")
CHUNK_CHARS, LEAST_CHARS, PREFIX_ROOM = 4000, 200, 10
LOCATION = "【笔记位置：{}】"


@dataclass(frozen=True)
class Section:
    title: str
    breadcrumb: str
    level: int
    text: str

    def chunk_text(self) -> str:
        """The text under its location line, if it has one."""
        return f"{LOCATION.format(self.breadcrumb)}\n{self.text}".strip() if self.breadcrumb else self.text.strip()


class _Outline:
    """Collects lines under a stack of headings; sections without text vanish."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []
        self.lines: list[str] = []
        self.done: list[Section] = []

    def close(self) -> None:
        text = "\n".join(self.lines).strip()
        if text:
            level, title = self.stack[-1] if self.stack else (0, "")
            self.done.append(Section(title, " > ".join(t for _, t in self.stack), level, text))
        self.lines = []

    def heading(self, level: int, title: str) -> None:
        self.close()
        self.stack = [x for x in self.stack if x[0] < level] + [(level, title)]


def markdown_sections(text: str) -> list[Section]:
    """ATX headings open sections; inside fences nothing is a heading."""
    outline, fenced = _Outline(), False
    for line in (text or "").splitlines():
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := HEADING.match(line)):
            outline.heading(len(m[1]), m[2])
            continue
        outline.lines.append(line)
    outline.close()
    return outline.done


def docx_sections(content: bytes) -> list[Section]:
    """Paragraphs with a heading style (Heading 1 to 6, also by localized name) open sections."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ET.fromstring(z.read("word/styles.xml")).iter(f"{w}style"):
                name = style.find(f"{w}name")
                names[style.get(f"{w}styleId")] = name.get(f"{w}val") if name is not None else ""
    outline = _Outline()
    for p in body.iter(f"{w}p"):
        text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
        style = p.find(f"{w}pPr/{w}pStyle")
        ident = style.get(f"{w}val") if style is not None else ""
        level = next((m for x in (names.get(ident, ""), ident) if (m := re.fullmatch(r"(?i)(?:heading|标题)\s*([1-6])", x or ""))), None)
        if level and text:
            outline.heading(int(level[1]), text)
        elif text:
            outline.lines += [text, ""]
    outline.close()
    return outline.done


def note_sections(path: str, content: bytes) -> list[Section]:
    """Sections of a .docx, .md, .markdown or .txt file; other kinds raise ValueError."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "docx":
        return docx_sections(content)
    if kind in ("md", "markdown", "txt"):
        return markdown_sections(content.decode("utf-8", "replace"))
    raise ValueError(f"no reader for {path}")


def _pieces(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """Paragraphs, those over the size cut hard; the flag says that a piece is full."""
    for paragraph in PARAGRAPHS.split(text):
        rest = paragraph.strip()
        while len(rest) > size:
            yield rest[:size], True
            rest = rest[size:]
        if rest:
            yield rest, False


def packed(text: str, size: int) -> list[str]:
    """Paragraphs packed in order up to the size; full pieces stand alone."""
    out: list[str] = []
    open_ = False
    for piece, full in _pieces(text, size):
        if not full and open_ and len(out[-1]) + 2 + len(piece) <= size:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
            open_ = not full
        if full:
            open_ = False
    return out


def chunk_text(text: str, size: int = CHUNK_CHARS) -> list[str]:
    return packed(text or "", max(size, LEAST_CHARS))


def chunk_sections(sections: list[Section], size: int = CHUNK_CHARS) -> list[str]:
    """A chunk per section; longer sections are packed, each part under the location line."""
    out = []
    for s in sections:
        whole = s.chunk_text()
        if len(whole) <= size:
            out.append(whole)
        else:
            head = LOCATION.format(s.breadcrumb)
            out += [f"{head}\n{part}" for part in packed(s.text, max(size - len(head) - PREFIX_ROOM, LEAST_CHARS))]
    return out


def parse_object(text: str) -> dict:
    """The first JSON object in a reply: bare, fenced, or embedded in prose; ValueError if there is none."""
    text = (text or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in ([fenced[1]] if fenced else []) + [text]:
        try:
            if isinstance(found := json.loads(candidate), dict):
                return found
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("no JSON object in the reply")


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_CHARS, sectioned: bool = False) -> DataFrame:
    """(key, chunk_id, breadcrumb-prefixed or plain text) of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text], strict=True):
                parts = chunk_sections(markdown_sections(t), size) if sectioned else chunk_text(t, size)
                rows += [(k, f"chunk-{i:04d}", p) for i, p in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_id string, chunk string")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, title, breadcrumb, level, text) of every markdown document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, s.title, s.breadcrumb, s.level, s.text) for k, t in zip(frame[key], frame[text], strict=True) for i, s in enumerate(markdown_sections(t))]
            yield pd.DataFrame(rows, columns=[key, "seq", "title", "breadcrumb", "level", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, seq int, title string, breadcrumb string, level int, text string")


#: Characters of the grams under which quotes without a whole word inside are looked up.
GRAM = 3


def quotes_in(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, quote) for every document(key, text) that contains an item(item, q), by exact text.

    An inner word of an item is a whole word of a text that contains it. Items are listed under the
    inner word that the fewest documents have, texts send the distinct words that are listed, and
    what meets is verified. Items without an inner word are listed under their first characters.
    Empty and null items are in no text.
    """
    wanted = items.filter(F.length("q") > 0).select(F.col(item), "q")
    inner = F.array_except(F.slice(F.split("q", "[^A-Za-z0-9]+"), F.lit(2), F.greatest(F.size(F.split("q", "[^A-Za-z0-9]+")) - 2, F.lit(0))), F.array(F.lit("")))
    worded = wanted.withColumn("inner", F.array_distinct(inner))
    words = worded.select(item, "q", F.explode("inner").alias("word"))
    listed = words.select("word").distinct()
    sent = docs.select(F.col(key), F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9]+"))).alias("word")).join(listed, "word", "left_semi")
    spread = sent.groupBy(F.col("word").alias("counted")).agg(F.count("*").alias("n"))
    rarest = words.join(spread, F.col("word") == F.col("counted")).groupBy(item, "q").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    pairs = sent.join(rarest, "word").select(key, item, "q")
    short = worded.filter(F.size("inner") == 0).select(item, "q", F.substring("q", 1, GRAM).alias("word"))
    if not short.isEmpty():
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring("text", i, n))))
        cut = docs.filter(F.length("text") > 0).select(key, F.explode(F.array_distinct(grams)).alias("word")).join(short.select("word").distinct(), "word", "left_semi")
        pairs = pairs.unionByName(cut.join(short, "word").select(key, item, "q"))
    met = pairs.distinct().join(docs.select(F.col(key), "text").distinct(), key)
    return met.withColumn("quote", S.verified_quote(F.col("q"), F.col("text"))).filter("quote != ''").select(key, item, "quote").distinct()
