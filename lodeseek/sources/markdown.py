"""Heading sections of Markdown texts, as a per-document table function in an Arrow pass."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATX = re.compile(r"(#{1,6})\s+([^\n\r  ]+?)(?:\s+#+\s*)?\Z")
_UNDERLINE = {"=": (1, re.compile(r"={3,}\s*\Z")), "-": (2, re.compile(r"-{3,}\s*\Z"))}
SCHEMA = "path string, seq int, title string, level int, parent_seq int, byte_start int, byte_end int, char_start int, char_end int, summary string"


def _open_lines(lines: list[str]) -> list[int]:
    """Numbers of the lines outside closed front matter and outside fences (an unclosed fence reaches the end)."""
    first = 0
    if lines[0].strip() == "---":
        first = next((i + 1 for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
    out, fenced = [], False
    for i in range(first, len(lines)):
        if lines[i].lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            out.append(i)
    return out


def _heading(lines: list[str], i: int, first: int) -> tuple[int, str] | None:
    atx = _ATX.match(lines[i])
    if atx and atx[2].strip():
        return len(atx[1]), atx[2].strip()
    level, under = _UNDERLINE.get(lines[i][:1], (0, None))
    above = lines[i - 1].strip() if i > first else ""
    return (level, above) if under and above and under.match(lines[i]) else None


def sections(content: str) -> list[dict]:
    """Sections in order, each up to the next heading. A setext section starts at its underline; byte_end of the last one counts a final line end that
    needn't be there, char_end doesn't. parent_seq is the nearest earlier heading of a smaller level that is still open."""
    lines = content.split("\n")
    opened = _open_lines(lines)
    first = 0
    if lines[0].strip() == "---":
        first = next((i + 1 for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
    byte_at = [0, *accumulate(len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines)]
    char_at = [0, *accumulate(len(x) + 1 for x in lines)]
    heads = [(i, *h) for i in opened if (h := _heading(lines, i, first))]
    out, chain = [], []
    for seq, (i, level, title) in enumerate(heads):
        end = heads[seq + 1][0] if seq + 1 < len(heads) else len(lines)
        chain = [k for k in chain if heads[k][1] < level]
        body = content[char_at[i] : char_at[end]].split("\n")
        told = next((x.strip()[:120] for x in body if x.strip() and x[0] not in "#=-"), None)
        out.append({"seq": seq, "title": title, "level": level, "parent_seq": chain[-1] if chain else None, "byte_start": byte_at[i], "byte_end": byte_at[end], "char_start": char_at[i], "char_end": min(char_at[end], len(content)), "summary": told})
        chain.append(seq)
    return out


def parse_sections(docs: DataFrame) -> DataFrame:
    """(path, content) -> one row a section. Null contents have none."""

    def run(batches):
        for batch in batches:
            rows = [{"path": p} | s for p, c in zip(batch.path, batch.content, strict=True) if c for s in sections(c)]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            for c in out.columns.drop(["path", "title", "summary"]):
                out[c] = out[c].astype("Int32")
            yield out

    return docs.select("path", "content").mapInPandas(run, SCHEMA)


def slug(column: str = "title"):
    from ..functions.text import slugify

    return slugify(F.col(column))


def as_entities(parsed: DataFrame) -> DataFrame:
    """Sections with ids (path::slug#level) and the id of the real parent."""
    named = parsed.withColumn("id", F.concat("path", F.lit("::"), slug(), F.lit("#"), F.col("level").cast("string")))
    parents = named.select("path", F.col("seq").alias("parent_seq"), F.col("id").alias("parent_id"))
    out = named.join(parents, ["path", "parent_seq"], "left")
    return out.select("id", F.col("path").alias("file_path"), "title", "level", "parent_id", "byte_start", "byte_end", "char_start", "char_end", "summary", "seq")


def html_headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, level, title) of h1 to h6 without inner tags."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(0))
    rows = pages.select(key, F.explode(found).alias("h"))
    return rows.select(key, F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), F.regexp_replace("h", "<[^>]*>", "").alias("title"))
