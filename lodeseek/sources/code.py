"""Symbols of source files: Python by its own syntax tree, other languages by declaration patterns at the start of a line.

A grammar for another language can be registered as a function content -> list of symbols.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The declaration patterns.
PATTERNS = [
    r"^export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|var|class|interface|type|enum)\s+(\w+)",
    r"^(?:async\s+)?function\s+(\w+)",
    r"^class\s+(\w+)",
    r"^def\s+(\w+)",
    r"^func\s+(\w+)",
]
SCHEMA = "path string, seq int, language string, name string, qualified_name string, kind string, signature string, parent_name string, doc_comment string, line_start int, line_end int, char_start int, char_end int"
Parser = Callable[[str], list[dict]]


def _positions(pattern: str, content: str) -> list[int]:
    return [m.start() for m in re.finditer(pattern, content)]


def by_patterns(content: str) -> list[dict]:
    """Declarations in the order of the patterns, then of their places; each reaches to the next blank line or the end of the text.

    Line ends and blank lines are found once; lines and ends of the declarations are looked up in them."""
    line_ends, blank = _positions("\n", content), _positions("(?=\n\n)", content) + [len(content)]
    line_at = lambda place: bisect_left(line_ends, place) + 1
    rows = pd.DataFrame([(m.start(), m[1], m[0]) for p in PATTERNS for m in re.finditer(p, content, re.M | re.A)], columns=["char_start", "name", "signature"])
    rows["char_end"] = [blank[bisect_left(blank, s)] for s in rows.char_start]
    rows["line_start"], rows["line_end"] = rows.char_start.map(line_at), rows.char_end.map(line_at)
    rows["signature"] = rows.signature.str.strip().str.slice(0, 200)
    return rows.assign(qualified_name=rows.name, kind="function", parent_name=None, doc_comment=None).to_dict("records")


def _signature(text: str) -> str:
    for mark in "{\n":
        if (at := text.find(mark)) > 0:
            return text[:at].strip()
    return text[:200].strip()


def _doc_comment(node: ast.AST, before: str) -> str | None:
    """The docstring, or else the comment lines that stand right above; 500 characters."""
    told = ast.get_docstring(node)
    if not told:
        above = []
        for line in reversed(before.rstrip(" \t").split("\n")[:-1]):
            if not line.strip().startswith("#"):
                break
            above.append(line.strip().lstrip("#").strip())
        told = "\n".join(reversed(above))
    return told[:500] or None


def by_python_tree(content: str) -> list[dict]:
    """Functions and classes in source order; members of a class are qualified by its name, what stands inside a function by the class around that."""
    raw = content.encode()
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    place = lambda line, col: len(raw[: starts[line - 1] + col].decode())
    out, todo = [], [(ast.parse(content), None)]
    while todo:
        node, parent = todo.pop()
        inner = parent
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(node, ast.ClassDef)
            s, e = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            out.append({"name": node.name, "qualified_name": f"{parent}.{node.name}" if parent else node.name, "kind": "class" if is_class else "function", "signature": _signature(content[s:e]), "parent_name": parent, "doc_comment": _doc_comment(node, content[:s]), "line_start": node.lineno, "line_end": node.end_lineno, "char_start": s, "char_end": e})
            inner = node.name if is_class else parent
        todo += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


PARSERS: dict[str, Parser] = {"python": by_python_tree}


def symbols(content: str, language: str, parsers: dict[str, Parser] | None = None) -> list[dict]:
    parser = (PARSERS if parsers is None else parsers).get(language)
    if parser is not None:
        try:
            return parser(content)
        except (SyntaxError, ValueError, RecursionError):
            pass  # what doesn't parse is read by patterns
    return by_patterns(content)


def parse_symbols(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, language, content) -> one row a symbol. Null contents have none."""

    def run(batches):
        for batch in batches:
            rows = [{"path": p, "seq": k, "language": lang} | s for p, lang, c in zip(batch.path, batch.language, batch.content, strict=True) if c for k, s in enumerate(symbols(c, lang, parsers))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)


def as_entities(parsed: DataFrame) -> DataFrame:
    """Symbols with ids (path::qualified name) and parent ids (path::parent name, unenforced)."""
    return parsed.select(
        F.concat("path", F.lit("::"), "qualified_name").alias("id"), F.col("path").alias("file_path"), "name", "qualified_name", "kind", "language", "signature", "line_start", "line_end", "char_start", "char_end",
        F.when(F.col("parent_name").isNotNull(), F.concat("path", F.lit("::"), "parent_name")).alias("parent_id"), "doc_comment", "seq",
    )
