"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "\n... [truncated]"
WORD = r"[\p{L}\p{N}]+"


def estimate_tokens(x: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(x) / F.lit(4)).cast("int")


def truncate_to_budget(x: Column, max_tokens: int) -> Column:
    """The text cut to 4 * max_tokens characters, back to its last line end if that lies in the last fifth, with a marker; unchanged if it fits."""
    most = 4 * max_tokens
    head = F.substring(x, 1, most)
    line_end = F.lit(most) - F.instr(F.reverse(head), "\n")
    cut = F.when((F.instr(head, "\n") > 0) & (line_end > 0.8 * most), F.substring(head, F.lit(1), line_end)).otherwise(head)
    return F.when(estimate_tokens(x) <= max_tokens, x).otherwise(F.concat(cut, F.lit(TRUNCATED)))


def was_truncated(x: Column, max_tokens: int) -> Column:
    return estimate_tokens(x) > max_tokens


def slugify(x: Column) -> Column:
    """ASCII word characters and hyphens, lower case, at most 80; accented letters vanish."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\w\s-]", ""), r"\s+", "-"), 1, 80)


def content_hash(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def split_camel(query: Column) -> Column:
    return F.regexp_replace(query, "([a-z])([A-Z])", "$1 $2")


def word_tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def squeeze(*parts: Column) -> Column:
    """Non-null parts joined by blanks, whitespace runs as one blank, trimmed: the text that is embedded."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))


def symbol_content(name: Column, qualified: Column, kind: Column, signature: Column, doc: Column) -> Column:
    return F.concat_ws(" ", name, qualified, kind, signature, doc)


def clip_line(x: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(x, r"^\s+|\s+\z", ""), 1, most)


def round_half_up(x: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes start (from 0) to end of a binary column."""
    return F.substring(content.cast("binary"), start + 1, end - start)
