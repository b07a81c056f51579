"""DuckDB SQL of the stemmer: every word of a vocabulary goes through the published steps as regular expressions, then joins the texts again.

A first y is a consonant, any other after a consonant a vowel; the expressions say so once it is written as Y.
"""

from __future__ import annotations

from ..functions.stemming import _STEP2, _STEP3, _STEP4

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MEASURED = f"^({_C})?{_V}{_C}"
_MORE = f"^({_C})?{_V}{_C}{_V}{_C}"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL = f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
_has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
_less = lambda x, n: f"left({x}, length({x}) - {n})"


def _step(sql: str, new: str) -> str:
    return f"SELECT word, {new} AS w FROM ({sql})"


def _suffixes(sql: str, table: dict[str, str]) -> str:
    """The longest suffix (x) is exchanged where what stands before it (b) has a measure."""
    to = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    found = f"SELECT word, w, regexp_extract(w, '({'|'.join(table)})$', 1) AS x FROM ({sql})"
    return _step(f"SELECT *, left(w, length(w) - length(x)) AS b FROM ({found})", f"CASE WHEN x <> '' AND {_has('b', _MEASURED)} THEN b || CASE x {to} END ELSE w END")


def stems(vocabulary: str, word: str) -> str:
    """(word, stem) of a query's distinct words. Words that are short or hold anything but a to z stay as they are."""
    sql = f"SELECT {word} AS word, regexp_replace({word}, '^y', 'Y') AS w FROM ({vocabulary}) WHERE regexp_full_match({word}, '[a-z]{{3,}}')"
    sql = _step(sql, f"CASE WHEN {_has('w', '(ss|i)es$')} THEN {_less('w', 2)} WHEN {_has('w', '[^s]s$')} THEN {_less('w', 1)} ELSE w END")
    cut = f"SELECT *, regexp_extract(w, '^(.*?)(ed|ing)$', 1) AS b FROM ({sql})"
    mended = f"CASE WHEN {_has('b', '(at|bl|iz)$')} THEN b || 'e' WHEN right(b, 1) = lower(left(right(b, 2), 1)) AND length(b) > 1 AND {_has('b', '[^aeioulsz]$')} THEN {_less('b', 1)} WHEN {_has('b', _ONE)} AND {_has('b', _SHORT)} THEN b || 'e' ELSE b END"
    sql = _step(cut, f"CASE WHEN {_has('w', 'eed$')} THEN CASE WHEN {_has(_less('w', 3), _MEASURED)} THEN {_less('w', 1)} ELSE w END WHEN {_has('w', '(ed|ing)$')} AND {_has('b', _VOWEL)} THEN {mended} ELSE w END")
    sql = _step(sql, f"CASE WHEN {_has('w', 'y$')} AND {_has(_less('w', 1), _VOWEL)} THEN {_less('w', 1)} || 'i' ELSE w END")
    sql = _suffixes(_suffixes(sql, _STEP2), _STEP3)
    found = f"SELECT word, w, regexp_extract(w, '({'|'.join(_STEP4)})$', 1) AS x FROM ({sql})"
    sql = _step(f"SELECT *, left(w, length(w) - length(x)) AS b FROM ({found})", f"CASE WHEN x <> '' AND {_has('b', _MORE)} AND (x <> 'ion' OR right(b, 1) IN ('s', 't')) THEN b ELSE w END")
    rest = _less("w", 1)
    sql = _step(sql, f"CASE WHEN {_has('w', 'e$')} AND ({_has(rest, _MORE)} OR {_has(rest, _ONE)} AND NOT {_has(rest, _SHORT)}) THEN {rest} ELSE w END")
    sql = _step(sql, f"CASE WHEN {_has('w', 'll$')} AND {_has('w', _MORE)} THEN {rest} ELSE w END")
    return f"SELECT word, lower(w) AS stem FROM ({sql})"


_WORDS = "SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS word FROM documents"
#: Documents with the stems of their words as t; a word keeps its place in the list.
STEMMED = f"""SELECT d.doc_id, d.lang, coalesce(s.t, []) AS t FROM documents d LEFT JOIN (
SELECT doc_id, list(coalesce(stem, w.word)) AS t FROM ({_WORDS}) w LEFT JOIN ({stems(f'SELECT DISTINCT word FROM ({_WORDS})', 'word')}) v ON v.word = w.word GROUP BY doc_id) s USING (doc_id)"""
