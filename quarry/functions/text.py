"""Text scalar expressions: templates, parsing, normalisation, tokenising.

All of these are built-in Column expressions (JVM-side, codegen), no UDFs.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Document templates used for encoding, searching and query building
# ({title} and {abstract} are placeholders):
TEMPLATES = {
    "passage": "Title: {title}[SEP]\n Abstract: {abstract}",
    "run": "Title: {title}[SEP]\n{abstract}",
    "core": "Title: {title}[SEP]\nAbstract: {abstract}",
    "plain": "{title} {abstract}",
    "indented": "Title: {title}[SEP]\n \n        Abstract: {abstract}\n        ",
}
SEP = "[SEP]"
TITLE_PREFIX = "Title: "
# ASCII punctuation stripped from both ends of a token (Python's string.punctuation)
PUNCTUATION = string.punctuation
# Whitespace that separates tokens (explicit, so Java, RE2 and Python agree)
WS_CLASS = "[ \\t\\n\\r\\f\\x0b]"
# ---------------------------------------------------------------------------



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def render(template: str, **cols) -> Column:
    """Fill ``{name}`` placeholders with columns; any null part gives a null text."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        m = re.fullmatch(r"\{(\w+)\}", piece)
        parts.append(_c(cols[m.group(1)]) if m else F.lit(piece))
    return F.concat(*parts)


def render_text(title, abstract, template: str = "passage") -> Column:
    return render(TEMPLATES.get(template, template), title=title, abstract=abstract)


def sql_render(template: str, title_sql: str, abstract_sql: str) -> str:
    """The same template as a DuckDB/ANSI expression (``||`` propagates null)."""
    out = []
    for piece in re.split(r"(\{\w+\})", TEMPLATES.get(template, template)):
        if not piece:
            continue
        if piece == "{title}":
            out.append(f"({title_sql})")
        elif piece == "{abstract}":
            out.append(f"({abstract_sql})")
        else:
            lines = piece.split("\n")
            lits = " || chr(10) || ".join("'" + ln.replace("'", "''") + "'" for ln in lines)
            out.append(f"({lits})")
    return " || ".join(out)


def parse_title(text) -> Column:
    """C6 title: text before the first separator, first 'Title: ' removed, whitespace trimmed."""
    first = F.split_part(_c(text), F.lit(SEP), F.lit(1))
    no_prefix = F.regexp_replace(first, "(?s)^(.*?)" + re.escape(TITLE_PREFIX), "$1")
    return F.btrim(no_prefix, F.lit(" \t\n\r\f\u000b"))


def parse_abstract(text) -> Column:
    """C6 abstract: the piece between the first and second separator; null without one."""
    t = _c(text)
    return F.when(F.instr(t, SEP) > 0, F.split_part(t, F.lit(SEP), F.lit(2)))


def normalise_title(col, mode: str = "lower") -> Column:
    """``lower`` = trim + lower; ``alnum`` = trim + drop non-word chars; ``nocomma``."""
    c = _c(col)
    ws = " \t\n\r\f\u000b"
    if mode == "lower":
        return F.lower(F.btrim(c, F.lit(ws)))
    if mode == "alnum":
        return F.regexp_replace(F.btrim(c, F.lit(ws)), "[^\\p{L}\\p{N}_ \\t\\n\\r\\f\\x0b]", "")
    if mode == "nocomma":
        return F.regexp_replace(c, ",", "")
    raise ValueError(mode)


def tokens(col) -> Column:
    """R8 without the stop list: lower, split on whitespace, strip ASCII punctuation
    from both ends, drop empty tokens.  Returns ``ARRAY<STRING>`` in text order."""
    parts = F.split(F.lower(_c(col)), WS_CLASS + "+")
    stripped = F.transform(parts, lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    return F.filter(stripped, lambda t: F.length(t) > 0)


SQL_TOKENS = ("list_filter(list_transform(regexp_split_to_array(lower({x}), '[ \\t\\n\\r\\f\\x0b]+'), "
              "lambda t: regexp_replace(t, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g')), lambda t: length(t) > 0)")


def sql_tokens(x: str) -> str:
    return SQL_TOKENS.format(x=x)


def restore_abstract(m) -> Column:
    """Order the words of an inverted index by position and join by space.

    null -> null, empty map -> "", equal positions keep map order."""
    entries = F.map_entries(_c(m))
    triples = F.flatten(F.transform(entries, lambda e, i: F.transform(
        e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(triples), lambda s: s["w"]), " ")
