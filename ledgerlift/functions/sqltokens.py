"""SQL text as tokens: code, string literals and comments. Built-in expressions only.

A string ends at its quote; a doubled quote simply starts the next string, so
both halves stay literals. Unclosed strings and comments run to the end. What else
counts depends on the source: the MySQL family has backslash escapes, ``#``
comments and backtick names, the Postgres family dollar quotes, SQL Server bracket
names. Without a source, ``#`` starts a comment and names are plain code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlift.functions.values import let  # noqa: F401  (re-exported)

# Loops in the code branch are possessive: no backtracking and no recursion on long texts.
TOKEN = (
    r"'[^']*(?:'|\z)"
    r'|"[^"]*(?:"|\z)'
    r"|--[^\n]*|#[^\n]*"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r"|(?:[^'\"#/\-]++|-(?!-)|/(?!\*))++"
)
_ENDS = r"""|--[^\n]*|/\*[\s\S]*?(?:\*/|\z)"""
_PLAIN = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""
_TAG = r"[A-Za-z_][A-Za-z_0-9]*"
TOKENS = {
    None: TOKEN,
    "mysql": r"""'(?:[^'\\]++|\\[\s\S]|\\\z)*+(?:'|\z)|"(?:[^"\\]++|\\[\s\S]|\\\z)*+(?:"|\z)|`(?:[^`]++|``)*+(?:`|\z)|#[^\n]*"""
    + _ENDS + r"""|(?:[^'"`#/\-]++|-(?!-)|/(?!\*))++""",
    "postgres": _PLAIN + rf"""|(?<![A-Za-z_0-9$])\$({_TAG}|)\$[\s\S]*?(?:\$\1\$|\z)""" + _ENDS
    + rf"""|(?:[^'"$/\-]++|(?<=[A-Za-z_0-9$])\$|\$(?!(?:{_TAG})?\$)|-(?!-)|/(?!\*))++""",
    "mssql": _PLAIN + r"""|\[(?:[^\]]++|\]\])*+(?:\]|\z)""" + _ENDS + r"""|(?:[^'"\[/\-]++|-(?!-)|/(?!\*))++""",
}
DOLLAR = rf"^\$(?:{_TAG})?\$"
CLOSED = {"'": r"^'(?:[^'\\]++|\\[\s\S])*+'\z", '"': r'^"(?:[^"\\]++|\\[\s\S])*+"\z'}
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\r\n\f\u000b"


def sql_pattern(p: str) -> str:
    """Case-blind pattern whose word edges are ASCII, whatever letters stand next to a keyword."""
    return "(?i)" + p.replace(r"\b", WORD_EDGE)


def upper_pattern(p: str) -> str:
    """The same rule for text that is already upper case.

    A leading word edge moves behind the keyword, so the search can start from
    the keyword itself, which is much faster on long lines.
    """
    raised = re.sub(r"\\.|[a-z]", lambda m: m[0] if m[0][0] == "\\" else m[0].upper(), p)
    raised = re.sub(r"(^|\|)\\b([A-Z_]+)", r"\1\2(?<!\\w\2)", raised)
    return raised.replace(r"\b", r"(?!\w)")


def needles(p: str) -> list[str]:
    """Text of which a match contains at least one: the literal start of each alternative."""
    found = []
    for alternative in p.split("|") if "(" not in p.split("|")[0] or p.count("(") == p.count(r"\(") else [p]:
        lead = re.match(r"(?:\\b)?((?:\\[\[$(]|[\w`@ ])+)", alternative)
        found.append(lead[1].replace("\\", "").upper())
    return found


def ascii_upper(c: Column) -> Column:
    """Upper case of ASCII letters only, so that positions stay the same."""
    return let(c, lambda x: F.when(F.char_length(x) == F.octet_length(x), F.upper(x)).otherwise(F.translate(x, LOWER, UPPER)))


def tokens(sql: Column, family: str | None = None) -> Column:
    """Array of tokens that concatenate to the text."""
    return F.regexp_extract_all(sql, F.lit(TOKENS[family]), F.lit(0))


def is_comment(token: Column, family: str | None = None) -> Column:
    found = token.startswith("--") | token.startswith("/*")
    return found | token.startswith("#") if family in (None, "mysql") else found


def is_name(token: Column, family: str | None = None) -> Column:
    """A quoted name that is a token of its own."""
    return token.startswith("`") if family == "mysql" else token.startswith("[") if family == "mssql" else F.lit(False)


def is_code(token: Column, family: str | None = None) -> Column:
    literal = token.startswith("'") | token.startswith('"')
    if family == "postgres":
        literal = literal | token.rlike(DOLLAR)
    return ~(literal | is_comment(token, family))


def strip_white(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def map_code(parts: Column, change, family: str | None = None) -> Column:
    """Apply ``change`` to code tokens; literals and comments pass through."""
    return F.transform(parts, lambda t: F.when(is_code(t, family), change(t)).otherwise(t))


def join(parts: Column) -> Column:
    return F.array_join(parts, "")


def mask_literals(sql: Column, family: str | None = None) -> Column:
    """The text with literals and comments blanked, same length, line breaks kept."""

    def blank(t: Column) -> Column:
        lines = F.array_join(F.transform(F.split(t, "\n"), lambda s: F.repeat(F.lit(" "), F.char_length(s))), "\n")
        return F.when(is_code(t, family), t).when(F.contains(t, F.lit("\n")), lines).otherwise(F.repeat(F.lit(" "), F.char_length(t)))

    return join(F.transform(tokens(sql, family), blank))


def statement_tokens(parts: Column, family: str | None = None) -> Column:
    """Tokens of a text as one array for each statement, cut at semicolons in code, which are left out."""

    def grouped(pieces: Column) -> Column:
        ends = F.filter(F.transform(pieces, lambda t, i: F.when(t == ";", i + 1)), lambda i: i.isNotNull())
        firsts, lasts = F.concat(F.array(F.lit(0)), ends), F.concat(ends, F.array(F.size(pieces) + 1))
        return F.zip_with(firsts, lasts, lambda i, j: F.slice(pieces, i + 1, j - i - 1))

    cut = F.transform(parts, lambda t: F.when(is_code(t, family) & ~is_name(t, family), F.regexp_extract_all(t, F.lit("[^;]++|;"), F.lit(0))).otherwise(F.array(t)))
    return let(F.flatten(cut), grouped)


def split_statements(sql: Column, family: str | None = None) -> Column:
    """Array of statements, cut at semicolons in code. Comments, literals and quoted names stay as written."""
    return F.transform(statement_tokens(tokens(sql, family), family), join)


def ends_open(sql: Column, family: str | None = None) -> Column:
    """Whether the text ends inside a string, a quoted name or a block comment."""
    return let(F.try_element_at(tokens(sql, family), F.lit(-1)), lambda last: stays_open(last, family))


def stays_open(last: Column, family: str | None = None) -> Column:
    """Whether a text's last token lacks its end."""
    start = F.left(last, F.lit(1))
    text = r"^'[^']*'\z", r'^"[^"]*"\z'
    one, two = (CLOSED["'"], CLOSED['"']) if family == "mysql" else text
    opened = (
        ((start == "'") & ~last.rlike(one)) | ((start == '"') & ~last.rlike(two)) | (last.startswith("/*") & ~last.rlike(r"^/\*[\s\S]*\*/\z"))
        | (is_name(last, family) & ~last.rlike(r"^(?:`(?:[^`]++|``)*+`|\[(?:[^\]]++|\]\])*+\])\z"))
    )
    if family == "postgres":
        opened = opened | (last.rlike(DOLLAR) & ~last.rlike(rf"^\$({_TAG}|)\$[\s\S]*\$\1\$\z"))
    return F.coalesce(opened, F.lit(False))
