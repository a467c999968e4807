"""Scalar text functions as Column expressions: identifiers, white space, splitting, escaping.

Letters, digits and white space are ASCII here, as in the markup language; a null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
IDENTIFIER = r"\A[A-Za-z]([A-Za-z0-9_-]*[A-Za-z0-9])?\z"  # $ would also match before a last line break
NAMESPACED = r"\A[A-Za-z]([A-Za-z0-9_-]*[A-Za-z0-9])?(:[A-Za-z]([A-Za-z0-9_-]*[A-Za-z0-9])?)*\z"
#: Tokens of the language itself, which users can't define (fixed values).
RESERVED_TOKENS = ("\\", "%", "%{", "}%", "{!", "<\\", "\\>")


def is_alphabetic(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z]\z")


def is_numeric(c: Column) -> Column:
    return c.rlike(r"\A[0-9]\z")


def is_hexadecimal(c: Column) -> Column:
    return c.rlike(r"\A[0-9A-Fa-f]\z")


def is_alphanumeric(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9]\z")


def is_whitespace(c: Column) -> Column:
    return c.rlike("\\A[ \t\r\n]\\z")


def is_linebreak(c: Column) -> Column:
    return c.rlike("\\A[\r\n]\\z")


def is_identifier(c: Column) -> Column:
    return c.rlike(IDENTIFIER)


def is_identifier_or_empty(c: Column) -> Column:
    return (c == "") | c.rlike(IDENTIFIER)


def is_namespaced_identifier(c: Column) -> Column:
    return c.rlike(NAMESPACED)


def is_user_defined_token(c: Column) -> Column:
    """A token that a schema may define: begins and ends with a sign, holds no white space, is not reserved."""
    edges = c.rlike(r"\A[^A-Za-z0-9]") & c.rlike(r"[^A-Za-z0-9]\z")
    return edges & ~c.rlike("[ \t\r\n]") & ~c.isin(*RESERVED_TOKENS) & ~c.rlike(r"\A[{}]+\z")


def has_non_whitespace(c: Column) -> Column:
    return c.rlike("[^ \t\r\n]")


def trim_text(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def trim_bounds(c: Column) -> Column:
    """struct(start, end) of the trimmed part, counted in characters."""
    left = F.length(c) - F.length(F.ltrim(c, F.lit(BLANKS)))
    return F.struct(left.alias("start"), (left + F.length(trim_text(c))).alias("end"))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.btrim(F.regexp_replace(c, "[ \t\r\n]+", " "))


def split_on(c: Column, separator: str) -> Column:
    """Pieces between single characters; empty ones stay, also at the end."""
    return F.split(c, "\\Q" + separator + "\\E", -1)


def join_with(c: Column, delimiter: str, prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.array_join(c, delimiter), F.lit(suffix))


def to_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def file_extension(c: Column) -> Column:
    """Lower-cased extension; empty if the last dot stands before a separator."""
    return to_lower(F.regexp_extract(c, r"\.([^./\\]*)\z", 1))


def starts_with(c: Column, s: str) -> Column:
    return c.startswith(s)


def ends_with(c: Column, s: str) -> Column:
    return c.endswith(s)


def xml_escape(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def json_string(c: Column) -> Column:
    """A JSON string literal; every control character is escaped."""
    wrapped = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNotNull(), wrapped.substr(F.lit(6), F.length(wrapped) - 6))


def normalise_linebreaks(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\n\r|\r", "\n")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.length(text.substr(F.lit(1), offset)) - F.length(F.replace(text.substr(F.lit(1), offset), F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based character offset."""
    before = text.substr(F.lit(1), offset)
    return F.length(before) - F.coalesce(F.length(before) - F.length(F.substring_index(before, "\n", -1)), F.lit(0)) + 1


def excerpt(text: Column, offset: Column, most: int = 80) -> Column:
    """The line around an offset, cut to so many characters."""
    before = F.substring_index(text.substr(F.lit(1), offset), "\n", -1)
    after = F.substring_index(text.substr(offset + 1, F.length(text)), "\n", 1)
    return F.concat(before, after).substr(1, most)
