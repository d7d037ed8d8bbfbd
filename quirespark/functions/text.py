"""Text expressions, all built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the separators U+001C to U+001F.
SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"
#: The numerals that a question may use.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; trim() only knows U+0020."""
    return F.regexp_replace(text, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!{SPACE}){SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{SPACE}*\\z")


def starts_lower(text: Column) -> Column:
    """The first character is a lower-case letter."""
    return text.rlike(r"^\p{IsLowercase}")


def truncate(text: Column, n: int, ellipsis: str = "...") -> Column:
    """The first n characters, and an ellipsis if that cuts any."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(ellipsis))).otherwise(text)


def numeral(text: Column) -> Column:
    """Digits or one of ten numerals as an integer, else null."""
    known = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    return F.coalesce(F.when(text.rlike(r"^[0-9]+$"), text.try_cast("int")), F.try_element_at(known, text))


def preview(text: Column, max_lines: int = 50, more: str = "\n... ({} more lines)") -> Column:
    """The first lines of a text with a note of how many follow."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines) - F.when(text.endswith("\n"), 1).otherwise(0)
    before, after = more.split("{}")
    head = F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), F.lit("\n"), F.lit(before), (n - max_lines).cast("string"), F.lit(after))
    return F.when(n <= max_lines, text).otherwise(head)
