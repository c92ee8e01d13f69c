"""Scalar functions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case; other runs become one dash, none at the ends."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def key_slug(text: Column) -> Column:
    """A key out of a title: letters and digits of any script, other runs become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a closing line break opens no further line."""
    n = F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n"))
    return F.when(F.length(text) == 0, 0).otherwise(n)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def java_regex(pattern: str) -> str:
    """The query language's regular expressions in Java's dialect: Unicode classes, named groups."""
    return "(?U)" + re.sub(r"\(\?P<", "(?<", pattern)


def glob_regex(pattern: str) -> str:
    """A key glob as a regular expression: * within a segment, ** across segments, ? one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches_globs(key: Column, globs: list[str]) -> Column:
    """Ordered globs, the last that matches decides; ``!`` excludes."""
    result = F.lit(False)
    for g in globs:
        result = F.when(key.rlike(glob_regex(g.removeprefix("!"))), not g.startswith("!")).otherwise(result)
    return result
