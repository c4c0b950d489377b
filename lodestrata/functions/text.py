"""Column expressions over paths and texts of files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Newlines and one; an empty text has one line, null none."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def indentations(text: Column, spaces: int = 4) -> Column:
    """The indentation of each line that ends in a newline, as an array.

    Every run of ``spaces`` blanks counts as a tab wherever it is; leading tabs are counted. The last line without a newline
    has no indentation.
    """
    lines = F.split(text, "\n")
    ended = F.slice(lines, F.lit(1), F.size(lines) - 1)
    tabs = lambda x: F.length(F.regexp_extract(F.replace(x, F.lit(" " * spaces), F.lit("\t")), "^(\t*)", 1))
    return F.transform(ended, tabs)


def indentation_max(text: Column, spaces: int = 4) -> Column:
    return F.coalesce(F.array_max(indentations(text, spaces)), F.lit(0)).cast("long")


def indentation_sum(text: Column, spaces: int = 4) -> Column:
    return F.aggregate(indentations(text, spaces), F.lit(0), lambda a, x: a + x).cast("long")


def directory_of(path: Column) -> Column:
    """The folder of a path, ``.`` at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(".")


def ancestors(directory: Column) -> Column:
    """A folder and every folder above it, but for ``.`` and ``/``."""
    parts = F.split(directory, "/")
    n = F.size(parts)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.filter(every, lambda x: ~x.isin("", ".", "/"))


def normal_path(path: Column) -> Column:
    """A path without a leading ``./``."""
    return F.regexp_replace(path, r"^\./", "")


def glob_to_regex(glob: str) -> str:
    """A pattern for whole paths: ``**`` any folders, ``*`` and ``?`` inside one name, ``{a,b}`` either, ``[...]`` one of."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"
