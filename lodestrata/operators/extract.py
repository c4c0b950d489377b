"""Typed snippets and per-file counts from the contents of files.

Matching works on bytes in one Arrow-batched Python pass, as nothing built in returns byte offsets; lines and indentation
stay inside the engine.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import directory_of, glob_to_regex, indentation_max, indentation_sum, line_count, normal_path
from lodestrata.operators import packs

POSITION = "struct<offset:int,line:int,char_in_line:int>"
SNIPPET = f"file string, snippet_type string, begin_position {POSITION}, end_position {POSITION}, content string, pattern int"
_POSITION = pa.struct([("offset", pa.int32()), ("line", pa.int32()), ("char_in_line", pa.int32())])


@dataclass(frozen=True)
class Pack:
    """What to look for in the files of a glob: patterns with named groups, or a named language extractor.

    With ``only_stats`` the snippets are counted but not kept; with ``by_directory`` the component of a file is its folder;
    ``limit`` is the most matches of a pattern in a file.
    """

    name: str
    glob: str
    patterns: tuple[str, ...] = ()
    language: str | None = None
    only_stats: bool = False
    by_directory: bool = False
    limit: int | None = None


def builtin_pack(name: str) -> Pack:
    """A pack by name: ``scala``, ``kotlin``, ``php``, ``java`` or ``csharp``; another name is an error."""
    if name in packs.REGEX_PACKS:
        glob, patterns = packs.REGEX_PACKS[name]
        return Pack(name, glob, tuple(patterns))
    if name in ("java", "csharp"):
        return Pack(name, "**.java" if name == "java" else "**.cs", language=name)
    raise ValueError(f"there is no pack {name!r}; there are {sorted([*packs.REGEX_PACKS, 'java', 'csharp'])}")


def position(offset: int, newlines: list[int], size: int) -> dict[str, int]:
    """Line and byte in the line of an offset, both from 1; an offset at the end is that of the last byte."""
    at = min(offset, max(size - 1, 0))
    line = bisect.bisect_left(newlines, at)
    start = newlines[line - 1] + 1 if line else 0
    return {"offset": offset, "line": line + 1, "char_in_line": at - start + 1}


def _searchers(found: Sequence[Pack]) -> list[tuple[re.Pattern, list[re.Pattern], Pack]]:
    return [(re.compile(glob_to_regex(p.glob)), packs.compiled(list(p.patterns)), p) for p in found]


def _of_language(language: str, source: bytes) -> tuple[list[packs.Found], list[tuple[str, int]]]:
    return packs.java(source) if language == "java" else packs.csharp(source)


def raw_snippets(files: DataFrame, wanted: Sequence[Pack]) -> DataFrame:
    """Snippets of ``path, content``: ``file, snippet_type, begin_position, end_position, content, pattern``.

    Offsets are bytes from 0, the end exclusive; lines and characters count from 1. ``pattern`` is the place of the pack's
    pattern in order. Defined cases: null contents and paths give nothing; bytes that are no UTF-8 become replacement
    characters in ``content``, offsets stay; repeated files give repeated snippets.
    """
    wanted = [p for p in wanted if not p.only_stats]
    gate = "|".join(glob_to_regex(p.glob) for p in wanted) or "(?!)"
    src = files.where(F.col("path").isNotNull() & F.col("content").isNotNull()).where(F.col("path").rlike(gate)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searchers(wanted)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                newlines = None
                for k, (gate_, patterns, pack) in enumerate(search):
                    if not gate_.match(path):
                        continue
                    found = _of_language(pack.language, data)[0] if pack.language else packs.by_patterns(data, patterns, pack.limit)
                    for kind, begin, end, value in found:
                        if kind.startswith("_"):
                            continue
                        if newlines is None:
                            newlines = [m.start() for m in re.finditer(b"\n", data)]
                        row = (path, kind, position(begin, newlines, len(data)), position(end, newlines, len(data)), value.decode("utf-8", "replace"), k)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
            types = [pa.string(), pa.string(), _POSITION, _POSITION, pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                ["file", "snippet_type", "begin_position", "end_position", "content", "pattern"],
            )

    return src.mapInArrow(run, SNIPPET)


def language_stats(files: DataFrame, wanted: Sequence[Pack]) -> DataFrame:
    """``file, stat_type, value``: the counts that language extractors make besides their snippets."""
    wanted = [p for p in wanted if p.language]
    gate = "|".join(glob_to_regex(p.glob) for p in wanted) or "(?!)"
    src = files.where(F.col("path").isNotNull() & F.col("content").isNotNull()).where(F.col("path").rlike(gate)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searchers(wanted)
        for batch in batches:
            rows = [
                (path, kind, float(n))
                for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)
                for gate_, _, pack in search
                if gate_.match(path)
                for kind, n in _of_language(pack.language, data)[1]
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))],
                ["file", "stat_type", "value"],
            )

    return src.mapInArrow(run, "file string, stat_type string, value double")


def snippet_counts(snippets: DataFrame) -> DataFrame:
    """``file, stat_type, value``: snippets per file and type."""
    return snippets.groupBy("file", F.col("snippet_type").alias("stat_type")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def file_measures(files: DataFrame, spaces: int = 4) -> DataFrame:
    """``file, complexity__lines, indentation_max, indentation_sum`` of each file with content (bytes or text)."""
    kind = files.schema["content"].dataType.simpleString()
    text = F.col("content") if kind == "string" else F.decode(F.col("content"), "ISO-8859-1")
    return files.where(F.col("content").isNotNull()).select(
        F.col("path").alias("file"),
        line_count(text).alias("complexity__lines"),
        indentation_max(text, spaces).alias("indentation_max"),
        indentation_sum(text, spaces).alias("indentation_sum"),
    )


def with_directory(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn("directory", directory_of(normal_path(F.col("file"))))
