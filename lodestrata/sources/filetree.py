"""Trees of files, with rules of what to ignore."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the files that hold rules.
IGNORE_FILES = (".gitignore", ".lodestrataignore")


@dataclass(frozen=True)
class Rule:
    """A rule: a pattern for root-relative paths, whether it takes back, and the folder it holds in."""

    regex: str
    negated: bool
    scope: str


def rule(line: str, scope: str = "") -> Rule | None:
    """The rule of one line, or None for blanks and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\")
    anchored = "/" in line.rstrip("/")
    folder = line.endswith("/")
    body = line.strip("/") if line.strip("/") else line
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            while i < len(body) and body[i] == "*":
                i += 1
            out += "[^/]*"
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            if body[i] == "\\" and i + 1 < len(body):
                i += 1
            out, i = out + re.escape(body[i]), i + 1
    head = "^" if anchored else "(?:^|/)"
    return Rule(f"{head}{out}{'/' if folder else '(?:$|/)'}", negated, scope)


def _rule_files(root: str, spark: SparkSession | None) -> Iterator[tuple[str, str]]:
    """Folder (relative to ``root``, ``''`` for itself) and text of each ignore file, folder by folder.

    A folder of this machine is walked as it is; one of a file system that Spark knows (``scheme://``) through that.
    """
    if "://" not in root:
        for here, folders, files in os.walk(root):
            folders.sort()
            scope = os.path.relpath(here, root)
            for name in IGNORE_FILES:
                if name in files:
                    with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                        yield "" if scope == "." else scope, f.read()
        return
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = system.getFileStatus(top).getPath().toUri().getPath().rstrip("/")
    todo = [top]
    while todo:
        found = list(system.listStatus(todo.pop()))
        for st in sorted(found, key=lambda x: IGNORE_FILES.index(x.getPath().getName()) if x.getPath().getName() in IGNORE_FILES else -1):
            if st.isFile() and st.getPath().getName() in IGNORE_FILES:
                stream = system.open(st.getPath())
                try:
                    text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
                finally:
                    stream.close()
                yield st.getPath().getParent().toUri().getPath()[len(base) + 1 :], text
        todo += sorted((x.getPath() for x in found if x.isDirectory() and x.getPath().getName() != ".git"), key=str, reverse=True)


def read_rules(root: str, rebase: bool = False, spark: SparkSession | None = None) -> list[Rule]:
    """The rules of all ignore files under ``root``; ``spark`` is needed for other file systems than this machine's.

    A rule holds in the folder of its file and below. It is matched against the path from the root, or with ``rebase``
    against the path from that folder.
    """
    out = []
    for scope, text in _rule_files(root, spark):
        for line in text.splitlines():
            r = rule(line, scope)
            if r:
                out.append(Rule(f"rebase:{r.regex}" if rebase and scope else r.regex, r.negated, scope))
    return out


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether a root-relative path is ignored: the last rule that fits decides; ignore files always are."""
    result = F.lit(False)
    for r in rules:
        inside = path.startswith(r.scope + "/") if r.scope else F.lit(True)
        target, regex = path, r.regex
        if regex.startswith("rebase:"):
            target, regex = path.substr(F.lit(len(r.scope) + 2), F.length(path)), regex[len("rebase:") :]
        result = F.when(inside & target.rlike(regex), F.lit(not r.negated)).otherwise(result)
    own = F.lit(False)
    for name in IGNORE_FILES:
        own = own | (path == name) | path.endswith("/" + name)
    return result | own


def read_tree(spark: SparkSession, root: str, rebase: bool = False) -> DataFrame:
    """``path, content`` of all files under ``root`` that are not ignored; paths from the root, files at it as ``./x``.

    ``root`` is a folder of this machine, or of any file system that Spark reads (``scheme://``).
    """
    base = root.rstrip("/") if "://" in root else os.path.abspath(root)
    # paths come with the scheme, written with one slash or three where there is no host
    inside = re.sub(r"^file:/*", "/", base)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(base)
        .select(F.regexp_replace("path", r"^file:/+", "/").alias("full"), "content")
    )
    relative = F.col("full").substr(F.lit(len(inside.rstrip("/")) + 2), F.length("full"))
    rows = files.select(relative.alias("path"), "content").where(~ignored(F.col("path"), read_rules(base, rebase, spark)))
    rows = rows.where(~F.col("path").startswith(".git/") & ~F.col("path").contains("/.git/"))
    return rows.select(F.when(F.col("path").contains("/"), F.col("path")).otherwise(F.concat(F.lit("./"), "path")).alias("path"), "content")
