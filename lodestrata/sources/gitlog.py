"""Change histories: the log of repositories read and taken apart."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times are those of the authors, which no rebase moves. Between commits, and between the fields of one. Control characters, so a subject may hold dashes.
RECORD, FIELD = "\x1e", "\x1f"
FORMAT = "%x1e%H%x1f%at%x1f%an%x1f%ae%x1f%s%x1f"


def find_repositories(root: str) -> list[str]:
    """Folders under ``root`` that hold a repository, relative to it, ``''`` for itself; nothing below one is searched."""
    out = []
    for here, folders, files in os.walk(root):
        if ".git" in folders or ".git" in files:
            out.append("" if here == root else os.path.relpath(here, root))
            folders[:] = []
        folders.sort()
    return sorted(out)


def read_log(path: str) -> str:
    """The log of one repository with changed lines per file, renames as they are."""
    command = ["git", "-C", path, "log", "--all", "--numstat", "--no-renames", f"--pretty=format:{FORMAT}"]
    return subprocess.run(command, capture_output=True, check=True, text=True, errors="replace").stdout


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """``repo, log`` of all repositories under ``root``; the logs are read by the tasks."""
    repos = spark.createDataFrame([(r,) for r in find_repositories(root)], "repo string")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(log=[read_log(os.path.join(root, r)) for r in pdf["repo"]])

    return repos.repartition(max(1, repos.count())).mapInPandas(run, "repo string, log string")


def raw_commits(logs: DataFrame) -> DataFrame:
    """``repo, commit_hash, commit_time, author, author_email, message, files`` of ``repo, log``; ``files`` has the changed lines.

    Lines of files are cut at tabs, so names may hold blanks; counts that are no number (binary files) are 0.
    """
    blocks = logs.select("repo", F.explode(F.split("log", RECORD)).alias("block")).where(F.trim("block") != "")
    f = F.split("block", FIELD)
    lines = F.filter(F.split(F.get(f, 5), r"\r?\n"), lambda x: F.size(F.split(x, "\t")) == 3)

    def part(x):
        cut = F.split(x, "\t")
        count = lambda i: F.coalesce(F.get(cut, i - 1).try_cast("int"), F.lit(0))
        return F.struct(count(1).alias("additions"), count(2).alias("deletions"), F.get(cut, 2).alias("path"))

    return blocks.where(F.size(f) >= 6).select(
        "repo",
        F.trim(F.get(f, 0)).alias("commit_hash"),
        F.timestamp_seconds(F.get(f, 1).try_cast("long")).alias("commit_time"),
        F.get(f, 2).alias("author"),
        F.get(f, 3).alias("author_email"),
        F.get(f, 4).alias("message"),
        F.transform(lines, part).alias("files"),
    )


def commit_parts(raw: DataFrame) -> DataFrame:
    """One row per commit and file: paths are relative to the root, as are those of the files themselves."""
    path = F.when(F.col("repo") == "", F.col("f.path")).otherwise(F.concat("repo", F.lit("/"), F.col("f.path")))
    rows = raw.select("*", F.explode("files").alias("f"))
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")
    return rows.select(
        "repo", "commit_hash", "commit_time", path.alias("file"), folder.alias("directory"), "author", "author_email", "message",
        F.col("f.additions").alias("additions"), F.col("f.deletions").alias("deletions"),
    )
