"""Files linked to components, and components to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import ancestors, directory_of
from lodestrata.operators.packs import DECLARATIONS, IMPORTS

UNKNOWN = "Unknown"


def declared_components(snippets: DataFrame) -> DataFrame:
    """``snippets`` with ``component``: the value of the first declaration of their file, or ``Unknown``."""
    snippets = snippets.drop("component")
    first = (
        snippets.where(F.col("snippet_type") == DECLARATIONS)
        .groupBy(F.col("file").alias("d_file"))
        .agg(F.min_by("content", F.struct("pattern", "begin_position.offset", "content")).alias("component"))
    )
    return snippets.join(first, F.col("file") == F.col("d_file"), "left").drop("d_file").withColumn("component", F.coalesce("component", F.lit(UNKNOWN)))


def directory_components(snippets: DataFrame) -> DataFrame:
    """``snippets`` with their folder as ``component``."""
    return snippets.withColumn("component", directory_of(F.col("file")))


def connections(snippets: DataFrame) -> DataFrame:
    """``from, to, file, begin_position, end_position``: one row per import of another existing component.

    The value of an import must be exactly the name of a component. Rows without a component import for nobody.
    """
    known = snippets.where(F.col("component").isNotNull()).select(F.col("component").alias("to")).distinct()
    imports = snippets.where((F.col("snippet_type") == IMPORTS) & F.col("component").isNotNull()).select(
        F.col("component").alias("from"), F.col("content").alias("to"), "file", "begin_position", "end_position"
    )
    return imports.where(F.col("from") != F.col("to")).join(known, "to", "left_semi").select("from", "to", "file", "begin_position", "end_position")


def direct_connections(conn: DataFrame) -> DataFrame:
    """``from, to, file, reference_count``."""
    return conn.groupBy("from", "to", "file").agg(F.count(F.lit(1)).alias("reference_count"))


def component_files(snippets: DataFrame) -> DataFrame:
    """``component, file`` of files with snippets; a file without snippets has no component."""
    return snippets.where(F.col("component").isNotNull()).select("component", "file").distinct()


def directory_files(snippets: DataFrame) -> DataFrame:
    """``directory, file``: each file with snippets in its folder and all folders above."""
    files = snippets.select("file").distinct()
    return files.select(F.explode(ancestors(directory_of(F.col("file")))).alias("directory"), "file")


def closed_directories(directories: DataFrame) -> DataFrame:
    """``directory``: the given folders and all folders above them."""
    return directories.select(F.explode(ancestors(F.col("directory"))).alias("directory")).distinct()
