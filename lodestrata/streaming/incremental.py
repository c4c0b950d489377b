"""The per-file and per-day operators over streams of files and of commit rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestrata.operators.extract import Pack, raw_snippets


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def snippet_stream(files: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Snippets of files as they arrive; extraction keeps no state."""
    return raw_snippets(files, packs)


_STATE = "day int, additions long, deletions long, loaded timestamp"
_CHANGE = "entity string, day int, additions long, deletions long, rows long"


def correction_stream(parts: DataFrame, lateness: str = "180 days") -> DataFrame:
    """``entity, day, additions, deletions, rows``: what each delivery of commit rows changes, by file and day.

    The row of a (commit, file) that was loaded last counts. Its first delivery adds it; a later one takes the old amounts
    back and adds its own; an older one, or the same again, changes nothing. So the sums of all that came out are those of
    the valid rows at any time, and each batch is what :func:`lodestrata.operators.rolling.upsert_forest` takes. The valid
    row is kept as state by (commit, file), and is forgotten once rows loaded ``lateness`` later have come; rows later than
    that are dropped. A null ``loaded_at`` is the time of the commit.
    """
    rows = parts.where(F.col("file").isNotNull() & F.col("commit_hash").isNotNull()).select(
        "commit_hash",
        "file",
        F.floor(F.unix_micros(F.col("commit_time").cast("timestamp")) / 86_400_000_000).cast("int").alias("day"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("additions", "deletions")],
        F.coalesce(*[F.col(c).cast("timestamp") for c in ("loaded_at", "commit_time")], F.lit("1970-01-01").cast("timestamp")).alias("loaded"),
    )
    kept = pd.Timedelta(lateness)

    def latest(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        new = old
        for pdf in batches:
            for r in pdf.sort_values("loaded", kind="stable").itertuples(index=False):
                if new is None or r.loaded > pd.Timestamp(new[3]):
                    new = (None if pd.isna(r.day) else int(r.day), int(r.additions), int(r.deletions), r.loaded.to_pydatetime())
        if new is None or new == old:
            return
        state.update(new)
        if (until := int((pd.Timestamp(new[3]) + kept).timestamp() * 1000)) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        changes = [(key[1], v[0], sign * v[1], sign * v[2], sign) for v, sign in ((old, -1), (new, 1)) if v is not None and v[0] is not None]
        if changes and not (old and old[:3] == new[:3]):
            yield pd.DataFrame(changes, columns=["entity", "day", "additions", "deletions", "rows"])

    keyed = rows.withWatermark("loaded", lateness).groupBy("commit_hash", "file")
    return keyed.applyInPandasWithState(latest, _CHANGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def activity_of(changes: DataFrame) -> DataFrame:
    """``file, day, additions, deletions`` of the valid rows, from all changes written so far; days without any are left out."""
    sums = changes.groupBy(F.col("entity").alias("file"), "day").agg(*[F.sum(c).alias(c) for c in ("additions", "deletions", "rows")])
    return sums.where(F.col("rows") > 0).select("file", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), "additions", "deletions")


def append_to(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends what is final to a folder, each row once."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
