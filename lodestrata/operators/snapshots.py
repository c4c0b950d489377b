"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import checkpointed

#: Snapshots of which one row each is broadcast, at about a hundred bytes.
BROADCAST_ROWS = 100_000


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def without_dot_slash(c: Column) -> Column:
    """``c`` without a leading ``./``."""
    return F.regexp_replace(c, r"^\./", "")


def row_hash(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns; null and the column's place are part of them."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *reversed(marked))


def snapshot_changes(
    rows: DataFrame, series: str, snapshot: str, taken_at: str, keys: Sequence[str], compared: Sequence[str]
) -> DataFrame:
    """Rows added, removed or changed in each snapshot against the one before it in the same series.

    ``rows`` holds full snapshots: ``series`` names whose, ``snapshot`` which, ``taken_at`` when. A snapshot delivered
    more than once counts as its delivery with the latest ``taken_at``; snapshots of a series follow each other by that
    time (ties by name). ``keys`` identify a row inside a snapshot, ``compared`` are the columns whose difference is a
    change; both must be canonical already. Rows go out as ``series, snapshot, keys..., change``, where ``snapshot`` is
    the later one and ``change`` is ``added``, ``removed`` or ``changed``.

    A full outer join on the key meets each snapshot with its predecessor; a missing side is an addition or a removal,
    unequal hashes are a change. The join key holds the key of the row, so no series or snapshot is one task's work.

    Defined cases: the first snapshot gives nothing; rows with the last key column null are ignored, but a snapshot of
    such rows only is an empty snapshot; nulls in the other keys are values; repeated rows count once; several different
    rows of one key in one snapshot are compared as a set; rows with null ``taken_at`` are ignored; no rows give no rows.
    """
    src = rows.select(
        F.col(series).alias("_series"),
        F.col(snapshot).alias("_snap"),
        F.col(taken_at).alias("_at"),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(c).alias(f"_v{i}") for i, c in enumerate(compared)],
    ).where(F.col("_at").isNotNull())
    ks = [f"_k{i}" for i in range(len(keys))]
    order = Window.partitionBy("s_series").orderBy("s_at", "s_snap")
    snaps = (
        src.groupBy(F.col("_series").alias("s_series"), F.col("_snap").alias("s_snap"))
        .agg(F.max("_at").alias("s_at"))
        .select("*", F.row_number().over(order).alias("s_seq"), F.count(F.lit(1)).over(Window.partitionBy("s_series")).alias("s_last"))
    )
    # one row per snapshot; counted before it is broadcast, else joined by a shuffle
    snaps = checkpointed(snaps)
    known = F.broadcast(snaps) if snaps.count() <= BROADCAST_ROWS else snaps
    h1, h2 = row_hash([F.col(f"_v{i}") for i in range(len(compared))])
    valid = (
        src.where(F.col(ks[-1]).isNotNull())
        .join(
            known,
            F.col("_series").eqNullSafe(F.col("s_series"))
            & F.col("_snap").eqNullSafe(F.col("s_snap"))
            & (F.col("_at") == F.col("s_at")),
        )
        .select("_series", F.col("s_seq").alias("_seq"), F.col("s_last").alias("_last"), *ks, h1.alias("_h1"), h2.alias("_h2"))
    )
    # one row per key; the digest of several different rows depends neither on their order nor on repetition
    keyed = (
        valid.groupBy("_series", "_seq", "_last", *ks, "_h1", "_h2")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_series", "_seq", "_last", *ks)
        .agg(F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"), F.sum("_one").alias("_n"))
    )
    ds = ["_x1", "_x2", "_n"]
    later = keyed.where(F.col("_seq") > 1).select(*[F.col(c).alias(f"c{c}") for c in ("_series", "_seq", *ks, *ds)])
    before = keyed.where(F.col("_seq") < F.col("_last")).select(
        *[F.col(c).alias(f"p{c}") for c in ("_series", *ks, *ds)], (F.col("_seq") + 1).alias("p_seq")
    )
    met = F.col("c_seq") == F.col("p_seq")
    for c in ("_series", *ks):
        met = met & F.col(f"c{c}").eqNullSafe(F.col(f"p{c}"))
    same = F.lit(True)
    for c in ds:
        same = same & (F.col(f"c{c}") == F.col(f"p{c}"))
    change = F.when(F.col("p_seq").isNull(), "added").when(F.col("c_seq").isNull(), "removed").when(~same, "changed")

    def either(c: str) -> Column:
        return F.when(F.col("c_seq").isNull(), F.col(f"p{c}")).otherwise(F.col(f"c{c}"))

    found = (
        later.join(before, met, "full_outer")
        .withColumn("_change", change)
        .where(F.col("_change").isNotNull())
        .select(either("_series").alias("_series"), F.coalesce("c_seq", "p_seq").alias("_seq"), *[either(k).alias(k) for k in ks], "_change")
    )
    # the name of a snapshot only goes with the changes
    return found.join(known, F.col("_series").eqNullSafe(F.col("s_series")) & (F.col("_seq") == F.col("s_seq"))).select(
        F.col("_series").alias(series),
        F.col("s_snap").alias(snapshot),
        *[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)],
        F.col("_change").alias("change"),
    )


def canonical_view_rows(view_rows: DataFrame) -> DataFrame:
    """View rows as they are compared: names without a leading ``./``, ``''`` as null, averages at 6 decimals."""
    return view_rows.select(
        "database_name",
        "report_id",
        "scan_time",
        "view_name",
        blank_to_null(without_dot_slash(F.col("name"))).alias("name"),
        blank_to_null(F.col("directory")).alias("directory"),
        blank_to_null(F.col("component")).alias("component"),
        "complexity__lines",
        "complexity__indentation__max",
        F.round("complexity__indentation__avg", 6).alias("complexity__indentation__avg"),
        "modularity__types__total",
        "complexity__files",
    )


COMPARED = (
    "directory",
    "component",
    "complexity__lines",
    "complexity__indentation__max",
    "complexity__indentation__avg",
    "modularity__types__total",
    "complexity__files",
)


def report_changes(view_rows: DataFrame) -> DataFrame:
    """``database_name, report_id, view_name, name, change`` over the reports of each database; see :func:`snapshot_changes`."""
    return snapshot_changes(
        canonical_view_rows(view_rows), "database_name", "report_id", "scan_time", ("view_name", "name"), COMPARED
    )
