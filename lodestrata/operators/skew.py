"""Per-key results where a few keys hold most rows.

Every aggregate here is algebraic, so Spark keeps a bounded hash table of key states per map task (falling back to sorted
runs when it is full) and shuffles one compact state per key and task. No task ever sees the rows of a hot key: however
many rows a key has, each map task sends at most one state of it. Distinct counts take two such steps, first per
(key, value), then per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpointed


def per_key_totals(
    rows: DataFrame, key: str, sums: Mapping[str, str] | None = None, distinct: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per key: ``key_value``, ``row_count``, and the asked sums and distinct counts.

    ``sums`` and ``distinct`` map an output name to a column of ``rows``.

    Defined cases: a null key is a key of its own (``key_value`` null), as is ``''``; null values add 0 to a sum and
    nothing to a distinct count; repeated rows count as often as they are given; no rows give no rows; other columns of
    ``rows``, whatever their names, are not read.
    """
    sums, distinct = dict(sums or {}), dict(distinct or {})
    totals = [F.count(F.lit(1)).alias("row_count")]
    totals += [F.coalesce(F.sum(rows[c].cast("long")), F.lit(0).cast("long")).alias(name) for name, c in sums.items()]
    if not distinct:
        return rows.groupBy(rows[key].alias("key_value")).agg(*totals)
    # Several distinct counts in one aggregate would expand every input row; one count needs no expansion.
    if len(distinct) == 1:
        ((name, c),) = distinct.items()
        return rows.groupBy(rows[key].alias("key_value")).agg(*totals, F.count_distinct(rows[c]).alias(name))
    out = rows.groupBy(rows[key].alias("key_value")).agg(*totals)
    for name, c in distinct.items():
        counts = rows.groupBy(rows[key].alias("_k")).agg(F.count_distinct(rows[c]).alias(name))
        out = out.join(counts, out["key_value"].eqNullSafe(counts["_k"]), "left").drop("_k")
    return out


def heavy_keys(rows: DataFrame, key: str, percent: int = 2) -> DataFrame:
    """``key_value, row_count`` of the keys that hold at least ``percent`` % of all rows.

    Null and ``''`` are no keys, but their rows count in the total. The total is the sum over the compact per-key counts,
    not a second pass over the rows. No rows give no keys. ``percent`` is a whole number, so the test is exact.
    """
    counts = checkpointed(per_key_totals(rows, key))  # compact, and read twice
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.where(
        F.col("key_value").isNotNull()
        & (F.col("key_value") != "")
        & (F.col("row_count") * 100 >= F.lit(percent) * total)
    )


def tagged(rows: DataFrame, table_name: str, field_name: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the names of their table and field in front."""
    return rows.select(F.lit(table_name).alias("table_name"), F.lit(field_name).alias("field_name"), *columns)
