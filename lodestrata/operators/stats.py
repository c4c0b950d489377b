"""Statistics of files rolled up to folders, components, repositories and the whole.

Numbers come as long records ``file, stat_type, value``. Each type has an accumulator, the sum unless another is
registered; what does not add up (distinct counts, averages over lines) has relations of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Accumulator = Callable[[Column], Column]

#: What a type is accumulated with. The argument is the value of the records of that type, null for others.
ACCUMULATORS: dict[str, Accumulator] = {
    "complexity__indentation__max": lambda v: F.greatest(F.max(v), F.lit(0.0)),
}
# Names of the measures.
LINES, INDENT_MAX, INDENT_AVG, INDENT_SUM = (
    "complexity__lines",
    "complexity__indentation__max",
    "complexity__indentation__avg",
    "complexity__indentation__count",
)


def sum_of(v: Column) -> Column:
    return F.sum(v)


def unique_count(v: Column) -> Column:
    return F.count_distinct(v)


def most_common(v: Column) -> Column:
    """The most frequent value, of several the smallest."""
    return F.mode(v, True)


def last_of(v: Column, order: Column) -> Column:
    return F.max_by(v, order)


def measure_records(measures: DataFrame) -> DataFrame:
    """File measures as long records; the sum of indentations goes as a type that starts with ``_`` and is not shown."""
    pairs = {LINES: "complexity__lines", INDENT_MAX: "indentation_max", f"_{INDENT_SUM}": "indentation_sum"}
    rows = F.array(*[F.struct(F.lit(k).alias("stat_type"), F.col(c).cast("double").alias("value")) for k, c in pairs.items()])
    return measures.select("file", F.explode(rows).alias("r")).select("file", "r.stat_type", "r.value")


def stat_types(records: DataFrame) -> list[str]:
    """The types that occur, in order: one small job, so that no pivot has to find them itself."""
    return sorted(r[0] for r in records.select("stat_type").distinct().collect())


def accumulated(records: DataFrame, keys: Sequence[str], types: Sequence[str] | None = None, accumulators: dict[str, Accumulator] | None = None) -> DataFrame:
    """One row per key with a column for each type, 0 where a key has none.

    One aggregate with a conditional for each type: map tasks send one partial row per key. The average indentation is the
    sum of indentations by the number of lines, so it is weighted by lines.
    """
    types = list(types if types is not None else stat_types(records))
    chosen = ACCUMULATORS | (accumulators or {})
    aggs = [
        F.coalesce(chosen.get(t, sum_of)(F.when(F.col("stat_type") == t, F.col("value"))), F.lit(0.0)).alias(t) for t in types
    ]
    out = records.groupBy(*keys).agg(*aggs) if aggs else records.select(*keys).distinct()
    hidden = f"_{INDENT_SUM}"
    if hidden in types and LINES in types:
        out = out.withColumn(INDENT_AVG, F.coalesce(F.try_divide(F.col(hidden), F.col(LINES)), F.lit(0.0)))
    whole = [t for t in types if not t.startswith("_") and t != INDENT_AVG]
    keep = sorted([c for c in out.columns if c not in keys and not c.startswith("_")])
    return out.select(*keys, *[F.col(c).cast("long").alias(c) if c in whole and _is_whole(c) else F.col(c) for c in keep])


def _is_whole(name: str) -> bool:
    return not name.endswith("__avg")


def with_unknown(view: DataFrame, name: str = "name") -> DataFrame:
    """The empty key shown as ``Unknown``."""
    return view.withColumn(name, F.when(F.coalesce(F.col(name), F.lit("")) == "", "Unknown").otherwise(F.col(name)))


def stats_by_group(records: DataFrame, members: DataFrame, group: str, types: Sequence[str] | None = None, accumulators: dict[str, Accumulator] | None = None) -> DataFrame:
    """``name``, the statistics of its files, and ``complexity__files``. ``members``: ``<group>, file``."""
    rows = records.join(members.select("file", F.col(group).alias("name")), "file")
    types = list(types if types is not None else stat_types(records))
    out = accumulated(rows, ["name"], types, accumulators)
    files = members.groupBy(F.col(group).alias("f_name")).agg(F.count_distinct("file").alias("complexity__files"))
    joined = files.join(out, F.col("f_name").eqNullSafe(F.col("name")), "left")
    stats = [c for c in out.columns if c != "name"]
    return joined.select(
        F.col("f_name").alias("name"),
        *[F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in stats],
        "complexity__files",
    )
