"""Totals and averages over trailing periods, days without activity included.

Per entity and time shard a segment tree holds sums and counts. A shard's tree has its own days as leaves and, before
them, the days that the longest period can reach back to, so each date is answered inside one tree by O(log n) nodes. A
late correction changes one leaf and its ancestors. Leaves are aggregated before they travel, so an entity with a third of
all rows is a few hundred leaves per shard, and its shards are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.session import checkpointed

#: Leaves of one tree; a power of two.
LEAVES = 256
EPOCH = "1970-01-01"


class SegmentForest:
    """Segment trees of equal size side by side: ``nodes[tree, node]``, node 1 the root, the leaves from ``leaves`` on."""

    def __init__(self, leaf_values: np.ndarray):
        trees, self.leaves = leaf_values.shape
        if self.leaves & (self.leaves - 1):
            raise ValueError("the number of leaves must be a power of two")
        self.nodes = np.zeros((trees, 2 * self.leaves), dtype=leaf_values.dtype)
        self.nodes[:, self.leaves :] = leaf_values
        width = self.leaves
        while width > 1:
            level = self.nodes[:, width : 2 * width]
            self.nodes[:, width // 2 : width] = level[:, 0::2] + level[:, 1::2]
            width //= 2

    def correct(self, tree: np.ndarray, leaf: np.ndarray, delta: np.ndarray) -> int:
        """Add ``delta`` to the given leaves; only they and their ancestors change. Returns the nodes visited."""
        at, visited = np.asarray(leaf) + self.leaves, 0
        while len(at) and at[0] >= 1:
            np.add.at(self.nodes, (tree, at), delta)
            visited += len(at)
            at = at >> 1
            if at[0] == 0:
                break
        return visited

    def trailing(self, length: int, first: int) -> np.ndarray:
        """For each leaf from ``first`` on, the total of the ``length`` leaves that end with it, for all trees.

        The usual bottom-up walk, for all end positions at once: at each level the open left and right ends that are
        odd or even take their node and step inwards.
        """
        ends = np.arange(first, self.leaves)
        left, right = ends - length + 1 + self.leaves, ends + 1 + self.leaves
        if (left < self.leaves).any():
            raise ValueError("the period reaches back beyond the tree")
        out = np.zeros((len(self.nodes), len(ends)), dtype=self.nodes.dtype)
        live = left < right
        while live.any():
            take = live & (left & 1 == 1)
            out[:, take] += self.nodes[:, left[take]]
            left = np.where(take, left + 1, left)
            take = live & (right & 1 == 1)
            right = np.where(take, right - 1, right)
            out[:, take] += self.nodes[:, right[take]]
            left, right = left >> 1, right >> 1
            live = left < right
        return out


def epoch_day(ts: Column) -> Column:
    """Days since 1970-01-01 of the UTC day of ``ts``."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 86_400_000_000).cast("int")


def valid_rows(parts: DataFrame) -> DataFrame:
    """Per (commit_hash, file) the row loaded last: ``commit_hash, file, commit_time, additions, deletions``.

    Rows tied on ``loaded_at`` are identical; should they differ, any of them is taken. A null ``loaded_at`` loses
    against any other.
    """
    at = F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp_ntz").cast(parts.schema["loaded_at"].dataType))
    return parts.groupBy("commit_hash", "file").agg(
        *[F.max_by(c, at).alias(c) for c in ("commit_time", "additions", "deletions")]
    )


def daily_activity(parts: DataFrame) -> DataFrame:
    """``entity, day, additions, deletions`` per file and active day, ``day`` in days since 1970-01-01.

    Only the valid row of each (commit_hash, file) counts (:func:`valid_rows`); rows without file or commit_time are left
    out, null counts are 0. A null ``commit_hash`` is a commit of its own per file.
    """
    rows = valid_rows(parts.where(F.col("file").isNotNull())).where(F.col("commit_time").isNotNull())
    return rows.groupBy(F.col("file").alias("entity"), epoch_day(F.col("commit_time")).alias("day")).agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in ("additions", "deletions")]
    )


def _shards(
    daily: DataFrame, values: Sequence[str], reach: int, gaps: bool, least_active: int
) -> tuple[DataFrame, int]:
    """One row per entity and time shard: its first and last active day and its leaves, parents of the trees.

    ``reach`` days of a shard come again as the head of the next one.
    """
    own = LEAVES - reach
    day = F.col("day")
    shard = F.floor(day / own).cast("int")
    leaf = F.struct(day.alias("day"), *[F.col(v) for v in values])
    # a day in the last `reach` days of a shard is also a head day of the next
    homes = F.when(day >= (shard + 1) * own - reach, F.array(shard, shard + 1)).otherwise(F.array(shard))
    # Daily rows are few for any entity, so the entity is the key of the one shuffle that grouping and spans share.
    entity = Window.partitionBy("entity")
    grouped = (
        daily.repartition("entity")
        .select("entity", leaf.alias("leaf"), F.explode(homes).alias("shard"))
        .groupBy("entity", "shard")
        .agg(F.collect_list("leaf").alias("leaves"), F.min("leaf.day").alias("_lo"), F.max("leaf.day").alias("_hi"))
        .withColumns({"first_day": F.min("_lo").over(entity), "last_day": F.max("_hi").over(entity)})
        .where(F.col("shard") * own <= F.col("last_day"))
    )
    if least_active > 1:
        grouped = grouped.where(F.size("leaves") >= least_active)
    if gaps:
        until = F.coalesce(
            F.lead("shard").over(entity.orderBy("shard")) - 1, F.floor(F.col("last_day") / own).cast("int")
        )
        grouped = grouped.withColumn("_until", until).select(
            "entity",
            F.explode(F.sequence("shard", "_until")).alias("shard"),
            "first_day",
            "last_day",
            F.struct(F.col("shard").alias("of"), "leaves").alias("_leaves"),
        )
        grouped = grouped.withColumn("leaves", F.when(F.col("_leaves.of") == F.col("shard"), F.col("_leaves.leaves")))
    return grouped.select("entity", "shard", "first_day", "last_day", "leaves"), own


def rolling_totals(
    daily: DataFrame,
    values: Sequence[str],
    periods: Sequence[int] = (7, 30),
    from_day: int = 0,
    least_active: int = 0,
) -> DataFrame:
    """For each entity and each day from its first to its last active day the totals over the trailing periods.

    ``daily`` has one row per ``entity`` and active ``day`` (days since 1970-01-01) with whole-number ``values``. Rows go
    out as ``entity, day``, per period p ``<value>_<p>`` and ``active_days_<p>``. Days before the first active day count
    as days without activity. ``from_day`` starts that many days after the first active day instead; ``least_active``
    keeps the days whose longest period holds at least so many active days, and lets shards without them go before any
    tree is built.

    Defined cases: several rows of one entity and day add up; a null entity is an entity; rows with null ``day`` are
    left out; null values are 0; no rows give no rows; further columns are ignored.
    """
    longest = max(periods)
    reach = 32
    while reach < longest:
        reach *= 2
    if reach >= LEAVES:
        raise ValueError("a period is too long for the trees")
    daily = daily.where(F.col("day").isNotNull()).select(
        "entity", "day", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values]
    )
    shards, own = _shards(daily, values, reach, gaps=least_active < 1, least_active=least_active)
    names = [f"{v}_{p}" for p in periods for v in (*values, "active_days")]
    types = {f.name: f.dataType.simpleString() for f in shards.schema.fields}
    schema = f"entity {types['entity']}, day int, " + ", ".join(f"{n} long" for n in names)
    columns = list(values)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n = batch.num_rows
                lists = batch.column("leaves")
                leaves = lists.flatten()
                tree = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                start = batch.column("shard").to_numpy().astype(np.int64) * own - reach
                leaf = leaves.field("day").to_numpy().astype(np.int64) - start[tree]

                def forest(amounts: np.ndarray | int, n=n, tree=tree, leaf=leaf) -> SegmentForest:
                    base = np.zeros((n, LEAVES), dtype=np.int64)
                    np.add.at(base, (tree, leaf), amounts)
                    return SegmentForest(base)

                # several rows of one day are one active day
                seen = np.zeros((n, LEAVES), dtype=np.int64)
                seen[tree, leaf] = 1
                forests = {"active_days": SegmentForest(seen)}
                days = start[:, None] + np.arange(reach, LEAVES)[None, :]
                first, last = (batch.column(c).to_numpy().astype(np.int64)[:, None] for c in ("first_day", "last_day"))
                keep = (days >= first + from_day) & (days <= last)
                if least_active > 0:
                    keep &= forests["active_days"].trailing(longest, reach) >= least_active
                rows, cols = np.nonzero(keep)
                if not len(rows):
                    continue
                forests |= {v: forest(leaves.field(v).to_numpy()) for v in columns}
                out = [batch.column("entity").take(pa.array(rows)), pa.array(days[rows, cols].astype(np.int32))]
                out += [
                    pa.array(forests[v].trailing(p, reach)[rows, cols]) for p in periods for v in (*columns, "active_days")
                ]
                yield pa.RecordBatch.from_arrays(out, ["entity", "day", *names])

    return shards.mapInArrow(answer, schema)


#: Name of the counts in a stored forest, beside the sums of the values.
ROWS = "rows"
#: Folders that a stored forest is parted into; a correction rewrites those that its trees are in.
FOLDERS = 256


def _own_and_shard(reach: int) -> tuple[int, Column]:
    own = LEAVES - reach
    return own, F.floor(F.col("day") / own).cast("int")


def _homes(reach: int) -> Column:
    """The shards that hold a day: its own, and the next one if it is in the head of that."""
    own, shard = _own_and_shard(reach)
    return F.when(F.col("day") >= (shard + 1) * own - reach, F.array(shard, shard + 1)).otherwise(F.array(shard))


def build_forest(daily: DataFrame, values: Sequence[str], reach: int = 32) -> DataFrame:
    """Trees as a table: ``entity, shard, value, nodes`` (node 1 the root, leaves from LEAVES on), to be written.

    ``daily`` has any number of rows per ``entity`` and ``day`` with whole-number ``values``. There is a tree of sums for each
    value and one of the numbers of rows (ROWS). Rows of one day add up before they travel; null values are 0, and rows
    with null ``day`` are left out.
    """
    return correct_forest(None, daily.withColumn(ROWS, F.lit(1)), values, reach)


def correct_forest(forest: DataFrame | None, corrections: DataFrame, values: Sequence[str], reach: int = 32) -> DataFrame:
    """The trees of ``forest`` that ``corrections`` change, after them: only corrected leaves and their ancestors differ.

    ``corrections`` has ``entity, day``, the differences of the ``values`` and of the number of rows (ROWS); those of one day add
    up before they travel. A correction for a shard without a tree plants one. The other trees are not touched, nor
    returned: the caller puts these in the place of the old ones (:func:`upsert_forest`).
    """
    own, _ = _own_and_shard(reach)
    names = [*values, ROWS]
    summed = (
        corrections.where(F.col("day").isNotNull())
        .groupBy("entity", F.col("day").cast("int").alias("day"))
        .agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long").alias(c) for c in names])
    )
    late = (
        summed.select("entity", F.explode(_homes(reach)).alias("shard"), F.struct("day", *names).alias("late"))
        .groupBy(F.col("entity").alias("l_entity"), F.col("shard").alias("l_shard"))
        .agg(F.collect_list("late").alias("late"))
        .select("*", F.explode(F.array(*[F.lit(c) for c in names])).alias("l_value"))
    )
    kind = corrections.schema["entity"].dataType.simpleString()
    if forest is None:
        met = late.withColumn("nodes", F.lit(None).cast("array<long>"))
    else:
        same = F.col("entity").eqNullSafe(F.col("l_entity")) & (F.col("shard") == F.col("l_shard")) & (F.col("value") == F.col("l_value"))
        met = late.join(forest.select("entity", "shard", "value", "nodes"), same, "left")
    met = met.select(F.col("l_entity").alias("entity"), F.col("l_shard").alias("shard"), F.col("l_value").alias("value"), "nodes", "late")

    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes = []
            for shard, value, old, late_ in zip(pdf["shard"], pdf["value"], pdf["nodes"], pdf["late"], strict=True):
                f = SegmentForest(np.zeros((1, LEAVES), dtype=np.int64))
                if old is not None:
                    f.nodes[0] = old
                leaf = np.array([x["day"] - (shard * own - reach) for x in late_])
                f.correct(np.zeros(len(leaf), dtype=int), leaf, np.array([x[value] for x in late_]))
                nodes.append(f.nodes[0])
            yield pd.DataFrame({"entity": pdf["entity"], "shard": pdf["shard"], "value": pdf["value"], "nodes": nodes})

    return met.mapInPandas(correct, f"entity {kind}, shard int, value string, nodes array<long>")


def trailing_totals(forest: DataFrame, queries: DataFrame, length: int, reach: int = 32) -> DataFrame:
    """``entity, day, value, total`` of the ``length`` days that end with each ``day`` of ``queries`` (``entity, day``).

    A range is answered by O(log n) nodes of one stored tree; without a tree it is 0 of each value that the forest has for no
    shard of the query, so such queries give no rows.
    """
    if length > reach:
        raise ValueError("the period reaches back beyond the heads of the trees")
    own, shard = _own_and_shard(reach)
    asked = queries.select(F.col("entity").alias("q_entity"), F.col("day").cast("int").alias("day"))
    met = asked.join(forest, F.col("q_entity").eqNullSafe(F.col("entity")) & (shard == F.col("shard"))).select("entity", "day", "shard", "value", "nodes")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            nodes = batch.column("nodes").flatten().to_numpy().reshape(n, 2 * LEAVES)
            end = batch.column("day").to_numpy().astype(np.int64) - (batch.column("shard").to_numpy().astype(np.int64) * own - reach)
            left, right = end - length + 1 + LEAVES, end + 1 + LEAVES
            total, rows = np.zeros(n, dtype=np.int64), np.arange(n)
            while (live := left < right).any():
                take = live & (left & 1 == 1)
                total[take] += nodes[rows[take], left[take]]
                left = np.where(take, left + 1, left)
                take = live & (right & 1 == 1)
                right = np.where(take, right - 1, right)
                total[take] += nodes[rows[take], right[take]]
                left, right = left >> 1, right >> 1
            cols = [batch.column("entity"), batch.column("day"), batch.column("value"), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, ["entity", "day", "value", "total"])

    kind = forest.schema["entity"].dataType.simpleString()
    return met.mapInArrow(answer, f"entity {kind}, day int, value string, total long")


def _folder() -> Column:
    return F.pmod(F.xxhash64("entity", "shard"), F.lit(FOLDERS)).cast("int")


def write_forest(forest: DataFrame, path: str) -> None:
    """The trees under ``path``, parted into FOLDERS folders."""
    forest.withColumn("folder", _folder()).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(path)


def upsert_forest(spark: SparkSession, path: str, corrections: DataFrame, values: Sequence[str], reach: int = 32) -> None:
    """Applies ``corrections`` to the trees written under ``path``; only folders with a corrected tree are read and written."""
    stored = spark.read.parquet(path)
    changed = checkpointed(correct_forest(stored, corrections, values, reach).withColumn("folder", _folder()))
    # at most FOLDERS numbers
    folders = [r["folder"] for r in changed.select("folder").distinct().collect()]
    if not folders:
        return
    key = ["entity", "shard", "value"]
    new = changed.select(*[F.col(c).alias(f"n_{c}") for c in key])
    same = F.col("entity").eqNullSafe(F.col("n_entity")) & (F.col("shard") == F.col("n_shard")) & (F.col("value") == F.col("n_value"))
    kept = stored.where(F.col("folder").isin(folders)).join(new, same, "left_anti")
    # read before its folders are replaced
    whole = checkpointed(kept.select(*key, "nodes", "folder").unionByName(changed.select(*key, "nodes", "folder")))
    whole.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def deliveries(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The daily rows of the first delivery of each (commit_hash, file), and the differences that the last one makes to them.

    Both have ``entity, day, additions, deletions``, the second also ROWS. Rows without file or commit_time are left out.
    """
    at = F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp_ntz").cast(parts.schema["loaded_at"].dataType))
    columns = ("commit_time", "additions", "deletions")
    both = checkpointed(
        parts.where(F.col("file").isNotNull())
        .groupBy("commit_hash", "file")
        .agg(*[F.min_by(c, at).alias(f"f_{c}") for c in columns], *[F.max_by(c, at).alias(f"l_{c}") for c in columns])
    )

    def side(p: str, sign: int) -> Column:
        amounts = [(sign * F.coalesce(F.col(f"{p}_{c}"), F.lit(0)).cast("long")).alias(c) for c in ("additions", "deletions")]
        return F.struct(epoch_day(F.col(f"{p}_commit_time")).alias("day"), *amounts, F.lit(sign).alias(ROWS))

    fields = [F.col("x")[c].alias(c) for c in ("day", "additions", "deletions", ROWS)]
    first = both.select(F.col("file").alias("entity"), side("f", 1).alias("x")).select("entity", *fields).drop(ROWS)
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(f"f_{c}").eqNullSafe(F.col(f"l_{c}"))
    late = both.where(differ).select(F.col("file").alias("entity"), F.explode(F.array(side("f", -1), side("l", 1))).alias("x")).select("entity", *fields)
    return first.where(F.col("day").isNotNull()), late.where(F.col("day").isNotNull())


def day_text(day: Column) -> Column:
    return F.date_format(F.date_add(F.lit(EPOCH).cast("date"), day), "yyyy-MM-dd")


def file_rolling(parts: DataFrame) -> DataFrame:
    """Per file and day, active or not, totals and daily averages of additions and deletions over 7 and 30 days."""
    out = rolling_totals(daily_activity(parts), ("additions", "deletions"))
    return out.select(
        F.col("entity").alias("file"),
        day_text(F.col("day")).alias("day"),
        *[f"{v}_{p}" for p in (7, 30) for v in ("additions", "deletions")],
        *[F.round(F.col(f"{v}_{p}") / p, 6).alias(f"{v}_avg_{p}") for p in (7, 30) for v in ("additions", "deletions")],
    )


def bursts(parts: DataFrame) -> DataFrame:
    """``file, day`` whose 30 days hold at least 5 active days and a churn of 200, four fifths of it in the last 7 days.

    Days count from 29 days after the file's first active day up to its last.
    """
    daily = daily_activity(parts).select("entity", "day", (F.col("additions") + F.col("deletions")).alias("churn"))
    out = rolling_totals(daily, ("churn",), from_day=29, least_active=5)
    return out.where(
        (F.col("active_days_30") >= 5) & (F.col("churn_30") >= 200) & (F.col("churn_7") * 5 >= F.col("churn_30") * 4)
    ).select(F.col("entity").alias("file"), day_text(F.col("day")).alias("day"))


def last_month(parts: DataFrame) -> DataFrame:
    """``file, day, additions_30, deletions_30, commits_30`` of the 30 days up to the last active day of each file.

    Trees are built of the first delivery of each commit, late deliveries correct them, and stored trees give the answers.
    """
    values = ("additions", "deletions")
    first, late = deliveries(parts)
    base = checkpointed(build_forest(first, values))
    changed = checkpointed(correct_forest(base, late, values))
    new = changed.select(*[F.col(c).alias(f"n_{c}") for c in ("entity", "shard", "value")])
    same = F.col("entity").eqNullSafe(F.col("n_entity")) & (F.col("shard") == F.col("n_shard")) & (F.col("value") == F.col("n_value"))
    forest = base.join(new, same, "left_anti").unionByName(changed)
    ends = daily_activity(parts).groupBy("entity").agg(F.max("day").alias("day"))
    total = lambda v: F.sum(F.when(F.col("value") == v, F.col("total"))).alias(f"{v}_30")
    out = trailing_totals(forest, ends, 30).groupBy("entity", "day").agg(total("additions"), total("deletions"), total(ROWS))
    return out.select(F.col("entity").alias("file"), day_text(F.col("day")).alias("day"), "additions_30", "deletions_30", F.col(f"{ROWS}_30").alias("commits_30"))
