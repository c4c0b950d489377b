"""Statistics of the change history: authors, commits, repositories, and what changes together."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.metrics import age_in_days, percentage
from lodestrata.functions.text import ancestors, directory_of
from lodestrata.session import checkpointed

#: Days of the buckets; a commit is in every bucket at least as long as its age.
BUCKETS = (30, 90, 180)
#: Keys of one commit that are paired in one task; of more, the task's share is that many by all of them.
TOGETHER = 2000


def reference_time(based_on: dt.datetime | str) -> Column:
    return F.lit(str(based_on)).cast("timestamp")


def latest_parts(parts: DataFrame) -> DataFrame:
    """One row per (commit_hash, file): the one loaded last; rows tied on that are identical. Parts without file stay."""
    w = Window.partitionBy("commit_hash", "file").orderBy(F.col("loaded_at").desc_nulls_last())
    return parts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_age(parts: DataFrame, based_on: dt.datetime | str) -> DataFrame:
    return parts.withColumn("age", age_in_days(reference_time(based_on), F.col("commit_time").cast("timestamp")))


def day_stat(name: str, days: int | None) -> str:
    return f"{name}__total" if days is None else f"{name}__last_{days}_days"


def _inside(value: Column, days: int | None) -> Column:
    return value if days is None else F.when(F.col("age") <= days, value)


def commit_stats(parts: DataFrame, keys: Sequence[str], based_on: dt.datetime | str, buckets: Sequence[int] = BUCKETS, what: Sequence[str] = ("commits", "additions", "deletions", "unique_file_changes", "unique_component_changes", "authors")) -> DataFrame:
    """Totals of ``parts`` per key, and the same over the parts of each bucket of days.

    Additions and deletions are sums, everything else distinct counts of the parts themselves, which never add up over
    files. Null counts add 0; a part without time is in no bucket.
    """
    columns = {"commits": "commit_hash", "unique_file_changes": "file", "unique_component_changes": "component", "authors": "author"}
    days = (None, *buckets)
    counted, summed = [w for w in what if w in columns], [w for w in what if w not in columns]
    # One row per thing to count, and one that carries the sums. A first aggregate keeps each different value once with its
    # smallest age, which decides the buckets it is in; a second counts. Nothing is multiplied by the buckets.
    kinds = [F.struct(F.lit(w).alias("kind"), F.col(columns[w]).cast("string").alias("value")) for w in counted]
    kinds.append(F.struct(F.lit("").alias("kind"), F.lit(None).cast("string").alias("value")))
    rows = with_age(parts, based_on).select(*keys, "age", *[F.col(w).cast("long").alias(w) for w in summed], F.explode(F.array(*kinds)).alias("x"))
    amount = lambda w, d: F.sum(F.when(F.col("x.kind") == "", _inside(F.col(w), d)))
    once = (
        rows.where((F.col("x.kind") == "") | F.col("x.value").isNotNull())
        .groupBy(*keys, F.col("x.kind").alias("kind"), F.col("x.value").alias("value"))
        .agg(F.min("age").alias("age"), *[amount(w, d).alias(f"_{w}_{d}") for w in summed for d in days])
    )
    aggs = []
    for d in days:
        for w in what:
            if w in columns:
                e = F.count(F.when(F.col("kind") == w, _inside(F.lit(1), d)))
            else:
                e = F.coalesce(F.sum(f"_{w}_{d}"), F.lit(0).cast("long"))
            aggs.append(e.alias(day_stat(f"git__{w}", d)))
    return once.groupBy(*keys).agg(*aggs)


def oldest_age(parts: DataFrame, keys: Sequence[str], based_on: dt.datetime | str) -> DataFrame:
    """Days since the first change of each key: ``git__age_in_days``."""
    return with_age(parts, based_on).groupBy(*keys).agg(F.max("age").alias("git__age_in_days"))


def authors(parts: DataFrame, based_on: dt.datetime | str, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """Per author name the address of the latest part, totals and buckets."""
    stats = commit_stats(parts, ["author"], based_on, buckets, ("commits", "additions", "deletions", "unique_file_changes", "unique_component_changes"))
    order = F.struct("commit_time", "commit_hash", "file")
    mail = parts.groupBy(F.col("author").alias("m_author")).agg(F.max_by("author_email", order).alias("author_email"))
    out = stats.join(mail, F.col("author").eqNullSafe(F.col("m_author")))
    return out.select(F.col("author").alias("author_name"), "author_email", *[c for c in stats.columns if c != "author"])


def commits(parts: DataFrame) -> DataFrame:
    """The flat list of parts of commits."""
    return parts.select(
        "file",
        "component",
        F.col("repo").alias("repository"),
        "commit_hash",
        "commit_time",
        F.col("author").alias("author_name"),
        "author_email",
        F.col("message").alias("commit_message"),
        F.col("additions").alias("file_additions"),
        F.col("deletions").alias("file_deletions"),
    )


def file_stats(parts: DataFrame, based_on: dt.datetime | str, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """Per file: repository, age, and additions, deletions, commits and authors in total and by bucket."""
    rows = parts.where(F.col("file").isNotNull())
    stats = commit_stats(rows, ["file"], based_on, buckets, ("additions", "deletions", "commits", "authors", "unique_file_changes"))
    more = with_age(rows, based_on).groupBy(F.col("file").alias("m_file")).agg(
        F.mode("repo", True).alias("git__repository"), F.max("age").alias("git__age_in_days")
    )
    return stats.join(more, F.col("file") == F.col("m_file")).drop("m_file")


def common_repository(stats: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """The repository and age that most files of a group have, of several the smallest."""
    return (
        stats.join(members, "file")
        .groupBy(F.col(group).alias("name"))
        .agg(F.mode("git__repository", True).alias("git__repository"), F.mode("git__age_in_days", True).alias("git__age_in_days"))
    )


def repository_of(files: DataFrame, repos: DataFrame) -> DataFrame:
    """``file, repo``: the first of ``repos`` (``repo``, in text order) that is a folder above the file, else ``''``.

    The folders above a file are met with the repositories by equality, so no file is compared with every repository.
    """
    above = files.select("file", F.explode_outer(ancestors(directory_of(F.col("file")))).alias("repo"))
    hit = above.join(repos.select("repo").distinct(), "repo").groupBy(F.col("file").alias("h_file")).agg(F.min("repo").alias("repo"))
    return files.select("file").distinct().join(hit, F.col("file") == F.col("h_file"), "left").select("file", F.coalesce("repo", F.lit("")).alias("repo"))


def repositories(parts: DataFrame, based_on: dt.datetime | str, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """``name`` and the statistics of each repository; the empty name is ``Unknown``."""
    what = ("additions", "deletions", "commits", "authors", "unique_file_changes")
    out = commit_stats(parts, ["repo"], based_on, buckets, what)
    return out.select(F.when(F.coalesce("repo", F.lit("")) == "", "Unknown").otherwise(F.col("repo")).alias("name"), *[c for c in out.columns if c != "repo"])


def with_components(parts: DataFrame, file_components: DataFrame) -> DataFrame:
    """``parts`` with the component of their file, ``''`` for files without one."""
    known = file_components.select(F.col("file").alias("k_file"), F.col("component").alias("k_component"))
    return parts.drop("component").join(known, F.col("file") == F.col("k_file"), "left").withColumn("component", F.coalesce("k_component", F.lit(""))).drop("k_file", "k_component")


def shared_commits(parts: DataFrame, key: str, based_on: dt.datetime | str, buckets: Sequence[int] = BUCKETS, keys: DataFrame | None = None) -> DataFrame:
    """Pairs of keys that are changed by the same commits, both ways round.

    ``pair_1, pair_2, shared_commits``, the percentages of each one's commits, and the same by bucket; a percentage of
    nothing is null. ``keys`` (column ``key``) limits which keys are paired. Null keys are not. Each commit and key is one
    row before the join; the counts of a pair are summed in the map tasks. A commit of more than TOGETHER keys is parted: its
    keys meet in as many tasks as it has parts, each pair in one of them.
    """
    rows = with_age(parts.where(F.col(key).isNotNull() & F.col("commit_hash").isNotNull()), based_on)
    rows = rows.groupBy(F.col(key).alias("key"), "commit_hash").agg(F.min("age").alias("age"))
    if keys is not None:
        rows = rows.join(keys.select("key").distinct(), "key", "left_semi")
    days = (None, *buckets)

    def tally(name: str) -> list[Column]:
        return [F.count(_inside(F.lit(1), d)).alias(f"{name}_{d or 'all'}") for d in days]

    def paired(a: DataFrame, b: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
        a = a.select(F.col("key").alias("a"), "commit_hash", "age", *parts)
        b = b.select(F.col("key").alias("b"), F.col("commit_hash").alias("b_commit"), *[F.col(c).alias(f"b_{c}") for c in parts])
        met = (F.col("commit_hash") == F.col("b_commit")) & (F.col("a") < F.col("b"))
        for c in parts:
            met = met & (F.col(c) == F.col(f"b_{c}"))
        return a.join(b, met).select("a", "b", "age")

    large = rows.groupBy("commit_hash").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts")).where(F.col("parts") > 1)
    large = checkpointed(large)
    if large.isEmpty():
        pairs = paired(rows, rows)
    else:
        small, parted = rows.join(large, "commit_hash", "left_anti"), rows.join(large, "commit_hash")
        left = parted.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        right = parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = paired(small, small).unionByName(paired(left, right, ["part"]))
    pairs = pairs.groupBy("a", "b").agg(*tally("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in pairs.columns if c not in "ab"]))
    totals = rows.groupBy("key").agg(*tally("t"))
    t1 = totals.select(F.col("key").alias("a"), *[F.col(f"t_{d or 'all'}").alias(f"t1_{d or 'all'}") for d in days])
    t2 = totals.select(F.col("key").alias("b"), *[F.col(f"t_{d or 'all'}").alias(f"t2_{d or 'all'}") for d in days])
    out = both.join(t1, "a").join(t2, "b")
    cols = [F.col("a").alias("pair_1"), F.col("b").alias("pair_2")]
    for d in days:
        k, tail = d or "all", "" if d is None else f"__last_{d}_days"
        cols += [
            F.col(f"n_{k}").alias(f"shared_commits{tail}"),
            percentage(F.col(f"n_{k}"), F.col(f"t1_{k}")).alias(f"percentage_of_all_commits_pair_1{tail}"),
            percentage(F.col(f"n_{k}"), F.col(f"t2_{k}")).alias(f"percentage_of_all_commits_pair_2{tail}"),
        ]
    return out.select(*cols)


def cycle_shared_commits(cycles: DataFrame, parts: DataFrame, based_on: dt.datetime | str, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """``cycle, cycle_size, shared_commits`` and by bucket: commits that touch all members; 0 if a member has none."""
    rows = with_age(parts.where(F.col("component").isNotNull()), based_on).groupBy("component", "commit_hash").agg(F.min("age").alias("age"))
    members = cycles.select("cycle", F.size("members").alias("cycle_size"), F.explode("members").alias("component"))
    full = (
        members.join(rows, "component")
        .groupBy("cycle", "cycle_size", "commit_hash")
        .agg(F.count(F.lit(1)).alias("hit"), F.min("age").alias("age"))
        .where(F.col("hit") == F.col("cycle_size"))
    )
    tally = full.groupBy(F.col("cycle").alias("t_cycle")).agg(
        *[F.count(_inside(F.lit(1), d)).alias("shared_commits" if d is None else f"shared_commits__last_{d}_days") for d in (None, *buckets)]
    )
    out = cycles.select("cycle", F.size("members").cast("long").alias("cycle_size")).join(tally, F.col("cycle") == F.col("t_cycle"), "left")
    return out.select("cycle", "cycle_size", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in tally.columns if c != "t_cycle"])
