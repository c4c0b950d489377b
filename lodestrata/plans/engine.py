"""The engine: extensions register what is looked for and shown, an analysis holds the relations, views are its queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import metrics as M
from lodestrata.functions.text import directory_of, glob_to_regex, normal_path
from lodestrata.operators import extract, graph, history, linking, stats
from lodestrata.operators.packs import ABSTRACT, TYPES
from lodestrata.plans.definitions import DEFINITIONS

VERSION = "0.1"
View = Callable[["Analysis"], DataFrame]


class Extension:
    """What adds to an engine. Subclasses override :meth:`register`."""

    def register(self, engine: Engine) -> None:
        raise NotImplementedError


@dataclass
class PackExtension(Extension):
    """Looks for the patterns of a pack, built in by name or the caller's own."""

    pack: extract.Pack

    def register(self, engine: Engine) -> None:
        engine.packs.append(self.pack)


def snippets_extension(patterns: Sequence[str], glob: str = "**") -> PackExtension:
    """Patterns given by the caller, for all files."""
    return PackExtension(extract.Pack("custom", glob, tuple(patterns)))


@dataclass
class Engine:
    """Collects what extensions register; :meth:`analyze` binds it to files and a history."""

    spark: SparkSession
    extensions: Sequence[Extension] = ()
    spaces: int = 4
    based_on: dt.datetime | str | None = None
    buckets: Sequence[int] = history.BUCKETS
    packs: list[extract.Pack] = field(default_factory=list)
    accumulators: dict[str, stats.Accumulator] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    definitions: list[tuple[str, str, str, str]] = field(default_factory=lambda: list(DEFINITIONS))
    file_records: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    snippet_edits: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    record_edits: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.views |= BUILT_IN
        for e in self.extensions:
            e.register(self)

    def analyze(self, files: DataFrame, commit_parts: DataFrame | None = None, snippets: DataFrame | None = None) -> Analysis:
        """``files``: ``path, content``; ``commit_parts``: rows of the history; ``snippets`` if they are there already."""
        return Analysis(self, files, commit_parts, snippets)


@dataclass
class Analysis:
    """The relations of one code base, each made once, when a view first needs it."""

    engine: Engine
    files: DataFrame
    given_parts: DataFrame | None = None
    given_snippets: DataFrame | None = None

    @property
    def based_on(self) -> dt.datetime | str:
        if self.engine.based_on is None:
            self.engine.based_on = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return self.engine.based_on

    @cached_property
    def source(self) -> DataFrame:
        return self.files.withColumn("path", normal_path(F.col("path")))

    @cached_property
    def snippets(self) -> DataFrame:
        """Snippets with component and folder."""
        if self.given_snippets is not None:
            return self.given_snippets
        raw = extract.raw_snippets(self.source, self.engine.packs)
        for edit in self.engine.snippet_edits:
            raw = edit(raw)
        if "component" not in raw.columns:
            raw = linking.declared_components(raw)
            by_folder = [F.col("file").rlike(glob_to_regex(p.glob)) for p in self.engine.packs if p.by_directory]
            if by_folder:
                raw = raw.withColumn("component", F.when(reduce(or_, by_folder), directory_of(F.col("file"))).otherwise(F.col("component")))
        return extract.with_directory(raw).persist()

    @cached_property
    def records(self) -> DataFrame:
        """Long statistics of files: measures, counts of snippets, counts of language packs and of extensions."""
        rows = stats.measure_records(extract.file_measures(self.source, self.engine.spaces))
        rows = rows.unionByName(extract.snippet_counts(self.snippets)).unionByName(extract.language_stats(self.source, self.engine.packs))
        counted = [replace(p, only_stats=False) for p in self.engine.packs if p.only_stats]
        if counted:
            rows = rows.unionByName(extract.snippet_counts(extract.raw_snippets(self.source, counted)))
        for make in self.engine.file_records:
            rows = rows.unionByName(make(self.source))
        for edit in self.engine.record_edits:
            rows = edit(rows)
        return rows.persist()

    @cached_property
    def types(self) -> list[str]:
        return stats.stat_types(self.records)

    @cached_property
    def component_files(self) -> DataFrame:
        return linking.component_files(self.snippets)

    @cached_property
    def parts(self) -> DataFrame:
        """The history with the component of each file."""
        if self.given_parts is None:
            raise ValueError("this view needs a change history")
        return history.with_components(self.given_parts, self.component_files).persist()

    @cached_property
    def file_places(self) -> DataFrame:
        """``file, git__repository, git__age_in_days`` of every file: the repository above it, the days since its first change."""
        files = self.source.where(F.col("path").isNotNull()).select(F.col("path").alias("file")).distinct()
        ages = history.oldest_age(self.given_parts.where(F.col("file").isNotNull()), ["file"], self.based_on)
        places = history.repository_of(files, self.given_parts.where(F.col("repo").isNotNull()).select("repo"))
        return places.join(ages, "file", "left").select(
            "file", F.col("repo").alias("git__repository"), F.coalesce("git__age_in_days", F.lit(0)).cast("long").alias("git__age_in_days")
        )

    def with_history(self, view: DataFrame, members: DataFrame, key: str = "name") -> DataFrame:
        """``view`` with the statistics of the history of each row's files (``members``: ``key, file``), if there is a history.

        Commits, authors and files are counted once however many files of the row they touch; repository and age are those that
        most files have. Without a commit the counts are 0.
        """
        if self.given_parts is None:
            return view
        named = members.select(F.col(key).alias("h_key"), "file")
        what = ("additions", "deletions", "commits", "authors", "unique_file_changes")
        counts = history.commit_stats(self.given_parts.join(named, "file"), ["h_key"], self.based_on, self.engine.buckets, what)
        places = named.join(self.file_places, "file").groupBy(F.col("h_key").alias("p_key")).agg(
            *[F.mode(c, True).alias(c) for c in ("git__repository", "git__age_in_days")]
        )
        out = view.join(places, F.col(key).eqNullSafe(F.col("p_key")), "left").join(counts, F.col(key).eqNullSafe(F.col("h_key")), "left")
        numbers = ["git__age_in_days", *[c for c in counts.columns if c != "h_key"]]
        return out.select(*view.columns, "git__repository", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers])

    @cached_property
    def connections(self) -> DataFrame:
        return linking.connections(self.snippets).persist()

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct edges, each with its island, so every view that needs islands finds them."""
        return graph.islands(graph.distinct_edges(self.connections)).persist()

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.graph_nodes(self.edges, self.component_files.select(F.col("component").alias("name")))

    @cached_property
    def distances(self) -> DataFrame:
        return graph.distances(self.edges).persist()

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.shortest_cycles(self.edges).persist()

    def view(self, name: str, columns: Sequence[str] = (), sorted_by: str | None = None) -> DataFrame:
        """A view by name, optionally some of its columns, sorted by one of them, or the first."""
        if name not in self.engine.views:
            raise ValueError(f"there is no view {name!r}; there are {sorted(self.engine.views)}")
        df = self.engine.views[name](self)
        return project(sort_view(df, sorted_by), columns)

    def release(self) -> None:
        """Give up what is kept."""
        for name in ("snippets", "records", "parts", "connections", "edges", "distances", "cycles"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()


def sort_view(df: DataFrame, by: str | None = None) -> DataFrame:
    """Sorted by a column, else the first: text upwards, all else downwards, nulls last; ties by the other columns."""
    by = by or df.columns[0]
    if by not in df.columns:
        raise ValueError(f"there is no column {by!r}; there are {df.columns}")
    text = df.schema[by].dataType.typeName() == "string"
    first = F.col(by).asc_nulls_last() if text else F.col(by).desc_nulls_last()
    return df.orderBy(first, *[F.col(c).asc_nulls_last() for c in df.columns if c != by])


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Some columns, by names in any case; an unknown one is an error."""
    wanted = [c.strip().lower() for c in columns]
    if not wanted:
        return df
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"there are no columns {unknown}; there are {df.columns}")
    return df.select(*wanted)


def select_views(possible: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """The views to write: all, or those included, without those excluded (an included one stays); unknown ones are errors."""
    for name in [*include, *exclude]:
        if name not in possible:
            raise ValueError(f"there is no view {name!r}")
    if include:
        return [v for v in possible if v in include]
    return [v for v in possible if v not in exclude]


def summary(a: Analysis) -> DataFrame:
    """``name, value`` of the whole: every total, also those that other views hide, and the statistics of the history."""
    chosen = stats.ACCUMULATORS | a.engine.accumulators
    totals = [chosen.get(t, stats.sum_of)(F.when(F.col("stat_type") == t, F.col("value"))).alias(t) for t in a.types]
    row = a.records.agg(*totals) if totals else a.records.agg(F.count(F.lit(1)).alias("_none")).drop("_none")
    values = {t: row[t].cast("double") for t in row.columns}
    hidden = f"_{stats.INDENT_SUM}"
    if hidden in values and stats.LINES in values:
        values[stats.INDENT_AVG] = F.try_divide(values[hidden], values[stats.LINES])
    pairs = [F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(0.0)).alias("value")) for k, v in values.items()]
    out = row.select(F.explode(F.array(*pairs)).alias("p")).select("p.name", "p.value") if pairs else None
    counts = {
        "complexity__files": a.source,
        "component_count": a.component_files.select("component").distinct(),
        "connection_count": a.connections,
        "directory_count": linking.directory_files(a.snippets).select("directory").distinct(),
    }
    for name, df in counts.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    text = out.select("name", F.col("value").cast("string").alias("value"))
    if a.given_parts is not None:
        whole = a.engine.spark.createDataFrame([("whole",)], "name string")
        everything = a.source.where(F.col("path").isNotNull()).select(F.lit("whole").alias("name"), F.col("path").alias("file")).distinct()
        one = a.with_history(whole, everything)
        fields = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in one.columns if c != "name"]
        text = text.union(one.select(F.explode(F.array(*fields)).alias("p")).select("p.name", "p.value"))
    return text.union(a.engine.spark.createDataFrame([("version", VERSION)], "name string, value string"))


def files(a: Analysis) -> DataFrame:
    out = stats.accumulated(a.records, ["file"], a.types, a.engine.accumulators).withColumnRenamed("file", "name")
    known = a.component_files.select(F.col("file").alias("k_file"), "component").groupBy("k_file").agg(F.min("component").alias("component"))
    members = a.source.where(F.col("path").isNotNull()).select(F.col("path").alias("name"), F.col("path").alias("file")).distinct()
    out = a.with_history(out, members)
    return out.join(known, F.col("name") == F.col("k_file"), "left").select(
        *out.columns, directory_of(F.col("name")).alias("directory"), "component"
    )


def directories(a: Analysis) -> DataFrame:
    members = linking.directory_files(a.snippets)
    out = stats.stats_by_group(a.records, members, "directory", a.types, a.engine.accumulators)
    return a.with_history(out, members.withColumnRenamed("directory", "name"))


def snippets(a: Analysis) -> DataFrame:
    return a.snippets.select("content", "file", "component", "snippet_type", "begin_position", "end_position")


def definitions(a: Analysis) -> DataFrame:
    return a.engine.spark.createDataFrame(a.engine.definitions, "id string, name string, short string, long string")


def components(a: Analysis) -> DataFrame:
    base = stats.stats_by_group(a.records, a.component_files, "component", a.types, a.engine.accumulators)
    base = stats.with_unknown(a.with_history(base, a.component_files.withColumnRenamed("component", "name")))
    return component_metrics(base, a.connections, a.edges, a.distances, a.cycles, a.nodes)


def component_metrics(base: DataFrame, conn: DataFrame, edges: DataFrame, dist: DataFrame, cycles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``base`` (column ``name``, counts of types) with the metrics of the whole graph; what is not asked for is not computed."""
    out = base
    sides = [
        graph.couplings(conn),
        graph.cycles_per_component(cycles),
        graph.betweenness(edges),
        graph.ranks(edges, nodes),
        graph.closeness(dist),
    ]
    for side in sides:
        out = out.join(side, "name", "left")
    for m in graph.METRICS:
        out = out.withColumn(m, F.coalesce(F.col(m), F.lit(0).cast(out.schema[m].dataType)))
    for c in (ABSTRACT, TYPES):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0).cast("long"))
    i = M.instability(F.col("modularity__coupling__afferent"), F.col("modularity__coupling__efferent"))
    return (
        out.withColumn("modularity__abstractness", M.abstractness(F.col(ABSTRACT), F.col(TYPES)))
        .withColumn("modularity__instability", i)
        .withColumn(
            "modularity__distance_main_sequence",
            M.distance_main_sequence(F.col("modularity__abstractness"), F.col("modularity__instability")),
        )
    )


def strong_groups(a: Analysis) -> DataFrame:
    members = graph.strong_groups(a.edges, a.nodes)
    return graph.group_metrics(a.connections, members, "group", "group__")


def communities(a: Analysis) -> DataFrame:
    return graph.group_metrics(a.connections, graph.communities(a.edges), "community_nr", "community__")


def shared(key: str) -> View:
    def view(a: Analysis) -> DataFrame:
        return history.shared_commits(a.parts.where(F.col(key) != ""), key, a.based_on, a.engine.buckets)

    return view


BUILT_IN: dict[str, View] = {
    "definitions": definitions,
    "summary": summary,
    "files": files,
    "directories": directories,
    "snippets": snippets,
    "components": components,
    "component_connections_direct": lambda a: linking.direct_connections(a.connections),
    "component_connections_indirect": lambda a: graph.indirect_connections(a.edges),
    "component_connections_furthest": lambda a: graph.furthest_connections(a.edges),
    "component_cycles_shortest": lambda a: graph.cycle_rows(a.cycles),
    "component_strongly_connected_groups": strong_groups,
    "component_communities": communities,
    "component_cycles_elementary": lambda a: graph.cycle_neighbours(graph.elementary_cycles(a.edges)),
    "component_cycles_largest": lambda a: graph.largest_cycle(graph.elementary_cycles(a.edges)),
    "git_authors": lambda a: history.authors(a.parts, a.based_on, a.engine.buckets),
    "git_repos": lambda a: history.repositories(a.parts, a.based_on, a.engine.buckets),
    "git_commits": lambda a: history.commits(a.parts),
    "git_component_shared_commits": shared("component"),
    "git_directory_shared_commits": shared("directory"),
    "git_file_shared_commits": shared("file"),
    "git_component_cycles_shortest_shared_commits": lambda a: history.cycle_shared_commits(a.cycles, a.parts, a.based_on, a.engine.buckets),
}
