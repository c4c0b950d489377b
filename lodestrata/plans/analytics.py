"""Queries of the code-base operators over the test tables, and the SQL they must equal.

``snippets``, ``source_files`` and ``commit_parts`` are the engine's own relations. Ages count from ``BASED_ON``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import metrics as M
from lodestrata.functions.text import ancestors, directory_of
from lodestrata.operators import extract, graph, history, linking, stats
from lodestrata.operators.packs import ABSTRACT, DECLARATIONS, IMPORTS, JAVA_IGNORED, TYPES
from lodestrata.plans import engine
from lodestrata.sources import filetree, gitlog
from lodestrata.sources.tables import table

BASED_ON = "2025-01-01 00:00:00"


def _snippets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "snippets")


def _conn(s: SparkSession, d: str) -> DataFrame:
    return linking.connections(_snippets(s, d))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(_conn(s, d))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    named = _snippets(s, d).where(F.col("component").isNotNull()).select(F.col("component").alias("name")).distinct()
    return graph.graph_nodes(_edges(s, d), named)


def _parts(s: SparkSession, d: str) -> DataFrame:
    return history.latest_parts(table(s, d, "commit_parts"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()])


def conn_direct(s, d):
    return linking.direct_connections(_conn(s, d))


def conn_edges_distinct(s, d):
    return _edges(s, d)


def couplings(s, d):
    return graph.couplings(_conn(s, d))


def instability_distance(s, d):
    types = _snippets(s, d).where(F.col("component").isNotNull()).groupBy(F.col("component").alias("name")).agg(
        F.count(F.when(F.col("snippet_type") == ABSTRACT, 1)).alias("abstract"), F.count(F.when(F.col("snippet_type") == TYPES, 1)).alias("total")
    )
    c = types.join(graph.couplings(_conn(s, d)), "name", "left")
    zero = F.lit(0).cast("long")
    a = M.abstractness(F.col("abstract"), F.col("total"))
    i = M.instability(F.coalesce("modularity__coupling__afferent", zero), F.coalesce("modularity__coupling__efferent", zero))
    return _rounded(c.select("name", a.alias("abstractness"), i.alias("instability"), M.distance_main_sequence(a, i).alias("distance")))


def predecessors_direct(s, d):
    return graph.predecessors(_edges(s, d))


def successors_direct(s, d):
    return graph.successors(_edges(s, d))


def dist_all_pairs(s, d):
    return graph.distances(_edges(s, d))


def dist_by_level(s, d):
    return graph.distances_by_level(_edges(s, d))


def reachability_all(s, d):
    return graph.reachable(graph.distances(_edges(s, d)))


def indirect_paths(s, d):
    return graph.indirect_connections(_edges(s, d))


def furthest(s, d):
    return graph.furthest_connections(_edges(s, d))


def scc(s, d):
    return graph.strong_groups(_edges(s, d), _nodes(s, d))


def shortest_cycles(s, d):
    return graph.cycle_rows(graph.shortest_cycles(_edges(s, d)))


def cycles_per_component(s, d):
    return _rounded(graph.cycles_per_component(graph.shortest_cycles(_edges(s, d))))


def elementary_cycles(s, d):
    return graph.cycle_neighbours(graph.elementary_cycles(_edges(s, d)))


def largest_cycle(s, d):
    return graph.largest_cycle(graph.elementary_cycles(_edges(s, d)))


def closeness(s, d):
    return _rounded(graph.closeness(graph.distances(_edges(s, d))))


def betweenness(s, d):
    return _rounded(graph.betweenness(_edges(s, d)))


def pagerank_20(s, d):
    return _rounded(graph.page_rank(_edges(s, d), _nodes(s, d)))


def hits_20(s, d):
    return _rounded(graph.hits(_edges(s, d), _nodes(s, d)))


def communities(s, d):
    return graph.communities(_edges(s, d))


def scc_group_metrics(s, d):
    members = graph.strong_groups(_edges(s, d), _nodes(s, d))
    return _rounded(graph.group_metrics(_conn(s, d), members, "group", "group__"))


def scc_group_couplings(s, d):
    out = scc_group_metrics(s, d)
    names = ["afferent", "efferent", "dependents", "dependencies"]
    return out.select("component", "group", "group_size", *[f"group__modularity__coupling__{c}" for c in names])


def scc_group_core(s, d):
    """The metrics inside the groups without what only converges (PageRank, HITS)."""
    out = scc_group_metrics(s, d)
    return out.drop(*[f"group__graph__{c}" for c in ("page_rank", "hits__hub_score", "hits__authority_score")])


def community_metrics(s, d):
    return _rounded(graph.group_metrics(_conn(s, d), graph.communities(_edges(s, d)), "community_nr", "community__"))


def _measures(s, d):
    return extract.file_measures(table(s, d, "source_files"))


def file_lines(s, d):
    return _measures(s, d).select("file", "complexity__lines")


def indentation(s, d):
    m = _measures(s, d)
    return _rounded(m.select("file", "indentation_max", (F.col("indentation_sum") / F.col("complexity__lines")).alias("indentation_avg")))


def _records(s, d):
    return stats.measure_records(_measures(s, d)).unionByName(extract.snippet_counts(_snippets(s, d)))


FIXED_TYPES = ["_complexity__indentation__count", "complexity__indentation__max", "complexity__lines", DECLARATIONS, IMPORTS, ABSTRACT, TYPES]


def file_stats_pivot(s, d):
    return _rounded(stats.accumulated(_records(s, d), ["file"], FIXED_TYPES))


def component_stats(s, d):
    return _rounded(stats.with_unknown(stats.stats_by_group(_records(s, d), linking.component_files(_snippets(s, d)), "component", FIXED_TYPES)))


def dir_rollup(s, d):
    return _rounded(stats.stats_by_group(_records(s, d), linking.directory_files(_snippets(s, d)), "directory", FIXED_TYPES))


def _analysis(s, d):
    e = engine.Engine(s, based_on=BASED_ON)
    return e.analyze(table(s, d, "source_files"), _parts(s, d), _snippets(s, d))


def summary(s, d):
    out = _analysis(s, d).view("summary").where(~F.col("name").isin("version", "git__repository"))
    return _rounded(out.select("name", F.col("value").cast("double").alias("value")))


def files_view(s, d):
    return _rounded(_analysis(s, d).view("files"))


def directories_view(s, d):
    return _rounded(_analysis(s, d).view("directories"))


def components_git(s, d):
    """The statistics of the history in the components view."""
    a = _analysis(s, d)
    base = a.component_files.select(F.col("component").alias("name")).distinct()
    return stats.with_unknown(a.with_history(base, a.component_files.withColumnRenamed("component", "name")))


def only_stats_counts(s, d):
    """Counts of a pack that keeps no snippets."""
    pack = extract.Pack("words", "**.java", (r"class (?P<classes>\w+)", r"(?P<todos>TODO)"), only_stats=True)
    e = engine.Engine(s, [engine.PackExtension(pack)], based_on=BASED_ON)
    a = e.analyze(table(s, d, "source_files"))
    return a.records.where(F.col("stat_type").isin("classes", "todos")).select("file", "stat_type", F.col("value").cast("long").alias("value"))


def edge_predicates(s, d):
    """Which neighbours at any distance of up to two are joined by an edge, this way or either way."""
    e = _edges(s, d)
    second = e.select(F.col("from").alias("mid"), F.col("to").alias("end"))
    two = e.join(second, e["to"] == second["mid"]).select("from", F.col("end").alias("to"))
    return graph.has_edges(e, e.unionByName(two).distinct())


def snippets_view(s, d):
    ends = [F.col(f"{e}_position.{f}").alias(f"{e}_{f}") for e in ("begin", "end") for f in ("offset", "line", "char_in_line")]
    return _analysis(s, d).view("snippets").select("content", "file", "component", "snippet_type", *ends)


def components_view(s, d):
    return _rounded(_analysis(s, d).view("components"))


def components_core(s, d):
    """The components view without what only converges (PageRank, HITS) and without the history (components_git)."""
    out = _analysis(s, d).view("components")
    out = out.drop("graph__page_rank", "graph__hits__hub_score", "graph__hits__authority_score")
    return _rounded(out.drop(*[c for c in out.columns if c.startswith("git__")]))


def definitions(s, d):
    return _analysis(s, d).view("definitions")


def _packs():
    return [extract.builtin_pack(n) for n in ("kotlin", "scala", "php", "java", "csharp")]


def snippets_regex(s, d):
    """Declarations of Kotlin, Scala and PHP with their places."""
    rows = extract.raw_snippets(table(s, d, "source_files"), _packs()[:3]).where(F.col("snippet_type") == DECLARATIONS)
    bare = F.rtrim(F.col("content"), F.lit("\r"))
    cut = F.length("content") - F.length(bare)  # the table's values end before a carriage return
    return rows.select(
        "file", bare.alias("content"), F.col("begin_position.offset").alias("begin"), (F.col("end_position.offset") - cut).alias("end"), F.col("begin_position.line").alias("line"),
    )


def _of_pack(name, kinds):
    """Declarations, imports and types of a pack with their places, in the files that declare a component."""

    def query(s, d):
        rows = extract.raw_snippets(table(s, d, "source_files"), [extract.builtin_pack(name)]).where(F.col("snippet_type").isin(*kinds))
        declared = rows.where(F.col("snippet_type") == DECLARATIONS).select("file").distinct()
        places = [F.col(f"{e}_position.{f}").alias(f"{e}_{f}") for e in ("begin", "end") for f in ("offset", "line", "char_in_line")]
        return rows.join(declared, "file", "left_semi").select("file", "snippet_type", "content", *places).distinct()

    return query


def snippets_all_packs(s, d):
    return extract.raw_snippets(table(s, d, "source_files"), _packs())


def language_stats(s, d):
    return extract.language_stats(table(s, d, "source_files"), _packs())


def declared_components(s, d):
    """Components by the first declaration, from rows stripped of theirs."""
    raw = _snippets(s, d).withColumn("pattern", F.lit(0)).drop("component", "directory")
    return linking.declared_components(raw).select("file", "component").distinct()


def directory_components(s, d):
    return linking.directory_components(_snippets(s, d)).select("file", "component").distinct()


def directory_closure(s, d):
    return linking.closed_directories(table(s, d, "source_files").select(directory_of(F.col("path")).alias("directory")))


def path_ancestors(s, d):
    f = table(s, d, "source_files")
    return f.select("path", F.size(ancestors(directory_of(F.col("path")))).cast("long").alias("depth"))


def authors_buckets(s, d):
    return history.authors(_parts(s, d), BASED_ON)


def commits_flat(s, d):
    return history.commits(_parts(s, d))


def repo_stats(s, d):
    return history.repositories(_parts(s, d), BASED_ON)


def git_file_stats(s, d):
    return history.file_stats(_parts(s, d), BASED_ON)


def oldest_age(s, d):
    return history.oldest_age(_parts(s, d), ["component"], BASED_ON)


def component_repository(s, d):
    return history.common_repository(history.file_stats(_parts(s, d), BASED_ON), linking.component_files(_snippets(s, d)), "component")


def repository_of_file(s, d):
    files = table(s, d, "source_files").select(F.col("path").alias("file"))
    return history.repository_of(files, table(s, d, "raw_commits").select("repo"))


def parts_with_components(s, d):
    parts = history.with_components(_parts(s, d), linking.component_files(_snippets(s, d)))
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def _shared(key):
    def query(s, d):
        parts = _parts(s, d).where(F.col(key) != "")
        return _rounded(history.shared_commits(parts, key, BASED_ON))

    return query


def cycle_shared_commits(s, d):
    return history.cycle_shared_commits(graph.shortest_cycles(_edges(s, d)), _parts(s, d), BASED_ON)


def git_log_parse(s, d):
    """The history written as a log and taken apart again."""
    p = _parts(s, d).where(F.col("file").isNotNull())  # a log has no other parts
    line = F.concat_ws("\t", F.coalesce(F.col("additions").cast("string"), F.lit("-")), F.coalesce(F.col("deletions").cast("string"), F.lit("-")), F.expr("substr(file, length(repo) + 2)"))
    blocks = p.groupBy("repo", "commit_hash").agg(
        F.min(F.unix_seconds(F.col("commit_time").cast("timestamp"))).cast("string").alias("t"), F.min("author").alias("a"), F.min("author_email").alias("e"),
        F.regexp_replace(F.min("message"), r"[\r\n]+", " ").alias("m"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"),
    )
    logs = blocks.select(
        "repo",
        F.concat(F.lit(gitlog.RECORD), F.concat_ws(gitlog.FIELD, *[F.coalesce(c, F.lit("")) for c in ("commit_hash", "t", "a", "e", "m")], F.concat(F.lit("\n"), "lines"))).alias("log"),
    )
    out = gitlog.commit_parts(gitlog.raw_commits(logs))
    return out.groupBy("repo").agg(
        F.count(F.lit(1)).alias("parts"), F.count_distinct("commit_hash").alias("commits"), F.count_distinct("file").alias("files"),
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.max(F.unix_seconds("commit_time")).alias("last"),
    )


RULES = ("*.md", "/orbit-platform/build/", "!orbit-platform/build/deps.lock", "vendor/", "**/generated-*/**", "web/*.css")


def ignore_filter(s, d):
    rules = [r for x in RULES if (r := filetree.rule(x))]
    return table(s, d, "source_files").where(~filetree.ignored(F.col("path"), rules)).select("path")


def sort_view(s, d):
    return engine.sort_view(conn_direct(s, d), "reference_count")


def view_projection(s, d):
    return engine.project(conn_direct(s, d), ["From", " to "]).distinct()


def mode_repo(s, d):
    p = _parts(s, d)
    return p.where(F.col("author").isNotNull()).groupBy("author").agg(F.mode("repo", True).alias("repo"))


QUERIES = {
    f.__name__: f
    for f in (
        conn_direct, conn_edges_distinct, couplings, instability_distance, predecessors_direct, successors_direct, dist_all_pairs,
        dist_by_level, reachability_all, indirect_paths, furthest, scc, shortest_cycles, cycles_per_component, elementary_cycles,
        largest_cycle, closeness, betweenness, pagerank_20, hits_20, communities, scc_group_metrics, scc_group_core, scc_group_couplings, community_metrics,
        file_lines, indentation, file_stats_pivot, component_stats, dir_rollup, summary, files_view, directories_view, components_git, only_stats_counts, edge_predicates, snippets_view, components_view, components_core, definitions,
        snippets_regex, snippets_all_packs, language_stats, declared_components, directory_components, directory_closure, path_ancestors,
        authors_buckets, commits_flat, repo_stats, git_file_stats, oldest_age, component_repository, repository_of_file,
        parts_with_components, cycle_shared_commits, git_log_parse, ignore_filter, sort_view, view_projection, mode_repo,
    )
} | {f"shared_commits_{k}": _shared(k) for k in ("component", "directory", "file")} | {
    f"snippets_{k}": _of_pack(k, (DECLARATIONS, IMPORTS, ABSTRACT, TYPES)) for k in ("java", "csharp", "php")
}

_CONN = f"""conn AS (
  SELECT component AS f, content AS t, file FROM snippets
  WHERE snippet_type = '{IMPORTS}' AND component IS NOT NULL AND content <> component
    AND content IN (SELECT component FROM snippets WHERE component IS NOT NULL)),
e AS (SELECT DISTINCT f, t FROM conn),
names AS (SELECT DISTINCT component AS name FROM snippets WHERE component IS NOT NULL)"""
_WALK = f"""{_CONN},
walk(src, dst, d) AS (
  SELECT f, t, 1 FROM e UNION SELECT src, t, d + 1 FROM walk JOIN e ON dst = f WHERE d < (SELECT COUNT(*) FROM names) AND d < 60),
dist AS (SELECT src, dst, MIN(d) AS d FROM walk WHERE src <> dst GROUP BY 1, 2)"""
_PATHS = f"""{_WALK},
paths(src, dst, d, p) AS (
  SELECT f, t, 1, [f, t] FROM e
  UNION ALL
  SELECT q.src, e.t, q.d + 1, list_append(q.p, e.t) FROM paths q JOIN e ON q.dst = e.f
  JOIN dist ON dist.src = q.src AND dist.dst = e.t AND dist.d = q.d + 1)"""
_CYCLES = f"""{_PATHS},
mutual AS (SELECT a.src AS x, a.dst AS y FROM dist a JOIN dist b ON a.src = b.dst AND a.dst = b.src),
best AS (SELECT src, dst, MIN(p) AS p FROM paths GROUP BY 1, 2),
raw_cycles AS (
  SELECT best.p AS p FROM e JOIN mutual m ON m.x = e.f AND m.y = e.t JOIN best ON best.src = e.t AND best.dst = e.f),
cyc AS (
  SELECT DISTINCT list_concat(p[list_position(p, list_min(p)):], p[:list_position(p, list_min(p)) - 1]) AS m FROM raw_cycles)"""
_ELEMENTARY = f"""{_WALK}, mutual AS (SELECT a.src AS x, a.dst AS y FROM dist a JOIN dist b ON a.src = b.dst AND a.dst = b.src),
se AS (SELECT e.f, e.t FROM e JOIN mutual m ON m.x = e.f AND m.y = e.t),
ext(s, tip, p) AS (
  SELECT f, t, [f, t] FROM se WHERE t > f
  UNION ALL SELECT s, se.t, list_append(p, se.t) FROM ext JOIN se ON se.f = ext.tip WHERE se.t > s AND NOT list_contains(p, se.t)),
cyc AS (SELECT p AS m, array_to_string(list_append(p, p[1]), ' -> ') AS cycle FROM ext JOIN se ON se.f = ext.tip AND se.t = ext.s)"""
_NEXT = """m[i] AS component, m[CASE WHEN i = len(m) THEN 1 ELSE i + 1 END] AS cycle_successor,
  m[CASE WHEN i = 1 THEN len(m) ELSE i - 1 END] AS cycle_predecessor"""
_PARTS = """parts AS (
  SELECT *, CAST(floor(abs(epoch_us(TIMESTAMP '2025-01-01 00:00:00') - epoch_us(commit_time)) / 86400000000) AS BIGINT) AS age
  FROM (SELECT * FROM commit_parts QUALIFY row_number() OVER (PARTITION BY commit_hash, file ORDER BY loaded_at DESC NULLS LAST) = 1))"""
_TEXT = "CASE WHEN content IS NULL THEN NULL ELSE CAST(content AS VARCHAR) END"


def _commit_sql(key: str, what: list[str]) -> str:
    cols = {"commits": "commit_hash", "unique_file_changes": "file", "unique_component_changes": "component", "authors": "author"}
    out = []
    for days in (None, 30, 90, 180):
        tail = "__total" if days is None else f"__last_{days}_days"
        inside = (lambda x: x) if days is None else (lambda x, days=days: f"CASE WHEN age <= {days} THEN {x} END")
        for w in what:
            e = f"COUNT(DISTINCT {inside(cols[w])})" if w in cols else f"CAST(COALESCE(SUM({inside(w)}), 0) AS BIGINT)"
            out.append(f"{e} AS git__{w}{tail}")
    return ", ".join(out)


_GIT = ["additions", "deletions", "commits", "authors", "unique_file_changes"]


def _git_sql(members: str, head: str, key: str = "k") -> str:
    """Statistics of the history by the groups of ``members`` (``key, file``), as ``k``, repository, age and counts."""
    return f"""{head}{_PARTS}, mem AS (SELECT {key} AS k, file FROM {members}),
rp AS (SELECT DISTINCT repo FROM parts WHERE repo IS NOT NULL),
place AS (SELECT path AS file, COALESCE((SELECT MIN(repo) FROM rp WHERE starts_with(path, repo || '/')), '') AS repo FROM (SELECT DISTINCT path FROM source_files)),
aged AS (SELECT file, MAX(age) AS age FROM parts WHERE file IS NOT NULL GROUP BY 1),
pl AS (SELECT k, place.repo, COALESCE(aged.age, 0) AS age FROM mem JOIN place USING (file) LEFT JOIN aged USING (file)),
mr AS (SELECT k, repo FROM pl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY COUNT(*) DESC, repo) = 1),
ma AS (SELECT k, age FROM pl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY COUNT(*) DESC, age) = 1),
cs AS (SELECT k, {_commit_sql('k', _GIT)} FROM mem JOIN parts USING (file) GROUP BY 1)
SELECT mr.k, mr.repo AS git__repository, ma.age AS git__age_in_days, {_git_zero("cs.")} FROM mr JOIN ma ON ma.k = mr.k LEFT JOIN cs ON cs.k = mr.k"""


def _git_zero(table: str = "g.") -> str:
    names = ([] if table == "cs." else ["git__age_in_days"]) + [f"git__{w}{t}" for t in ("__total", *[f"__last_{x}_days" for x in (30, 90, 180)]) for w in _GIT]
    return ", ".join(f"COALESCE({table}{n}, 0) AS {n}" for n in names)


_BYTES = "bytes AS (SELECT path, content, octet_length(content) AS n FROM source_files WHERE content IS NOT NULL)"
# text for measures: every byte is a character
_LATIN = """latin AS (
  SELECT path AS file, regexp_replace(hex(content), '(..)', '\\1 ', 'g') AS h, octet_length(content) AS n FROM source_files
  WHERE content IS NOT NULL),
split AS (SELECT file, string_split(h, '0A ') AS ls FROM latin),
lines AS (
  SELECT file, len(ls) AS n, [CAST(len(regexp_extract(regexp_replace(x, '20 20 20 20 ', '09 ', 'g'), '^((09 )*)', 1)) / 3 AS BIGINT)
    FOR x IN ls[:len(ls) - 1]] AS ind FROM split),
measures AS (SELECT file, n AS lines, COALESCE(list_max(ind), 0) AS imax, COALESCE(CAST(list_sum(ind) AS BIGINT), 0) AS isum FROM lines)"""
_COUNTS = f"""{_LATIN},
counts AS (
  SELECT file, COUNT(*) FILTER (snippet_type = '{DECLARATIONS}') AS a, COUNT(*) FILTER (snippet_type = '{IMPORTS}') AS b,
    COUNT(*) FILTER (snippet_type = '{ABSTRACT}') AS c, COUNT(*) FILTER (snippet_type = '{TYPES}') AS d FROM snippets GROUP BY 1),
per_file AS (
  SELECT COALESCE(m.file, c.file) AS file, lines, imax, isum, a, b, c, d FROM measures m FULL JOIN counts c ON m.file = c.file)"""
_STATS = f"""COALESCE(MAX(imax), 0) AS complexity__indentation__max,
  COALESCE(ROUND(SUM(isum) / SUM(lines), 6), 0) AS complexity__indentation__avg, CAST(COALESCE(SUM(lines), 0) AS BIGINT) AS complexity__lines,
  CAST(COALESCE(SUM(a), 0) AS BIGINT) AS {DECLARATIONS}, CAST(COALESCE(SUM(b), 0) AS BIGINT) AS {IMPORTS},
  CAST(COALESCE(SUM(c), 0) AS BIGINT) AS {ABSTRACT}, CAST(COALESCE(SUM(d), 0) AS BIGINT) AS {TYPES}"""
_ABOVE = """above AS (
  SELECT DISTINCT file, array_to_string(list_slice(string_split(regexp_replace(file, '/[^/]*$', ''), '/'), 1, i), '/') AS directory
  FROM (SELECT DISTINCT file FROM snippets WHERE contains(file, '/')), LATERAL (SELECT UNNEST(range(1, len(string_split(file, '/'))))) AS r(i))"""
_COUPLE = """couple AS (
  SELECT COALESCE(i.name, o.name) AS name, COALESCE(ca, 0) AS ca, COALESCE(ce, 0) AS ce, COALESCE(din, 0) AS din, COALESCE(dout, 0) AS dout
  FROM (SELECT t AS name, COUNT(DISTINCT file) AS ca, COUNT(DISTINCT f) AS din FROM conn GROUP BY 1) i
  FULL JOIN (SELECT f AS name, COUNT(DISTINCT file) AS ce, COUNT(DISTINCT t) AS dout FROM conn GROUP BY 1) o ON i.name = o.name)"""
_SCC = f"""{_WALK},
mutual AS (SELECT a.src AS x, a.dst AS y FROM dist a JOIN dist b ON a.src = b.dst AND a.dst = b.src),
heads AS (SELECT name, LEAST(name, COALESCE((SELECT MIN(y) FROM mutual WHERE x = name), name)) AS head FROM names),
members AS (
  SELECT name, dense_rank() OVER (ORDER BY head) - 1 AS g, COUNT(*) OVER (PARTITION BY head) AS size FROM heads)"""


def _inside(ctes: str) -> str:
    """The same common tables over the edges inside the groups, with a 2 to their names."""
    return re.sub(r"\b(e|walk|dist|paths|mutual|best|raw_cycles|cyc)\b", r"\g<1>2", ctes[len(_CONN) :].lstrip(",\n"))


def _group_core_sql() -> str:
    return f"""WITH RECURSIVE {_SCC},
e2 AS (SELECT e.f, e.t FROM e JOIN members a ON a.name = e.f JOIN members b ON b.name = e.t AND b.g = a.g),
{_inside(_CYCLES)},
inner_conn AS (SELECT c.* FROM conn c JOIN members a ON a.name = c.f JOIN members b ON b.name = c.t AND a.g = b.g),
i AS (SELECT t AS name, COUNT(DISTINCT file) AS ca, COUNT(DISTINCT f) AS din FROM inner_conn GROUP BY 1),
o AS (SELECT f AS name, COUNT(DISTINCT file) AS ce, COUNT(DISTINCT t) AS dout FROM inner_conn GROUP BY 1),
cc AS (SELECT name, COUNT(*) AS n, AVG(k) AS a, MAX(k) AS m FROM (SELECT UNNEST(list_append(m, m[1])) AS name, len(m) AS k FROM cyc2) GROUP BY 1),
sg AS (SELECT src, dst, d, COUNT(*) AS w FROM paths2 WHERE src <> dst GROUP BY ALL),
bt AS (SELECT x.dst AS name, SUM(x.w * y.w / z.w::DOUBLE) AS v FROM sg x JOIN sg y ON y.src = x.dst JOIN sg z ON z.src = x.src AND z.dst = y.dst AND z.d = x.d + y.d GROUP BY 1),
cl AS (SELECT dst AS name, SUM(1.0 / d) AS h, SUM(d) AS f, SUM(pow(2.0, -d)) AS r FROM dist2 GROUP BY 1)
SELECT x.name AS component, x.g AS "group", x.size AS group_size, COALESCE(ca, 0) AS group__modularity__coupling__afferent,
  COALESCE(ce, 0) AS group__modularity__coupling__efferent, COALESCE(din, 0) AS group__modularity__coupling__dependents,
  COALESCE(dout, 0) AS group__modularity__coupling__dependencies, COALESCE(cc.n, 0) AS group__cycles__short__count,
  ROUND(COALESCE(cc.a, 0), 6)::DOUBLE AS group__cycles__short__avg, COALESCE(cc.m, 0) AS group__cycles__short__max,
  ROUND(COALESCE(bt.v, 0), 6)::DOUBLE AS group__graph__betweenness, ROUND(COALESCE(cl.h, 0), 6)::DOUBLE AS group__graph__harmonic_centrality,
  COALESCE(cl.f, 0)::DOUBLE AS group__graph__farness_centrality, ROUND(COALESCE(cl.r, 0), 6)::DOUBLE AS group__graph__residual_closeness
FROM members x LEFT JOIN i USING (name) LEFT JOIN o USING (name) LEFT JOIN cc USING (name) LEFT JOIN bt USING (name) LEFT JOIN cl USING (name)"""


def _pagerank_sql(rounds: int = 20) -> str:
    ctes = [
        f"WITH RECURSIVE {_CONN}, deg AS (SELECT f, COUNT(*) AS k FROM e GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM names)",
        "r0 AS MATERIALIZED (SELECT name, 1.0 / n AS r FROM names, n)",
    ]
    for i in range(rounds):
        ctes.append(
            f"""r{i + 1} AS MATERIALIZED (SELECT x.name, 0.15 / n.n + 0.85 * (SELECT COALESCE(SUM(r), 0) FROM r{i} WHERE name NOT IN (SELECT f FROM deg)) / n.n
  + 0.85 * COALESCE(g.s, 0) AS r FROM names x CROSS JOIN n LEFT JOIN (SELECT e.t, SUM(p.r / deg.k) AS s FROM e JOIN r{i} p ON p.name = e.f
  JOIN deg ON deg.f = e.f GROUP BY 1) g ON g.t = x.name)"""
        )
    return ", ".join(ctes) + f" SELECT name, ROUND(r::DOUBLE, 6) AS graph__page_rank FROM r{rounds}"


def _hits_sql(rounds: int = 20) -> str:
    ctes = [f"WITH RECURSIVE {_CONN}", "h0 AS MATERIALIZED (SELECT name, 1.0::DOUBLE AS v FROM names)"]
    for i in range(rounds):
        ctes.append(
            f"""a{i + 1} AS MATERIALIZED (SELECT name, v / (SELECT COALESCE(NULLIF(sqrt(SUM(v * v)), 0), 1) FROM x{i}) AS v FROM x{i})""".replace(
                f"x{i}", f"xa{i}"
            )
        )
        ctes.insert(
            -1,
            f"xa{i} AS MATERIALIZED (SELECT n.name, COALESCE(SUM(h.v), 0) AS v FROM names n LEFT JOIN e ON e.t = n.name LEFT JOIN h{i} h ON h.name = e.f GROUP BY 1)",
        )
        ctes.append(
            f"xh{i} AS MATERIALIZED (SELECT n.name, COALESCE(SUM(a.v), 0) AS v FROM names n LEFT JOIN e ON e.f = n.name LEFT JOIN a{i + 1} a ON a.name = e.t GROUP BY 1)"
        )
        ctes.append(f"h{i + 1} AS MATERIALIZED (SELECT name, v / (SELECT COALESCE(NULLIF(sqrt(SUM(v * v)), 0), 1) FROM xh{i}) AS v FROM xh{i})")
    return ", ".join(ctes) + (
        f" SELECT name, ROUND(h.v, 6) AS graph__hits__hub_score, ROUND(a.v, 6) AS graph__hits__authority_score FROM h{rounds} h JOIN a{rounds} a USING (name)"
    )


def _shared_sql(key: str) -> str:
    cols = []
    for days in (None, 30, 90, 180):
        k, tail = days or "all", "" if days is None else f"__last_{days}_days"
        cols.append(
            f"""p.n_{k} AS shared_commits{tail}, ROUND(100.0 * p.n_{k} / NULLIF(a.n_{k}, 0), 6)::DOUBLE AS percentage_of_all_commits_pair_1{tail},
  ROUND(100.0 * p.n_{k} / NULLIF(b.n_{k}, 0), 6)::DOUBLE AS percentage_of_all_commits_pair_2{tail}"""
        )
    tally = "COUNT(*) AS n_all, " + ", ".join(f"COUNT(*) FILTER (r.age <= {x}) AS n_{x}" for x in (30, 90, 180))
    return f"""WITH {_PARTS},
r AS (SELECT {key} AS k, commit_hash, MIN(age) AS age FROM parts WHERE {key} <> '' AND commit_hash IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT k, {tally} FROM r GROUP BY 1),
pr AS (SELECT r.k AS x, q.k AS y, {tally} FROM r JOIN r q ON r.commit_hash = q.commit_hash AND r.k <> q.k GROUP BY 1, 2)
SELECT x AS pair_1, y AS pair_2, {', '.join(cols)} FROM pr p JOIN tot a ON a.k = x JOIN tot b ON b.k = y"""


def _pack_sql(ending: str, ignored: str = "") -> str:
    """The snippets that the table of snippets has of the files with an ending that declare a component."""
    places = ", ".join(f"{e}_position.{f} AS {e}_{f}" for e in ("begin", "end") for f in ("offset", "line", "char_in_line"))
    kinds = ", ".join(f"'{k}'" for k in (DECLARATIONS, IMPORTS, ABSTRACT, TYPES))
    left_out = f"AND NOT (snippet_type = '{IMPORTS}' AND regexp_matches(content, '{ignored}'))" if ignored else ""
    return f"""SELECT DISTINCT file, snippet_type, content, {places} FROM snippets
WHERE ends_with(file, '{ending}') AND snippet_type IN ({kinds}) {left_out} AND file IN (SELECT file FROM snippets WHERE snippet_type = '{DECLARATIONS}')"""


_FIVE = ["commits", "additions", "deletions", "unique_file_changes", "unique_component_changes"]
SQL = {
    "conn_direct": f'WITH {_CONN} SELECT f AS "from", t AS "to", file, COUNT(*) AS reference_count FROM conn GROUP BY ALL',
    "sort_view": f'WITH {_CONN} SELECT f AS "from", t AS "to", file, COUNT(*) AS reference_count FROM conn GROUP BY ALL',
    "view_projection": f'WITH {_CONN} SELECT f AS "from", t AS "to" FROM e',
    "conn_edges_distinct": f'WITH {_CONN} SELECT f AS "from", t AS "to" FROM e',
    "couplings": f"""WITH {_CONN}, {_COUPLE} SELECT name, ca AS modularity__coupling__afferent, ce AS modularity__coupling__efferent,
  din AS modularity__coupling__dependents, dout AS modularity__coupling__dependencies FROM couple""",
    "instability_distance": f"""WITH {_CONN}, {_COUPLE},
ty AS (SELECT component AS name, COUNT(*) FILTER (snippet_type = '{ABSTRACT}') AS a, COUNT(*) FILTER (snippet_type = '{TYPES}') AS n
       FROM snippets WHERE component IS NOT NULL GROUP BY 1),
m AS (SELECT ty.name, CASE WHEN n = 0 THEN CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END ELSE LEAST(1.0, a / n) END AS a,
        CASE WHEN COALESCE(ca + ce, 0) = 0 THEN 0.0 ELSE ce / (ca + ce) END AS i FROM ty LEFT JOIN couple USING (name))
SELECT name, ROUND(a::DOUBLE, 6) AS abstractness, ROUND(i::DOUBLE, 6) AS instability, ROUND(abs(a + i - 1)::DOUBLE, 6) AS distance FROM m""",
    "predecessors_direct": f"WITH {_CONN} SELECT t AS name, f AS predecessor FROM e",
    "successors_direct": f"WITH {_CONN} SELECT f AS name, t AS successor FROM e",
    "reachability_all": f"WITH RECURSIVE {_WALK} SELECT dst AS name, src AS ancestor FROM dist",
    "indirect_paths": f"""WITH RECURSIVE {_PATHS} SELECT src AS "from", dst AS "to", d + 1 AS shortest_path_length,
  array_to_string(p, ' -> ') AS shortest_path FROM paths WHERE src <> dst""",
    "furthest": f"""WITH RECURSIVE {_PATHS} SELECT src AS component, dst AS furthest_component, d + 1 AS furthest_component_distance,
  array_to_string(p, ' -> ') AS furthest_component_shortest_path FROM paths
QUALIFY row_number() OVER (PARTITION BY src ORDER BY d DESC, p) = 1""",
    "scc": f'WITH RECURSIVE {_SCC} SELECT name AS component, g AS "group", size AS group_size FROM members',
    "scc_group_core": _group_core_sql(),
    "scc_group_couplings": f"""WITH RECURSIVE {_SCC},
inner_conn AS (SELECT c.* FROM conn c JOIN members a ON a.name = c.f JOIN members b ON b.name = c.t AND a.g = b.g),
i AS (SELECT t AS name, COUNT(DISTINCT file) AS ca, COUNT(DISTINCT f) AS din FROM inner_conn GROUP BY 1),
o AS (SELECT f AS name, COUNT(DISTINCT file) AS ce, COUNT(DISTINCT t) AS dout FROM inner_conn GROUP BY 1)
SELECT m.name AS component, g AS "group", size AS group_size, COALESCE(ca, 0) AS group__modularity__coupling__afferent,
  COALESCE(ce, 0) AS group__modularity__coupling__efferent, COALESCE(din, 0) AS group__modularity__coupling__dependents,
  COALESCE(dout, 0) AS group__modularity__coupling__dependencies FROM members m LEFT JOIN i ON i.name = m.name LEFT JOIN o ON o.name = m.name""",
    "shortest_cycles": f"""WITH RECURSIVE {_CYCLES} SELECT nr AS cycle_nr, UNNEST(list_append(m, m[1])) AS component, len(m) AS cycle_size, cycle FROM (
  SELECT m, array_to_string(list_append(m, m[1]), ' -> ') AS cycle, row_number() OVER (ORDER BY array_to_string(list_append(m, m[1]), ' -> ')) AS nr FROM cyc)""",
    "cycles_per_component": f"""WITH RECURSIVE {_CYCLES}, r AS (SELECT UNNEST(list_append(m, m[1])) AS name, len(m) AS n FROM cyc)
SELECT name, COUNT(*) AS cycles__short__count, ROUND(AVG(n), 6) AS cycles__short__avg, MAX(n) AS cycles__short__max FROM r GROUP BY 1""",
    "closeness": f"""WITH RECURSIVE {_WALK} SELECT dst AS name, ROUND(SUM(1.0 / d)::DOUBLE, 6) AS graph__harmonic_centrality,
  SUM(d)::DOUBLE AS graph__farness_centrality, ROUND(SUM(pow(2.0, -d)), 6) AS graph__residual_closeness FROM dist GROUP BY 1""",
    "betweenness": f"""WITH RECURSIVE {_PATHS}, s AS (SELECT src, dst, d, COUNT(*) AS w FROM paths WHERE src <> dst GROUP BY ALL),
b AS (SELECT x.dst AS name, SUM(x.w * y.w / z.w::DOUBLE) AS v FROM s x JOIN s y ON y.src = x.dst JOIN s z ON z.src = x.src AND z.dst = y.dst AND z.d = x.d + y.d GROUP BY 1)
SELECT n.name, ROUND(COALESCE(v, 0.0), 6) AS graph__betweenness FROM (SELECT f AS name FROM e UNION SELECT t FROM e) n LEFT JOIN b USING (name)""",
    "pagerank_20": _pagerank_sql(),
    "hits_20": _hits_sql(),
    "elementary_cycles": f"""WITH RECURSIVE {_ELEMENTARY}, n AS (SELECT m, row_number() OVER (ORDER BY cycle) AS nr FROM cyc)
SELECT nr AS cycle_nr, len(m) AS cycle_size, {_NEXT} FROM (SELECT nr, m, UNNEST(range(1, len(m) + 1)) AS i FROM n)""",
    "largest_cycle": f"""WITH RECURSIVE {_ELEMENTARY}, n AS (SELECT m FROM cyc ORDER BY len(m) DESC, cycle LIMIT 1)
SELECT {_NEXT} FROM (SELECT m, UNNEST(range(1, len(m) + 1)) AS i FROM n)""",
    "file_lines": f"WITH {_LATIN} SELECT file, lines AS complexity__lines FROM measures",
    "indentation": f"WITH {_LATIN} SELECT file, imax AS indentation_max, ROUND(isum / lines, 6) AS indentation_avg FROM measures",
    "file_stats_pivot": f"WITH {_COUNTS} SELECT file, {_STATS} FROM per_file GROUP BY file",
    "component_stats": f"""WITH {_COUNTS}, cf AS (SELECT DISTINCT component, file FROM snippets WHERE component IS NOT NULL)
SELECT CASE WHEN component = '' THEN 'Unknown' ELSE component END AS name, {_STATS}, COUNT(*) AS complexity__files
FROM cf JOIN per_file USING (file) GROUP BY component""",
    "components_core": f"""WITH RECURSIVE {_CYCLES}, {_COUNTS}, {_COUPLE}, cf AS (SELECT DISTINCT component, file FROM snippets WHERE component IS NOT NULL),
st AS (SELECT CASE WHEN component = '' THEN 'Unknown' ELSE component END AS name, {_STATS}, COUNT(*) AS complexity__files FROM cf JOIN per_file USING (file) GROUP BY component),
cc AS (SELECT name, COUNT(*) AS n, AVG(k) AS a, MAX(k) AS m FROM (SELECT UNNEST(list_append(m, m[1])) AS name, len(m) AS k FROM cyc) GROUP BY 1),
sg AS (SELECT src, dst, d, COUNT(*) AS w FROM paths WHERE src <> dst GROUP BY ALL),
bt AS (SELECT x.dst AS name, SUM(x.w * y.w / z.w::DOUBLE) AS v FROM sg x JOIN sg y ON y.src = x.dst JOIN sg z ON z.src = x.src AND z.dst = y.dst AND z.d = x.d + y.d GROUP BY 1),
cl AS (SELECT dst AS name, SUM(1.0 / d) AS h, SUM(d) AS f, SUM(pow(2.0, -d)) AS r FROM dist GROUP BY 1),
al AS (SELECT st.*, COALESCE(ca, 0) AS ca, COALESCE(ce, 0) AS ce, COALESCE(din, 0) AS din, COALESCE(dout, 0) AS dout,
  CASE WHEN {TYPES} = 0 THEN CASE WHEN {ABSTRACT} > 0 THEN 1.0 ELSE 0.0 END ELSE LEAST(1.0, {ABSTRACT} / {TYPES}) END AS ab,
  CASE WHEN COALESCE(ca + ce, 0) = 0 THEN 0.0 ELSE ce / (ca + ce) END AS ins FROM st LEFT JOIN couple USING (name))
SELECT al.* EXCLUDE (ca, ce, din, dout, ab, ins), ca AS modularity__coupling__afferent, ce AS modularity__coupling__efferent,
  din AS modularity__coupling__dependents, dout AS modularity__coupling__dependencies, COALESCE(cc.n, 0) AS cycles__short__count,
  ROUND(COALESCE(cc.a, 0), 6)::DOUBLE AS cycles__short__avg, COALESCE(cc.m, 0) AS cycles__short__max, ROUND(COALESCE(bt.v, 0), 6)::DOUBLE AS graph__betweenness,
  ROUND(COALESCE(cl.h, 0), 6)::DOUBLE AS graph__harmonic_centrality, COALESCE(cl.f, 0)::DOUBLE AS graph__farness_centrality,
  ROUND(COALESCE(cl.r, 0), 6)::DOUBLE AS graph__residual_closeness, ROUND(ab::DOUBLE, 6) AS modularity__abstractness,
  ROUND(ins::DOUBLE, 6) AS modularity__instability, ROUND(abs(ab + ins - 1)::DOUBLE, 6) AS modularity__distance_main_sequence
FROM al LEFT JOIN cc USING (name) LEFT JOIN bt USING (name) LEFT JOIN cl USING (name)""",
    "summary": f"""WITH {_CONN}, {_COUNTS}, {_ABOVE}, t AS (SELECT {_STATS}, COALESCE(SUM(isum), 0) AS s FROM per_file)
SELECT 'complexity__lines' AS name, complexity__lines::DOUBLE AS value FROM t UNION ALL SELECT 'complexity__indentation__max', complexity__indentation__max FROM t
UNION ALL SELECT 'complexity__indentation__avg', complexity__indentation__avg FROM t UNION ALL SELECT '_complexity__indentation__count', s FROM t
UNION ALL SELECT '{DECLARATIONS}', {DECLARATIONS} FROM t UNION ALL SELECT '{IMPORTS}', {IMPORTS} FROM t
UNION ALL SELECT '{ABSTRACT}', {ABSTRACT} FROM t UNION ALL SELECT '{TYPES}', {TYPES} FROM t
UNION ALL SELECT 'complexity__files', COUNT(*) FROM source_files UNION ALL SELECT 'component_count', COUNT(*) FROM names
UNION ALL SELECT 'connection_count', COUNT(*) FROM conn UNION ALL SELECT 'directory_count', COUNT(DISTINCT directory) FROM above
UNION ALL SELECT name, value::DOUBLE FROM ({_git_sql("(SELECT 'whole' AS k, path AS file FROM source_files WHERE path IS NOT NULL)", "WITH ")}) UNPIVOT (value FOR name IN (COLUMNS('git__(age|add|del|com|aut|uni).*')))""",
    "files_view": f"""WITH {_COUNTS}, kf AS (SELECT file, MIN(component) AS component FROM snippets WHERE component IS NOT NULL GROUP BY 1),
g AS ({_git_sql("(SELECT DISTINCT path AS k, path AS file FROM source_files WHERE path IS NOT NULL)", "WITH ")})
SELECT p.file AS name, p.* EXCLUDE (file), g.git__repository, {_git_zero()}, CASE WHEN contains(p.file, '/') THEN regexp_replace(p.file, '/[^/]*$', '') ELSE '.' END AS directory, kf.component
FROM (SELECT file, {_STATS} FROM per_file GROUP BY file) p LEFT JOIN g ON g.k = p.file LEFT JOIN kf ON kf.file = p.file""",
    "directories_view": f"""WITH {_COUNTS}, {_ABOVE},
g AS ({_git_sql("above", "WITH " + _ABOVE + ", ", "directory")})
SELECT d.*, g.git__repository, {_git_zero()} FROM (SELECT directory AS name, {_STATS}, COUNT(*) AS complexity__files
  FROM above JOIN per_file USING (file) GROUP BY directory) d LEFT JOIN g ON g.k = d.name""",
    "components_git": f"""WITH cf AS (SELECT DISTINCT component AS k, file FROM snippets WHERE component IS NOT NULL), g AS ({_git_sql("(SELECT DISTINCT component AS k, file FROM snippets WHERE component IS NOT NULL)", "WITH ")})
SELECT CASE WHEN n.k = '' THEN 'Unknown' ELSE n.k END AS name, g.git__repository, {_git_zero()} FROM (SELECT DISTINCT k FROM cf) n LEFT JOIN g ON g.k = n.k""",
    "only_stats_counts": """WITH t AS (SELECT path AS file, regexp_replace(hex(content), '(..)', '\\1 ', 'g') AS h FROM source_files WHERE content IS NOT NULL AND ends_with(path, '.java')),
c AS (SELECT file, 'classes' AS stat_type, len(regexp_extract_all(h, '63 6C 61 73 73 20 (3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9A]) ')) AS value FROM t
  UNION ALL SELECT file, 'todos', len(regexp_extract_all(h, '54 4F 44 4F ')) FROM t)
SELECT file, stat_type, value FROM c WHERE value > 0""",
    "edge_predicates": f"""WITH {_CONN}, pr AS (SELECT f, t FROM e UNION SELECT a.f, b.t FROM e a JOIN e b ON a.t = b.f)
SELECT f AS "from", t AS "to", (f, t) IN (SELECT (f, t) FROM e) AS from_to, (f, t) IN (SELECT (f, t) FROM e) OR (t, f) IN (SELECT (f, t) FROM e) AS between FROM pr""",
    "component_repository": f"""WITH {_PARTS}, cf AS (SELECT DISTINCT component, file FROM snippets WHERE component IS NOT NULL),
r AS (SELECT file, repo FROM parts WHERE file IS NOT NULL AND repo IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY file ORDER BY COUNT(*) DESC, repo) = 1),
a AS (SELECT file, MAX(age) AS age FROM parts WHERE file IS NOT NULL GROUP BY 1),
fs AS (SELECT component, r.repo, a.age FROM cf JOIN a USING (file) LEFT JOIN r USING (file))
SELECT x.component AS name, (SELECT repo FROM fs WHERE component = x.component AND repo IS NOT NULL GROUP BY repo ORDER BY COUNT(*) DESC, repo LIMIT 1) AS git__repository,
  (SELECT age FROM fs WHERE component = x.component AND age IS NOT NULL GROUP BY age ORDER BY COUNT(*) DESC, age LIMIT 1) AS git__age_in_days
FROM (SELECT DISTINCT component FROM fs) x""",
    "dir_rollup": f"""WITH {_COUNTS}, {_ABOVE} SELECT directory AS name, {_STATS}, COUNT(*) AS complexity__files
FROM above JOIN per_file USING (file) GROUP BY directory""",
    "snippets_view": "SELECT content, file, component, snippet_type, " + ", ".join(
        f"{e}_position.{f} AS {e}_{f}" for e in ("begin", "end") for f in ("offset", "line", "char_in_line")) + " FROM snippets",
    "declared_components": f"""SELECT DISTINCT file, COALESCE((SELECT s2.content FROM snippets s2 WHERE s2.file = s.file AND s2.snippet_type = '{DECLARATIONS}'
  ORDER BY s2.begin_position.offset, s2.content LIMIT 1), 'Unknown') AS component FROM snippets s""",
    "directory_components": """SELECT DISTINCT file, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS component FROM snippets""",
    "directory_closure": """SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS directory
FROM source_files, LATERAL (SELECT UNNEST(range(1, len(string_split(path, '/'))))) AS r(i)""",
    "path_ancestors": "SELECT path, len(string_split(path, '/')) - 1 AS depth FROM source_files",
    "authors_buckets": f"""WITH {_PARTS},
m AS (SELECT author, author_email FROM parts QUALIFY row_number() OVER (PARTITION BY author ORDER BY commit_time DESC NULLS LAST, commit_hash DESC NULLS LAST, file DESC NULLS LAST) = 1)
SELECT a.author AS author_name, m.author_email, a.* EXCLUDE (author) FROM (SELECT author, {_commit_sql('author', _FIVE)} FROM parts GROUP BY 1) a
JOIN m ON m.author IS NOT DISTINCT FROM a.author""",
    "commits_flat": f"""WITH {_PARTS} SELECT file, component, repo AS repository, commit_hash, commit_time, author AS author_name, author_email,
  message AS commit_message, additions AS file_additions, deletions AS file_deletions FROM parts""",
    "repo_stats": f"""WITH {_PARTS} SELECT CASE WHEN COALESCE(repo, '') = '' THEN 'Unknown' ELSE repo END AS name,
  {_commit_sql('repo', ['additions', 'deletions', 'commits', 'authors', 'unique_file_changes'])} FROM parts GROUP BY repo""",
    "oldest_age": f"WITH {_PARTS} SELECT component, MAX(age) AS git__age_in_days FROM parts GROUP BY 1",
    "git_file_stats": f"""WITH {_PARTS},
r AS (SELECT file, repo FROM parts WHERE file IS NOT NULL AND repo IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY file ORDER BY COUNT(*) DESC, repo) = 1)
SELECT s.*, r.repo AS git__repository FROM (SELECT file, MAX(age) AS git__age_in_days,
  {_commit_sql('file', ['additions', 'deletions', 'commits', 'authors', 'unique_file_changes'])} FROM parts WHERE file IS NOT NULL GROUP BY 1) s LEFT JOIN r USING (file)""",
    "mode_repo": f"""WITH {_PARTS} SELECT author, repo FROM parts WHERE author IS NOT NULL AND repo IS NOT NULL GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY author ORDER BY COUNT(*) DESC, repo) = 1""",
    "repository_of_file": """SELECT path AS file, COALESCE((SELECT MIN(repo) FROM (SELECT DISTINCT repo FROM raw_commits) r
  WHERE starts_with(path, r.repo || '/')), '') AS repo FROM source_files""",
    "parts_with_components": f"""WITH {_PARTS}, cf AS (SELECT DISTINCT component, file FROM snippets WHERE component IS NOT NULL)
SELECT COALESCE(cf.component, '') AS component, COUNT(*) AS n FROM parts p LEFT JOIN cf ON cf.file = p.file GROUP BY 1""",
    "ignore_filter": """SELECT path FROM source_files WHERE NOT (
  regexp_matches(path, '(^|/)[^/]*\\.md($|/)') OR (starts_with(path, 'orbit-platform/build/') AND path <> 'orbit-platform/build/deps.lock')
  OR contains('/' || path, '/vendor/') OR regexp_matches(path, '(^|/)generated-[^/]*/.') OR regexp_matches(path, '^web/[^/]*\\.css($|/)'))""",
    "cycle_shared_commits": f"""WITH RECURSIVE {_CYCLES}, {_PARTS},
r AS (SELECT component, commit_hash, MIN(age) AS age FROM parts WHERE component IS NOT NULL GROUP BY 1, 2),
c AS (SELECT array_to_string(list_append(m, m[1]), ' -> ') AS cycle, len(m) AS n, m FROM cyc),
x AS (SELECT cycle, n, UNNEST(m) AS component FROM c),
h AS (SELECT cycle, commit_hash, MIN(age) AS age FROM x JOIN r USING (component) GROUP BY cycle, n, commit_hash HAVING COUNT(*) = n)
SELECT c.cycle, c.n AS cycle_size, COUNT(h.commit_hash) AS shared_commits, COUNT(*) FILTER (h.age <= 30) AS shared_commits__last_30_days,
  COUNT(*) FILTER (h.age <= 90) AS shared_commits__last_90_days, COUNT(*) FILTER (h.age <= 180) AS shared_commits__last_180_days
FROM c LEFT JOIN h ON h.cycle = c.cycle GROUP BY 1, 2""",
    "git_log_parse": f"""WITH {_PARTS} SELECT repo, COUNT(*) AS parts, COUNT(DISTINCT commit_hash) AS commits, COUNT(DISTINCT file) AS files,
  CAST(SUM(COALESCE(additions, 0)) AS BIGINT) AS additions, CAST(SUM(COALESCE(deletions, 0)) AS BIGINT) AS deletions, MAX(CAST(floor(epoch(commit_time)) AS BIGINT)) AS last
FROM parts WHERE file IS NOT NULL GROUP BY 1""",
    "snippets_java": _pack_sql(".java", "^(" + "|".join(JAVA_IGNORED) + ")"),
    "snippets_csharp": _pack_sql(".cs"),
    "snippets_php": _pack_sql(".php"),
    "snippets_regex": f"""WITH t AS (SELECT path, content, CAST(regexp_replace(hex(content), '(..)', '\\1 ', 'g') AS VARCHAR) AS h FROM source_files WHERE content IS NOT NULL)
SELECT s.file, s.content, s.begin_position.offset AS begin, s.end_position.offset AS "end", s.begin_position.line AS line
FROM (SELECT DISTINCT * FROM snippets) s WHERE snippet_type = '{DECLARATIONS}' AND regexp_matches(file, '\\.(kt|scala|php)$')""",
} | {f"shared_commits_{k}": _shared_sql(k) for k in ("component", "directory", "file")}
SQL["dist_all_pairs"] = SQL["dist_by_level"] = (
    f"WITH RECURSIVE {_PATHS} SELECT src, dst, d AS distance, COUNT(*) AS ways FROM paths WHERE src <> dst GROUP BY ALL"
)
SQL["definitions"] = "SELECT * FROM (VALUES {}) AS t(id, name, short, long)".format(
    ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in engine.DEFINITIONS)
)
