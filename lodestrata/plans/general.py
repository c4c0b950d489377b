"""Queries p3, p4 and p5: rolling totals, changes between snapshots, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.rolling import bursts, file_rolling, last_month
from lodestrata.operators.skew import heavy_keys, per_key_totals, tagged
from lodestrata.operators.snapshots import report_changes
from lodestrata.sources.tables import table

KEY_FIELDS = (("commit_parts", "file"), ("commit_parts", "component"), ("snippets", "component"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return bursts(table(spark, d, "commit_parts"))


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    return file_rolling(table(spark, d, "commit_parts"))


def p3_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The last 30 days of each file from trees that late deliveries have corrected."""
    return last_month(table(spark, d, "commit_parts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return report_changes(table(spark, d, "view_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        tagged(heavy_keys(table(spark, d, t), f), t, f, ["key_value"]) for t, f in KEY_FIELDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, commits and line totals of every key of the three fields; the spans of snippets are their lines."""
    out = None
    for t, f in KEY_FIELDS:
        rows = table(spark, d, t)
        if t == "commit_parts":
            one = per_key_totals(rows, f, {"additions": "additions", "deletions": "deletions"}, {"commits": "commit_hash"})
        else:
            lines = rows.select(f, (F.col("end_position.line") - F.col("begin_position.line") + 1).alias("lines"))
            one = per_key_totals(lines, f, {"additions": "lines"}).select(
                "*", F.lit(0).cast("long").alias("deletions"), F.lit(0).cast("long").alias("commits")
            )
        one = tagged(one, t, f, ["key_value", "row_count", "commits", "additions", "deletions"])
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "p3_found": p3_found,
    "p3_rolling": p3_rolling,
    "p3_corrected": p3_corrected,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_totals": p5_totals,
}

_DAILY = """
valid AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash, file ORDER BY loaded_at DESC NULLS LAST) AS rn
                 FROM commit_parts WHERE file IS NOT NULL) WHERE rn = 1 AND commit_time IS NOT NULL),
daily AS (
  SELECT file, CAST(commit_time AS DATE) AS d, SUM(COALESCE(additions, 0)) AS a, SUM(COALESCE(deletions, 0)) AS x
  FROM valid GROUP BY 1, 2),
span AS (SELECT file, MIN(d) AS f, MAX(d) AS l FROM daily GROUP BY 1),
days AS (SELECT file, f, CAST(UNNEST(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
filled AS (
  SELECT s.file, s.f, s.d, COALESCE(y.a, 0) AS a, COALESCE(y.x, 0) AS x, CASE WHEN y.d IS NULL THEN 0 ELSE 1 END AS act
  FROM days s LEFT JOIN daily y ON s.file = y.file AND s.d = y.d),
rolled AS (
  SELECT file, f, d,
    SUM(a) OVER w7 AS a7, SUM(x) OVER w7 AS x7, SUM(a) OVER w30 AS a30, SUM(x) OVER w30 AS x30, SUM(act) OVER w30 AS act30
  FROM filled
  WINDOW w7 AS (PARTITION BY file ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY file ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

SQL = {
    "p3_found": f"""WITH {_DAILY}
SELECT file, strftime(d, '%Y-%m-%d') AS day FROM rolled
WHERE d >= f + 29 AND act30 >= 5 AND a30 + x30 >= 200 AND (a7 + x7) * 5 >= (a30 + x30) * 4""",
    "p3_rolling": f"""WITH {_DAILY}
SELECT file, strftime(d, '%Y-%m-%d') AS day, CAST(a7 AS BIGINT) AS additions_7, CAST(x7 AS BIGINT) AS deletions_7,
  CAST(a30 AS BIGINT) AS additions_30, CAST(x30 AS BIGINT) AS deletions_30,
  ROUND(a7 / 7.0, 6)::DOUBLE AS additions_avg_7, ROUND(x7 / 7.0, 6)::DOUBLE AS deletions_avg_7,
  ROUND(a30 / 30.0, 6)::DOUBLE AS additions_avg_30, ROUND(x30 / 30.0, 6)::DOUBLE AS deletions_avg_30 FROM rolled""",
    "p3_corrected": f"""WITH {_DAILY}, ends AS (SELECT file, MAX(CAST(commit_time AS DATE)) AS l FROM valid GROUP BY 1)
SELECT e.file, strftime(e.l, '%Y-%m-%d') AS day, CAST(SUM(COALESCE(additions, 0)) AS BIGINT) AS additions_30,
  CAST(SUM(COALESCE(deletions, 0)) AS BIGINT) AS deletions_30, COUNT(*) AS commits_30
FROM ends e JOIN valid v ON v.file = e.file AND CAST(v.commit_time AS DATE) BETWEEN e.l - 29 AND e.l GROUP BY e.file, e.l""",
    "p4_found": """WITH reports AS (
  SELECT database_name, report_id, MAX(scan_time) AS t FROM view_rows GROUP BY 1, 2),
seqs AS (
  SELECT *, row_number() OVER w AS seq, lead(report_id) OVER w AS nxt FROM reports
  WINDOW w AS (PARTITION BY database_name ORDER BY t, report_id)),
canon AS (
  SELECT DISTINCT v.database_name, s.report_id, s.seq, s.nxt, v.view_name,
    NULLIF(regexp_replace(name, '^\\./', ''), '') AS name,
    struct_pack(a := NULLIF(directory, ''), b := NULLIF(component, ''), c := complexity__lines,
      d := complexity__indentation__max, e := ROUND(complexity__indentation__avg, 6), f := modularity__types__total,
      g := complexity__files) AS v
  FROM view_rows v JOIN seqs s ON v.database_name = s.database_name AND v.report_id = s.report_id AND v.scan_time = s.t),
rowset AS (
  SELECT database_name, report_id, seq, nxt, view_name, name, list_sort(list(v)) AS v FROM canon
  WHERE name IS NOT NULL GROUP BY ALL)
SELECT database_name, report_id, view_name, name, change FROM (
  SELECT COALESCE(c.database_name, p.database_name) AS database_name, COALESCE(c.report_id, p.nxt) AS report_id,
    COALESCE(c.view_name, p.view_name) AS view_name, COALESCE(c.name, p.name) AS name,
    CASE WHEN p.seq IS NULL THEN 'added' WHEN c.seq IS NULL THEN 'removed'
         WHEN c.v IS DISTINCT FROM p.v THEN 'changed' END AS change
  FROM (SELECT * FROM rowset WHERE seq > 1) c
  FULL JOIN (SELECT * FROM rowset WHERE nxt IS NOT NULL) p
    ON c.database_name = p.database_name AND c.seq = p.seq + 1 AND c.view_name = p.view_name AND c.name = p.name)
WHERE change IS NOT NULL""",
    "p5_found": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{f}' AS field_name, {f} AS key_value FROM {t}
WHERE {f} IS NOT NULL AND {f} <> '' GROUP BY {f} HAVING COUNT(*) * 100 >= 2 * (SELECT COUNT(*) FROM {t})"""
        for t, f in KEY_FIELDS
    ),
    "p5_totals": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{f}' AS field_name, {f} AS key_value, COUNT(*) AS row_count,
  {'COUNT(DISTINCT commit_hash)' if t == 'commit_parts' else 'CAST(0 AS BIGINT)'} AS commits,
  CAST(COALESCE(SUM({'additions' if t == 'commit_parts' else 'end_position.line - begin_position.line + 1'}), 0) AS BIGINT) AS additions,
  CAST({'COALESCE(SUM(deletions), 0)' if t == 'commit_parts' else '0'} AS BIGINT) AS deletions FROM {t} GROUP BY {f}"""
        for t, f in KEY_FIELDS
    ),
}
