"""Views written as text, as files, and into SQLite."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import sqlite3
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of one insert.
ROWS_AT_ONCE, PARAMETERS_AT_ONCE = 500, 32_766


def shown(v: object) -> str:
    """A value as text; a missing one is ``-``, a position ``line:char (offset)``."""
    if v is None:
        return "-"
    if hasattr(v, "asDict"):
        d = v.asDict()
        return f"{d['line']}:{d['char_in_line']} ({d['offset']})" if "char_in_line" in d else json.dumps(d, default=str)
    return str(v)


def render(df: DataFrame, how: str = "table", header: bool = True) -> Iterator[str]:
    """Lines of text: ``table``, ``csv``, ``tsv``, ``json`` or ``ndjson``. Rows are fetched a partition at a time."""
    if how in ("csv", "tsv"):
        out = io.StringIO()
        writer = csv.writer(out, delimiter="," if how == "csv" else "\t", lineterminator="\n")
        for row in ([df.columns] if header else []):
            writer.writerow(row)
        for r in df.toLocalIterator():
            writer.writerow([shown(v) for v in r])
            yield from out.getvalue().splitlines()
            out.seek(0)
            out.truncate()
        if out.getvalue():
            yield from out.getvalue().splitlines()
    elif how in ("json", "ndjson"):
        as_text = (r["j"] for r in without_nan(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())
        if how == "ndjson":
            yield from as_text
            return
        # each row is held until it is known whether another one follows
        before, last = "[", None
        for text in as_text:
            if last is not None:
                yield f"{before}{last},"
                before = ""
            last = text
        yield f"{before}{last or ''}]"
    elif how == "table":
        # the widths first, then the rows, so that they are not held
        kept = df.persist()
        try:
            names = [c.upper() for c in df.columns]
            widths = [len(c) if header else 0 for c in names]
            for r in kept.toLocalIterator():
                widths = [max(w, len(shown(v))) for w, v in zip(widths, r, strict=True)]
            if header:
                yield "  ".join(c.ljust(w) for c, w in zip(names, widths, strict=True)).rstrip()
            for r in kept.toLocalIterator():
                yield "  ".join(shown(v).ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
        finally:
            kept.unpersist()
    else:
        raise ValueError(f"there is no format {how!r}")


def without_nan(df: DataFrame) -> DataFrame:
    """``df`` with null for what is no number."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in kinds.items()])


def write_report(df: DataFrame, path: str, report_id: str, how: str = "parquet") -> None:
    """Rows of a report under ``path``, in a folder of the report; a report written again replaces itself only."""
    out = df.withColumn("report_id", F.lit(report_id))
    out.write.mode("overwrite").partitionBy("report_id").option("partitionOverwriteMode", "dynamic").format(how).save(path)


def _sqlite_type(kind: str) -> str:
    return {"string": "TEXT", "double": "REAL", "float": "REAL", "timestamp": "DATE", "timestamp_ntz": "DATE", "date": "DATE", "struct": "TEXT"}.get(kind, "INTEGER")


def _plain(v: object) -> object:
    if v is None or isinstance(v, (int, float, str)):
        return v
    if hasattr(v, "asDict"):
        d = v.asDict()
        return f"{d['line']}:{d['char_in_line']}" if "char_in_line" in d else json.dumps(d, default=str)
    return str(v)


def save_sqlite(path: str, views: dict[str, DataFrame], report_id: str, at: dt.datetime | None = None) -> None:
    """Each view as a table with ``report_id`` and ``timestamp``.

    Tables are made and columns added as needed; rows of the same report are replaced. Everything is one transaction.
    """
    at = at or dt.datetime.now(dt.timezone.utc)
    q = lambda name: '"' + name.replace('"', '""') + '"'
    con = sqlite3.connect(path)
    try:
        with con:
            for view, df in views.items():
                kinds = {f.name: _sqlite_type(f.dataType.typeName()) for f in df.schema.fields}
                columns = {"report_id": "TEXT", "timestamp": "DATE"} | kinds
                con.execute(f"CREATE TABLE IF NOT EXISTS {q(view)} ({', '.join(f'{q(c)} {t}' for c, t in columns.items())})")
                have = {r[1] for r in con.execute(f"PRAGMA table_info({q(view)})")}
                for c, t in columns.items():
                    if c not in have:
                        con.execute(f"ALTER TABLE {q(view)} ADD COLUMN {q(c)} {t}")
                con.execute(f"DELETE FROM {q(view)} WHERE report_id = ?", (report_id,))
                size = max(1, min(ROWS_AT_ONCE, PARAMETERS_AT_ONCE // len(columns)))
                insert = f"INSERT INTO {q(view)} ({', '.join(map(q, columns))}) VALUES ({', '.join('?' * len(columns))})"
                rows = ((report_id, at.isoformat(), *map(_plain, r)) for r in df.toLocalIterator())
                while some := list(islice(rows, size)):
                    con.executemany(insert, some)
    finally:
        con.close()
