from __future__ import annotations

import datetime as dt

from lodestrata.operators.extract import Pack
from lodestrata.streaming.incremental import activity_of, append_to, correction_stream, snippet_stream, stream_table


def test_snippets_of_a_stream(spark, tmp_path):
    src = spark.createDataFrame([("a.txt", bytearray(b"key one\nkey two"))], "path string, content binary")
    src.write.parquet(str(tmp_path / "in"))
    df = snippet_stream(stream_table(spark, str(tmp_path / "in"), src.schema), [Pack("p", "**", (r"key (?P<k>\w+)",))])
    q = append_to(df, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "two"}


def test_the_latest_delivery_counts_in_a_stream(spark, tmp_path):
    """Corrected rows take the place of those before them, within a batch and over batches, whatever their order."""
    cols = "commit_hash string, file string, commit_time timestamp, additions int, deletions int, loaded_at timestamp"
    day = lambda d: dt.datetime(2024, 1, 1, 5) + dt.timedelta(days=d)
    batches = [
        [("c1", "f", day(0), 1, None, day(1)), ("c1", "f", day(0), 1, None, day(1)), ("c2", "f", day(0), 2, 3, day(1)), ("c4", "h", None, 1, 1, day(1))],
        [("c2", "f", day(0), 20, 3, day(30)), ("c2", "f", day(0), 9, 9, day(9)), ("c1", "f", day(0), 1, None, day(31)), (None, "f", day(0), 1, 1, day(1))],
        [("c2", "f", day(2), 7, 7, day(40)), ("c9", "g", day(2), 1, 1, None), ("c2", "f", day(0), 5, 5, day(2)), ("c4", "h", day(1), 3, 1, day(50))],
    ]
    for rows in batches:
        src = spark.createDataFrame(rows, cols)
        src.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = correction_stream(stream_table(spark, str(tmp_path / "in"), src.schema))
        q = append_to(df, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["file"], str(r["day"]), r["additions"], r["deletions"]) for r in activity_of(out).collect())
    assert got == [("f", "2024-01-01", 1, 0), ("f", "2024-01-03", 7, 7), ("g", "2024-01-03", 1, 1), ("h", "2024-01-02", 3, 1)]
