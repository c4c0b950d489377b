from __future__ import annotations

import datetime as dt

from lodestrata.functions.metrics import abstractness, distance_main_sequence, instability
from lodestrata.operators import history
from lodestrata.sources import gitlog
from pyspark.sql import functions as F

PARTS = "component string, repo string, commit_hash string, commit_time timestamp, file string, directory string, author string, author_email string, message string, additions int, deletions int"
BASED = "2020-01-01 00:00:00"


def part(commit, day, component, file, author="a", add=1, dele=1):
    t = dt.datetime(2020, 1, 1) - dt.timedelta(days=day)
    return (component, "r", commit, t, file, "d", author, f"{author}@x", "m", add, dele)


def test_totals(spark):
    rows = []
    for day in range(20):
        for c in range(10):
            for n in range(20):
                rows.append(part(f"{day}-{c}", day, f"k{n // 5}", f"f{n}", "abcd"[c % 4], 3 * (n % 5) + 3, 3 * (n % 5) + 2))
    r = history.commit_stats(spark.createDataFrame(rows, PARTS), ["repo"], BASED).first()
    assert (r["git__commits__total"], r["git__additions__total"], r["git__deletions__total"]) == (200, 36000, 32000)
    assert (r["git__unique_file_changes__total"], r["git__unique_component_changes__total"], r["git__authors__total"]) == (20, 4, 4)
    assert history.oldest_age(spark.createDataFrame(rows, PARTS), ["repo"], BASED).first()["git__age_in_days"] == 19


def test_buckets(spark):
    base = dt.datetime(2000, 6, 1)
    times = [dt.datetime(2000, 5, 15), dt.datetime(2000, 5, 14), dt.datetime(2000, 3, 12), dt.datetime(2000, 1, 11), dt.datetime(1999, 11, 4)]
    rows = [("k", "r", str(i), t, "f", "d", "a", "e", "m", 1, 1) for i, t in enumerate(times)]
    r = history.commit_stats(spark.createDataFrame(rows, PARTS), ["repo"], base, (180, 90, 30)).first()
    assert [r[f"git__commits__last_{d}_days"] for d in (180, 90, 30)] == [4, 3, 2]


def test_shared_commits(spark):
    touched = {1: "abc", 2: "cb", 3: "ab", 4: "bc", 5: "xyz", 6: "xa", 7: "xba", 8: "yca", 9: "zbd", 10: "zye"}
    rows = [part(str(c), 40, k, k) for c, ks in touched.items() for k in ks] + [part("1", 40, "a", "a")]
    keys = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    got = {(r["pair_1"], r["pair_2"]): r for r in history.shared_commits(spark.createDataFrame(rows, PARTS), "component", BASED, keys=keys).collect()}
    assert {k: v["shared_commits"] for k, v in got.items() if k[0] < k[1]} == {("a", "b"): 3, ("a", "c"): 2, ("b", "c"): 3, ("b", "d"): 1}
    assert ("b", "a") in got and got["a", "b"]["percentage_of_all_commits_pair_1"] == 3 / 5 * 100
    assert got["a", "b"]["shared_commits__last_30_days"] == 0 and got["a", "b"]["percentage_of_all_commits_pair_1__last_30_days"] is None
    assert got["a", "b"]["shared_commits__last_90_days"] == 3


def test_cycles_need_every_member(spark):
    rows = [part("1", 1, "a", "f"), part("1", 1, "b", "g"), part("2", 1, "a", "f")]
    cycles = spark.createDataFrame([("a -> b -> a", ["a", "b"]), ("a -> z -> a", ["a", "z"])], "cycle string, members array<string>")
    got = {r["cycle"]: r["shared_commits"] for r in history.cycle_shared_commits(cycles, spark.createDataFrame(rows, PARTS), BASED).collect()}
    assert got == {"a -> b -> a": 1, "a -> z -> a": 0}


def test_repository_of(spark):
    files = spark.createDataFrame([("a/b/f",), ("ab/f",), ("f",), ("a/g",)], "file string")
    repos = spark.createDataFrame([("a",), ("a/b",), ("a",)], "repo string")
    assert {tuple(r) for r in history.repository_of(files, repos).collect()} == {("a/b/f", "a"), ("ab/f", ""), ("f", ""), ("a/g", "a")}


def test_log(spark):
    r, f = gitlog.RECORD, gitlog.FIELD
    log = f"{r}h1{f}1577836800{f}Ann -- B{f}a@x{f}fix -- all{f}\n3\t1\tsrc/a b.txt\n-\t-\timg.png\n{r}h2{f}x{f}Bob{f}{f}empty{f}\n"
    raw = gitlog.raw_commits(spark.createDataFrame([("lib", log), ("", "")], "repo string, log string"))
    assert {(x["commit_hash"], x["author"], x["message"], len(x["files"])) for x in raw.collect()} == {("h1", "Ann -- B", "fix -- all", 2), ("h2", "Bob", "empty", 0)}
    got = {(x["file"], x["directory"], x["additions"], x["deletions"]) for x in gitlog.commit_parts(raw).collect()}
    assert got == {("lib/src/a b.txt", "lib/src", 3, 1), ("lib/img.png", "lib", 0, 0)}


def test_ratios(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (1, 2), (5, 2)], "a long, n long")
    assert [r[0] for r in df.select(abstractness(F.col("a"), F.col("n"))).collect()] == [0.0, 1.0, 0.5, 1.0]
    assert [r[0] for r in df.select(instability(F.col("a"), F.col("n"))).collect()] == [0.0, 0.0, 2 / 3, 2 / 7]
    assert df.select(distance_main_sequence(F.lit(0.0), F.lit(0.0))).first()[0] == 1.0


def test_pairs_of_large_commits_come_once(spark, monkeypatch):
    rows = [(f"f{i:02}", "big", "2024-12-20") for i in range(25)] + [(f"f{i:02}", f"c{i % 3}", "2024-01-01") for i in range(12)]
    parts = spark.createDataFrame(rows, "file string, commit_hash string, day string").withColumn("commit_time", F.col("day").cast("timestamp"))
    get = lambda: sorted(map(tuple, history.shared_commits(parts, "file", "2025-01-01").collect()))
    want = get()
    assert len(want) == 25 * 24
    for size in (1, 4, 10):
        monkeypatch.setattr(history, "TOGETHER", size)
        assert get() == want
