from __future__ import annotations

import datetime as dt
import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import pytest

from lodestrata.operators.rolling import (
    LEAVES, SegmentForest, build_forest, bursts, correct_forest, daily_activity, last_month, rolling_totals, trailing_totals, upsert_forest, write_forest
)

PARTS = "commit_hash string, file string, commit_time timestamp, additions int, deletions int, loaded_at timestamp, entity int, day string"


def test_trailing_equals_sums():
    rng = np.random.default_rng(0)
    leaves = rng.integers(0, 9, (3, 64))
    forest = SegmentForest(leaves)
    for n in (1, 7, 30, 32):
        want = np.stack([leaves[:, i - n + 1 : i + 1].sum(axis=1) for i in range(32, 64)], axis=1)
        assert (forest.trailing(n, 32) == want).all()


def test_correction_touches_ancestors_only():
    forest = SegmentForest(np.zeros((2, 64), dtype=np.int64))
    assert forest.correct(np.array([1]), np.array([5]), np.array([4])) == 7
    assert (forest.nodes[0] == 0).all() and forest.nodes[1].nonzero()[0].tolist() == [1, 2, 4, 8, 17, 34, 69]
    want = np.zeros((2, 64), dtype=np.int64)
    want[1, 5] = 4
    assert (forest.nodes == SegmentForest(want).nodes).all()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-300, 900), st.one_of(st.none(), st.integers(-3, 9))), max_size=30))
def test_against_brute_force(spark, data):
    df = spark.createDataFrame(data, "entity string, day int, v long").selectExpr("*", "1 AS shard", "2 AS leaves")
    got = {(r["entity"], r["day"]): (r["v_7"], r["active_days_7"], r["v_30"], r["active_days_30"]) for r in rolling_totals(df, ("v",)).collect()}
    want = {}
    for e in {x[0] for x in data}:
        days = [x[1] for x in data if x[0] == e]
        for d in range(min(days), max(days) + 1):
            inside = lambda n: [x for x in data if x[0] == e and d - n < x[1] <= d]  # noqa: B023, E731
            want[e, d] = tuple(y for n in (7, 30) for y in (sum(x[2] or 0 for x in inside(n)), len({x[1] for x in inside(n)})))
    assert got == want


def test_least_active_prunes_without_loss(spark):
    data = [("a", d, 1) for d in (0, 3, 5, 9, 11, 400, 401, 402, 403, 404)] + [("b", 1, 1)]
    df = spark.createDataFrame(data, "entity string, day int, v long")
    every = rolling_totals(df, ("v",)).where("active_days_30 >= 5")
    some = rolling_totals(df, ("v",), least_active=5)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, some.collect()))


def test_valid_row_wins_and_nulls_count_nothing(spark):
    t = dt.datetime(2024, 3, 1, 23, 59)
    data = [
        ("c1", "f", t, 1, 1, dt.datetime(2024, 3, 2), 0, ""), ("c1", "f", t, 5, None, dt.datetime(2024, 4, 2), 0, ""), ("c1", "f", t, 5, None, dt.datetime(2024, 4, 2), 0, ""),
        ("c2", "f", t, None, None, None, 0, ""), ("c3", None, t, 1, 1, None, 0, ""), ("c4", "f", None, 1, 1, None, 0, ""),
    ]
    out = daily_activity(spark.createDataFrame(data, PARTS)).collect()
    assert [(r["entity"], r["additions"], r["deletions"]) for r in out] == [("f", 5, 0)]


def test_bursts_and_empty(spark):
    t = dt.datetime(2024, 1, 1)
    data = [("c0", "f", t, 1, 0, None, 0, "")]
    data += [(f"c{i}", "f", t + dt.timedelta(days=39 + i), 60, 0, None, 0, "") for i in range(1, 7)]
    got = sorted(r["day"] for r in bursts(spark.createDataFrame(data, PARTS)).collect())
    assert got == ["2024-02-14", "2024-02-15"]
    assert bursts(spark.createDataFrame([], PARTS)).count() == 0


DAILY = "entity string, day int, v long"
LATE = "entity string, day int, v long, rows long"


def nodes(df):
    return {(r["entity"], r["shard"], r["value"]): r["nodes"] for r in df.collect() if any(r["nodes"])}


def test_forest_table_with_late_corrections(spark):
    daily = spark.createDataFrame([("a", 10, 1), ("a", 230, 2), ("b", 5, 3), (None, 9, 2), ("a", None, 5)], DAILY)
    late = spark.createDataFrame([("a", 230, 5, 0), ("a", 230, 1, 1), ("c", 7, 4, 1)], LATE)
    fixed = spark.createDataFrame([("a", 10, 1), ("a", 230, 8), ("a", 230, 0), ("b", 5, 3), (None, 9, 2), ("c", 7, 4)], DAILY)
    base = build_forest(daily, ["v"])
    changed = nodes(correct_forest(base, late, ["v"]))
    # only the trees of corrected days come back
    assert {k[:2] for k in changed} == {("a", 1), ("c", 0)} and all(len(v) == 2 * LEAVES for v in changed.values())
    assert nodes(base) | changed == nodes(build_forest(fixed, ["v"]))
    assert build_forest(daily.limit(0), ["v"]).count() == 0 and correct_forest(base, late.limit(0), ["v"]).count() == 0


def test_ranges_of_stored_trees_against_plain_sums(spark):
    rng = random.Random(6)
    data = [(rng.choice("abc"), rng.randrange(900), rng.randrange(50)) for _ in range(400)]
    forest = build_forest(spark.createDataFrame(data, DAILY), ["v"])
    asked = sorted({(rng.choice("abc"), rng.randrange(900)) for _ in range(200)})
    for length in (1, 7, 30, 32):
        got = {(r["entity"], r["day"], r["value"]): r["total"] for r in trailing_totals(forest, spark.createDataFrame(asked, "entity string, day int"), length).collect()}
        for e, d in asked:
            inside = [v for x, y, v in data if x == e and d - length < y <= d]
            assert got.get((e, d, "v"), 0) == sum(inside) and got.get((e, d, "rows"), 0) == len(inside)
    with pytest.raises(ValueError):
        trailing_totals(forest, spark.createDataFrame(asked, "entity string, day int"), 33)


def test_stored_trees_are_corrected_in_their_folders_only(spark, tmp_path):
    path = str(tmp_path / "forest")
    data = [(f"e{i}", d, i) for i in range(40) for d in (3, 500)]
    write_forest(build_forest(spark.createDataFrame(data, DAILY), ["v"]), path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "forest").rglob("*.parquet")}
    upsert_forest(spark, path, spark.createDataFrame([("e7", 3, 100, 1), ("new", 3, 9, 1)], LATE), ["v"])
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "forest").rglob("*.parquet")}
    assert 1 <= len(before.keys() - after.keys()) <= 2 and all(after[f] == t for f, t in before.items() if f in after)
    fixed = spark.createDataFrame([*data, ("e7", 3, 100), ("new", 3, 9)], DAILY)
    assert nodes(spark.read.parquet(path)) == nodes(build_forest(fixed, ["v"]))
    upsert_forest(spark, path, spark.createDataFrame([], LATE), ["v"])
    assert nodes(spark.read.parquet(path)) == nodes(build_forest(fixed, ["v"]))


def test_last_month_of_corrected_deliveries(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    data = [("c1", "f", t(0), 10, 1, t(1), 0, ""), ("c2", "f", t(40), 5, 0, t(41), 0, ""), ("c2", "f", t(40), 7, None, t(60), 0, ""), ("c3", "f", t(45), 1, 1, t(46), 0, ""), ("c3", "f", t(12), 1, 1, t(61), 0, "")]
    assert [tuple(r) for r in last_month(spark.createDataFrame(data, PARTS)).collect()] == [("f", "2024-02-10", 8, 1, 2)]
    assert last_month(spark.createDataFrame([], PARTS)).count() == 0
