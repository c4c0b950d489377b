from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators.snapshots import report_changes, snapshot_changes

COLUMNS = (
    "database_name string, report_id string, scan_time timestamp, view_name string, name string, directory string, component string, "
    "complexity__lines long, complexity__indentation__max long, complexity__indentation__avg double, modularity__types__total long, "
    "complexity__files long, change string, _snap string"
)


def at(day):
    return dt.datetime(2024, 1, day)


def row(report, day, name, lines=1, avg=1.0, directory="d", db="db"):
    return (db, report, at(day), "files", name, directory, "c", lines, 1, avg, 1, None, "clash", "clash")


def changes(spark, data):
    out = report_changes(spark.createDataFrame(data, COLUMNS)).collect()
    return sorted((r["report_id"], r["name"], r["change"]) for r in out)


def test_cases(spark):
    data = [
        row("z", 1, "a"), row("z", 1, "./b", avg=0.5), row("z", 1, "gone"), row("z", 1, None), row("z", 1, "null", directory=""),
        # delivered twice: only the later delivery counts
        row("y", 2, "a", lines=99), row("y", 3, "a"), row("y", 3, "a"), row("y", 3, "b", avg=0.50000000001), row("y", 3, "new"),
        row("y", 3, "null", directory=None), row("y", 3, ""),
        row("x", 4, "a", lines=2), row("x", 4, "b", avg=0.500001), row("x", 4, "new"), row("x", 4, "null", directory="e"),
    ]
    assert changes(spark, data) == [
        ("x", "a", "changed"), ("x", "b", "changed"), ("x", "null", "changed"), ("y", "gone", "removed"), ("y", "new", "added"),
    ]


def test_empty_snapshot_and_single_and_no_rows(spark):
    assert changes(spark, [row("a", 1, "x"), row("b", 2, None)]) == [("b", "x", "removed")]
    assert changes(spark, [row("a", 1, "x")]) == []
    assert report_changes(spark.createDataFrame([], COLUMNS)).count() == 0


def test_different_rows_of_one_key_are_a_set(spark):
    a, b = row("a", 1, "x", lines=1), row("a", 1, "x", lines=2)
    again = [row("b", 2, "x", lines=2), row("b", 2, "x", lines=1)]
    assert changes(spark, [a, b, *again]) == []
    assert changes(spark, [a, b, again[0]]) == [("b", "x", "changed")]


def test_one_of_many_rows_of_a_key_changes(spark):
    keys = [f"k{k}" for k in range(20)]
    before = [row("a", 1, k, lines=n) for k in keys for n in range(20)]
    after = [row("b", 2, k, lines=n if n != 7 else 99) for k in keys for n in reversed(range(20))] + [row("b", 2, k, lines=3) for k in keys]
    assert changes(spark, before + after) == sorted(("b", k, "changed") for k in keys)
    assert changes(spark, before + [row("b", 2, k, lines=n) for k in keys for n in [*reversed(range(20)), 3]]) == []


@pytest.mark.parametrize("seed", range(3))
def test_sets_of_one_to_forty_rows_a_key(spark, seed):
    """Any one row replaced, added or left out of the rows of a key is seen; order and repetition are not."""
    rng = random.Random(seed)
    data, want = [], []
    for k in range(400):
        held = rng.sample(range(10_000), rng.randint(1, 40))
        later = list(held)
        kind = rng.choice(("same", "replaced", "more", "less"))
        if kind == "replaced":
            later[rng.randrange(len(later))] = 20_000 + k
        elif kind == "more":
            later.append(20_000 + k)
        elif kind == "less" and len(later) > 1:
            later.pop(rng.randrange(len(later)))
        else:
            kind = "same"
        rng.shuffle(later)
        data += [("s", "r1", at(1), f"k{k}", v) for v in held] + [("s", "r2", at(2), f"k{k}", v) for v in later + later[: rng.randint(0, 3)]]
        want += [] if kind == "same" else [f"k{k}"]
    df = spark.createDataFrame(data, "s string, r string, t timestamp, k string, v int")
    got = sorted((x["r"], x["k"], x["change"]) for x in snapshot_changes(df, "s", "r", "t", ("k",), ("v",)).collect())
    assert got == sorted(("r2", k, "changed") for k in want)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 1))), max_size=25))
def test_against_brute_force(spark, data):
    df = spark.createDataFrame([("s", f"r{n}", at(n + 1), k, v) for n, k, v in data], "s string, r string, t timestamp, k string, v int")
    got = sorted((x["r"], x["k"], x["change"]) for x in snapshot_changes(df, "s", "r", "t", ("k",), ("v",)).collect())
    reports = sorted({n for n, _, _ in data})
    held = {n: {} for n in reports}
    for n, k, v in data:
        held[n].setdefault(k, set()).add(v)
    want = []
    for p, q in zip(reports, reports[1:], strict=False):
        for k in held[p].keys() | held[q].keys():
            if k not in held[p]:
                want.append((f"r{q}", k, "added"))
            elif k not in held[q]:
                want.append((f"r{q}", k, "removed"))
            elif held[p][k] != held[q][k]:
                want.append((f"r{q}", k, "changed"))
    assert got == sorted(want)
