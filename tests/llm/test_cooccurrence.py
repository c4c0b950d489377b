from __future__ import annotations

import itertools
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.llm.cooccurrence import Bounds, together

COLUMNS = "repo string, commit_hash string, file string, component string, cell int, basket string, n int"
LOW = Bounds(least=2, share=2, lift=1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], COLUMNS)


def brute(rows, b):
    commits, touched = defaultdict(set), defaultdict(set)
    for repo, commit, file, comp in rows:
        if commit is None:
            continue
        commits[repo].add(commit)
        if file is not None:
            touched[repo, "file", file].add(commit)
        if comp not in (None, "", "Unknown"):
            touched[repo, "component", comp].add(commit)
    out = {}
    for x, y in itertools.combinations(sorted(touched, key=lambda k: (k[0] or "", k[1], k[2])), 2):
        if x[:2] != y[:2]:
            continue
        both, nx, ny, n = len(touched[x] & touched[y]), len(touched[x]), len(touched[y]), len(commits[x[0]])
        if both >= b.least and both * b.share >= max(nx, ny) and both * n >= b.lift * nx * ny:
            out[x[0], x[1], x[2], y[2]] = (both, nx, ny, n)
    return sorted((k[1:], v) for k, v in out.items())


def run(df, b, block):
    return sorted(
        ((r["item_kind"], r["item_a"], r["item_b"]), (r["n_ab"], r["n_a"], r["n_b"], r["n_commits"])) for r in together(df, b, block).collect()
    )


@pytest.mark.parametrize("block, batch", [(1024, 10000), (2, 10000), (1, 3), (3, 2)])
def test_blocks_and_batches_do_not_matter(spark, block, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = [("r", f"c{c}", f"f{f}", f"k{f % 3}") for c in range(12) for f in range(9) if (c * f) % 4 < 2 or c == 0]
        assert run(frame(spark, rows + rows[:5]), LOW, block) == brute(rows, LOW) != []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from(["r", "s", None]), st.one_of(st.none(), st.sampled_from([f"c{i}" for i in range(8)])),
                  st.one_of(st.none(), st.sampled_from("abcdé")), st.one_of(st.none(), st.sampled_from(["", "Unknown", "x", "y"]))), max_size=80)
)
def test_against_brute_force(spark, rows):
    assert run(frame(spark, rows), LOW, 2) == brute(rows, LOW)


def test_frequent_items_are_pruned_without_loss(spark):
    rows = [("r", f"c{c}", "hot", None) for c in range(40)] + [("r", f"c{c}", f, None) for c in range(6) for f in ("a", "b")]
    assert run(frame(spark, rows), Bounds(), 1024) == brute(rows, Bounds()) == [(("file", "a", "b"), (6, 6, 6, 40))]


def test_items_that_share_an_id_are_told_apart(spark, monkeypatch):
    from lodestrata.llm import cooccurrence

    right = cooccurrence.item_hash
    monkeypatch.setattr(cooccurrence, "item_hash", lambda seed: right(seed) % 2 if seed < 2 else right(seed))
    rows = [("r", f"c{c}", f"f{f}", None) for c in range(8) for f in range(5) if (c + f) % 3]
    assert run(frame(spark, rows), LOW, 1024) == brute(rows, LOW) != []
    monkeypatch.setattr(cooccurrence, "item_hash", lambda seed: right(seed) % 2)
    with pytest.raises(ValueError):
        run(frame(spark, rows), LOW, 1024)


def test_empty(spark):
    assert together(frame(spark, [])).count() == 0
