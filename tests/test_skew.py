from __future__ import annotations

from lodestrata.operators.skew import heavy_keys, per_key_totals


def rows(spark):
    data = [("a", 1, "x")] * 60 + [("b", None, "y")] * 2 + [(None, 5, "z")] * 3 + [("", 1, None)] * 10 + [("c", 2, "x")] * 25
    return spark.createDataFrame(data, "k string, v int, c string").selectExpr("*", "1 AS key_value", "2 AS row_count")


def test_totals_with_null_keys_and_clashing_names(spark):
    got = {r["key_value"]: (r["row_count"], r["s"], r["d"]) for r in per_key_totals(rows(spark), "k", {"s": "v"}, {"d": "c"}).collect()}
    assert got == {"a": (60, 60, 1), "b": (2, 0, 1), None: (3, 15, 1), "": (10, 10, 0), "c": (25, 50, 1)}


def test_two_distinct_counts(spark):
    got = {r["key_value"]: (r["d"], r["e"]) for r in per_key_totals(rows(spark), "k", {}, {"d": "c", "e": "v"}).collect()}
    assert got[None] == (1, 1) and got["b"] == (1, 0)


def test_heavy_keys_are_exact_at_the_bound(spark):
    assert {r["key_value"] for r in heavy_keys(rows(spark), "k", 2).collect()} == {"a", "b", "c"}
    assert {r["key_value"] for r in heavy_keys(rows(spark), "k", 3).collect()} == {"a", "c"}
    assert {r["key_value"] for r in heavy_keys(rows(spark), "k", 60).collect()} == {"a"}


def test_empty(spark):
    assert heavy_keys(rows(spark).limit(0), "k").count() == 0
    assert per_key_totals(rows(spark).limit(0), "k", {"s": "v"}, {"d": "c"}).count() == 0


def test_partial_counts_are_combined_before_the_shuffle(spark):
    plan = per_key_totals(rows(spark), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Exchange hashpartitioning" in plan
