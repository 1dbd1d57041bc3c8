from datetime import UTC, datetime

import pytest

from lodestone.operators.filters import compile_filters

SCHEMA = "id int, s string, n double, k int, flag boolean, t timestamp, z timestamp_ntz, tags array<string>, nums array<double>, release_date string, num_text string, missing string"
T0 = datetime(2024, 5, 1, 12, tzinfo=UTC)
ROW = (1, "hello world", 10.5, 10, True, T0, datetime(2024, 5, 1, 12), ["a", "b"], [1.0, 5.0], "2024-05-01T12:00:00Z", "10", None)

CASES = [
    ("s", "", "hello world", True),
    ("s", "", "Hello world", False),
    ("s", "_ne", "x", True),
    ("s", "_contains", "WORLD", True),
    ("s", "_contains", "xyz", False),
    ("s", "_ncontains", "xyz", True),
    ("s", "_contains", 5, False),
    ("s", "_gt", "hello", True),
    ("s", "", 123, False),
    ("n", "", 10.5, True),
    ("n", "", 10, False),
    ("n", "", "10.5", True),
    ("n", "", "not-a-number", False),
    ("n", "_gte", 10.5, True),
    ("n", "_gte", 10.4, True),
    ("n", "_gte", "10.0", True),
    ("n", "_gt", 10.4, True),
    ("n", "_gt", 10.5, False),
    ("n", "_ncontains", "x", True),
    ("k", "", 10, True),
    ("k", "", 10.0, True),
    ("k", "", 11, False),
    ("k", "", "10", True),
    ("flag", "", True, True),
    ("flag", "", False, False),
    ("flag", "_gt", True, False),
    ("t", "_gte", "2024-05-01T12:00:00Z", True),
    ("t", "_gt", "2024-05-01T12:00:00Z", False),
    ("t", "_lt", "2024-05-02", True),
    ("t", "", 12345, False),
    ("z", "_lte", "2024-05-01 12:00:00", True),
    ("tags", "_contains_any_of", ["b", "c"], True),
    ("tags", "_contains_any_of", ["c", "d"], False),
    ("tags", "_contains_any_of", "b", False),
    ("tags", "_contains", "A", True),
    ("tags", "", "c", False),
    ("tags", "_exact", "a", True),
    ("tags", "_ne", "a", False),
    ("tags", "_gt", "a", True),
    ("nums", "_gte", 5, True),
    ("nums", "_lt", 1, False),
    ("s", "_contains_any_of", ["x", "hello world"], True),
    ("release_date", "", "2024-05-01T14:00:00+02:00", True),
    ("release_date", "_contains", "2024", False),
    ("release_date", "_ncontains", "2024", True),
    ("release_date", "_gt", "2024-04-30", True),
    ("num_text", "_gt", "9", True),
    ("num_text", "_gt", 9, True),
    ("num_text", "", 10, True),
    ("num_text", "", "10.0", False),
    ("missing", "_ne", "x", False),
    ("missing", "_ncontains", "x", False),
    ("absent", "_ne", "x", False),
    ("s", "_unknown", "hello world", True),
    ("s", "", None, False),
    ("s", "_ne", None, True),
]


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([ROW], SCHEMA).cache()


def test_truth_table(row):
    conditions = [compile_filters(row, {"filters": [{"field": f, "operator": o, "value": v}]})[0].alias(f"c{i}") for i, (f, o, v, _) in enumerate(CASES)]
    got = row.select(*conditions).first()
    wrong = [(c, g) for c, g in zip(CASES, got, strict=True) if bool(g) is not c[3]]
    assert not wrong


def leaf(field, operator, value, score=0.0):
    return {"field": field, "operator": operator, "value": value, "score": score}


def test_groups_and_scores(row):
    yes, no = leaf("s", "_contains", "hello", 2.0), leaf("s", "_contains", "zzz", 9.0)
    trees = [
        ({"operator": "AND", "filters": [yes, leaf("k", "", 10, 3)]}, True, 5.0),
        ({"operator": "AND", "filters": [yes, no]}, False, 0.0),
        ({"operator": "or", "filters": [yes, no]}, True, 2.0),
        ({"filters": [no]}, False, 0.0),
        ({}, True, 0.0),
        (None, True, 0.0),
        ({"operator": "OR", "filters": [no], "groups": [{}]}, True, 0.0),
        ({"operator": "XOR", "filters": [yes, no]}, True, 2.0),
        ({"operator": "AND", "groups": [{"filters": [yes, no]}, {"operator": "OR", "filters": [leaf("flag", "", True, 3), leaf("n", "_gte", 8, 2.5)]}]}, True, 7.5),
    ]
    for tree, expected, score in trees:
        m, s = compile_filters(row, tree)
        got = row.select(m, s).first()
        assert (bool(got[0]), got[1]) == (expected, score), tree


def test_filter_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    m, _ = compile_filters(orders, {"operator": "AND", "filters": [leaf("o_totalprice", "_gt", 1000), leaf("o_orderstatus", "", "F")]})
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = orders.where(m).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "EqualTo(o_orderstatus,F)" in plan
