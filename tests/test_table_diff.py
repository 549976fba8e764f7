import json
import random

import pytest
from pyspark.sql import functions as F

from gradloom.operators import table_diff as T

RUNS = "run_id string, framework string, status string, config_json string, recorded_at timestamp, extra int"
RESULTS = "run_id string, example_id string, correct int, score double, detail_json string, recorded_at timestamp, fp string, side string, grp string"


def at(n):
    return F.lit(f"2024-01-01 00:00:{n:02d}").cast("timestamp")


def runs(spark, rows):
    raw = spark.createDataFrame([(a, b, c, d, n, 1) for a, b, c, d, n in rows], "run_id string, framework string, status string, config_json string, n int, extra int")
    return raw.withColumn("recorded_at", F.timestamp_seconds("n")).drop("n")


def results(spark, rows):
    raw = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "run_id string, example_id string, correct int, score double, detail_json string, n int, fp string, side string, grp string")
    return raw.withColumn("recorded_at", F.timestamp_seconds("n")).drop("n")


def pair(of="L"):
    return [("L", "ladder", "done", "{}", 1), ("H", "lm_eval_harness", "done", json.dumps({"parity_of": of}), 1)]


def found(spark, run_rows, result_rows):
    got = T.parity_differences(runs(spark, run_rows), results(spark, result_rows))
    return sorted(tuple(r) for r in got.select("run_id", "example_id", "field").collect())


def test_fields_and_sides(spark):
    rows = [
        ("L", "same", 1, 1.0, '{"a": 1, "b": [1.0, 2.0], "c": null}', 1), ("H", "same", 1, 1.0000000004, '{"b":[1.0000000003,2],"a":1.0}', 1),
        ("L", "a", 1, 0.5, '{"x": "s", "y": true}', 1), ("H", "a", None, 0.6, '{"x": "S", "y": 1}', 1),
        ("L", "gone", 1, 1.0, "{}", 1), ("H", "new", 1, 1.0, "{}", 1),
        ("L", "list", 1, 1.0, '{"l": [1, 2]}', 1), ("H", "list", 1, 1.0, '{"l": [1, 2, 3]}', 1),
        ("L", "bad", 1, 1.0, "{broken", 1), ("H", "bad", 1, 1.0, "{}", 1),
        ("L", "inf", 1, float("inf"), '{"v": Infinity}', 1), ("H", "inf", 1, float("inf"), '{"v": Infinity}', 1),
        ("L", "big", 1, 1e300, '{"v": 1e300}', 1), ("H", "big", 1, 1e300, '{"v": 2e300}', 1),
    ]
    assert found(spark, pair(), rows) == [
        ("L", "a", "correct"), ("L", "a", "score"), ("L", "a", "x"), ("L", "a", "y"), ("L", "bad", "detail_json"), ("L", "big", "v"), ("L", "gone", "only_ladder"), ("L", "list", "l"), ("L", "new", "only_harness"),
    ]


def test_the_row_recorded_last_holds(spark):
    rows = [("L", "a", 1, 1.0, "{}", 1), ("L", "a", 0, 1.0, "{}", 2), ("L", "a", 0, 1.0, "{}", 2), ("H", "a", 0, 1.0, "{}", 1), ("H", "a", 0, 1.0, "{}", 1)]
    assert found(spark, pair(), rows) == []
    log = [*pair(), ("H", "lm_eval_harness", "failed", json.dumps({"parity_of": "L"}), 2)]
    assert found(spark, log, [("L", "a", 1, 1.0, "{}", 1)]) == []


def test_nulls_and_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, pair(), []) == []
    assert found(spark, pair("unknown"), [("H", "a", 1, 1.0, "{}", 1)]) == []
    rows = [("L", "a", None, None, None, 1), ("H", "a", None, None, None, 1), ("L", None, 1, 1.0, "{}", 1), (None, "a", 1, 1.0, "{}", 1), ("L", "b", None, None, None, 1), ("H", "b", None, 0.0, None, 1)]
    assert found(spark, pair(), rows) == [("L", "b", "score")]


def test_many_rows_against_brute_force(spark):
    rng = random.Random(5)
    log = [("L", "ladder", "done", "{}", 1)] + [(f"H{i}", "lm_eval_harness", "done", '{"parity_of": "L"}', 1) for i in range(3)]
    base = {f"e{i:04d}": (rng.randint(0, 1), round(rng.random(), 3)) for i in range(800)}
    rows = [("L", k, *v, "{}", 1) for k, v in base.items()]
    want = []
    for h in range(3):
        for k, (c, s) in base.items():
            u = rng.random()
            if u < 0.02:
                want.append((f"H{h}", k, "only_ladder"))
                continue
            if u < 0.06:
                want.append((f"H{h}", k, "correct"))
                c = 1 - c
            rows.append((f"H{h}", k, c, s, "{}", 1))
    got = T.parity_differences(runs(spark, log), results(spark, rows))
    assert sorted(tuple(r) for r in got.select("harness", "example_id", "field").collect()) == sorted(want)


def test_chunks_follow_the_content(spark):
    rows = [("g", f"k{i:04d}", s, i) for s in (0, 1) for i in range(2000) if not (s == 1 and i == 1000)]
    named = T.content_chunks(spark.createDataFrame(rows, "grp string, key string, side int, fp bigint"))
    sizes = [r["n"] for r in named.groupBy("side", "chunk").agg(F.count("*").alias("n")).collect()]
    assert 10 < len(sizes) / 2 < 200
    open_keys = T.differing_keys(spark.createDataFrame(rows, "grp string, key string, side int, fp bigint")).count()
    assert 1 <= open_keys < 1000  # the chunks around the missing row only


@pytest.mark.parametrize(("a", "b", "same"), [(1, 1.0, True), (True, 1, False), (None, None, True), (None, 0, False), ([1, None], [1, None], True), ("a", "a ", False), (1.0, 1.0000005, True), (1.0, 1.00001, False), ({"x": [1]}, {"x": [1], "y": None}, True)])
def test_values_equal(a, b, same):
    assert T.values_equal(a, b) is same
