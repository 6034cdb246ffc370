"""Imports on small literal files."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from paretoflow.sources import imports


def test_leaderboard(spark):
    rows = [("a", 225, 100, 44.4, 1.0, 2.0, "2024-01-01"), ("b", 200, 100, 50.0, 1.0, 2.0, "2024-01-01"), ("c", 225, 100, 50.0, -1.0, 2.0, "2024-01-01")]
    df = spark.createDataFrame(rows, "dirname string, test_cases int, pass_num_2 int, pass_rate_2 double, total_cost double, seconds_per_case double, date string")
    got = {r["dirname"]: r for r in imports.coding_leaderboard(df, 225).collect()}
    assert got["a"]["reasons"] == [] and got["a"]["low"] < 44.4 < got["a"]["high"]
    assert got["b"]["reasons"] == ["incomplete"] and got["c"]["reasons"] == ["incoherent_rate", "negative_cost"]


def test_sections(spark):
    rows = [("overall", "m", 3, 2, 1.0), ("x", "m", 1, 1, 0.5), ("y", "m", 2, 1, 0.5), ("overall", "k", 3, 2, 1.0), ("x", "k", 3, 1, 1.0)]
    df = spark.createDataFrame(rows, "section string, alias string, tasks int, successes int, cost double")
    assert [r["alias"] for r in imports.section_totals(df).collect()] == ["k"]
    assert [r["section"] for r in imports.same_roster(df).collect()] == ["y"]


def test_instances_and_tasks(spark):
    df = spark.range(1).select(
        F.lit("a").alias("name"), F.lit(50.0).alias("resolved"), F.lit(3.0).alias("cost"),
        F.expr("map('i', named_struct('resolved', true, 'cost', 1.0D, 'calls', 4L), 'j', named_struct('resolved', false, 'cost', 2.0D, 'calls', 5L))").alias("details"),
    )
    r = imports.recomputed_instances(df, 2).first()
    assert (r["verdict"], r["score"], r["sum_calls"]) == ("valid", 50.0, 9)
    assert imports.recomputed_instances(df, 3).first()["verdict"] == "incomplete"
    tasks = spark.createDataFrame([("a", 0.5, "t1", 1.0, 1.0), ("a", 0.5, "t2", 0.0, None)], "name string, reported double, task string, score double, cost double")
    r = imports.task_averages(tasks, 2).first()
    assert (r["average"], r["complete"], r["matches"], r["total_cost"]) == (0.5, True, True, None)


def test_decisions(spark):
    rows = [("r", 1, True, True, True, False, 10), ("r", 2, False, True, True, True, 20), ("r", 3, True, False, False, True, 30), ("r", 4, True, True, False, True, 40)]
    df = spark.createDataFrame(rows, "run string, case int, correct boolean, answered boolean, overridden boolean, base_correct boolean, latency_ms int")
    r = imports.decision_signals(df).first()
    assert (r["accuracy"], r["coverage"], r["rescue"], r["override_harm"]) == (75.0, 75.0, 100.0, 100.0)
    assert float(r["p50"]) == 25.0 and r["autonomous_accuracy"] == pytest.approx(200 / 3)


def test_prices_ledgers_results(spark):
    o = spark.createDataFrame([("a",), ("b",), ("c",)], "offering_id string")
    m = spark.createDataFrame([("a", "p", "x"), ("b", "p", "y"), ("c", "p", "z")], "offering_id string, provider_id string, model_id string")
    p = spark.createDataFrame([("p", "x", 1.0, 2.0, []), ("p", "y", 1.0, 2.0, ["t"])], "provider_id string, model_id string, input double, output double, tiers array<string>")
    assert {r["offering_id"]: r["reason"] for r in imports.with_prices(o, m, p).collect()} == {"a": None, "b": "tiered_price", "c": "price_missing"}
    assert spark.range(1).select(imports.cost_per_turn(*(F.lit(x) for x in (1.0, 2.0, 500_000, 250_000)))).first()[0] == 1.0
    s = spark.createDataFrame([("s", 3, 4), ("t", 3, 4), ("u", 1, 1)], "session_id string, input_tokens int, output_tokens int")
    ledger = spark.createDataFrame([("s", "r", 1, 2, 0.5, "provider_reported"), ("s", "r", 2, 2, 0.5, "estimated"), ("t", "r", 3, 5, 1.0, "unknown"), ("t", "q", 0, 0, None, "unknown")], "session_id string, route string, input_tokens int, output_tokens int, cost double, basis string")
    got = {r["session_id"]: (r["cost"], r["basis"], r["reasons"]) for r in imports.ledger_sessions(s, ledger).collect()}
    assert got["s"] == (1.0, "estimated", []) and got["t"][2] == ["several_routes", "output_differs"] and got["u"][2][0] == "no_ledger"
    usage = "map<string,struct<cost:double,input:bigint,output:bigint>>"
    msgs = spark.createDataFrame([(1, 1.0, {"m": (1.0, 1, 1)}), (2, 2.0, {"m": (1.0, 1, 1)}), (3, 2.0, {"m": (1.0, 1, 1), "k": (1.0, 1, 1)})], f"id int, total_cost double, model_usage {usage}")
    assert {r["id"]: r["reason"] for r in imports.single_model_results(msgs).collect()} == {1: None, 2: "cost_differs", 3: "several_models"}


def test_turns(spark):
    u = (100, 30, 10, 50, 20)
    rows = [("f", 1, "thread.started", None), ("f", 2, "turn.started", None), ("f", 3, "item.completed", None), ("f", 4, "turn.completed", u),
            ("g", 1, "thread.started", None), ("g", 2, "turn.completed", u), ("h", 1, "thread.started", None), ("h", 2, "turn.started", None), ("h", 3, "turn.failed", None)]
    df = spark.createDataFrame(rows, "file string, line int, type string, usage struct<input:int,cached:int,cache_write:int,output:int,reasoning:int>").repartition(4)
    got = {r["file"]: tuple(r)[1:] for r in imports.turn_states(df).collect()}
    assert got == {"f": ("complete", 60, 30, 20), "g": ("invalid", None, None, None), "h": ("failed", None, None, None)}


def test_small_helpers(spark):
    rows = spark.createDataFrame([("a", 80.0, 40.0, 8.0, True, False), ("b", 80.0, 40.0, 8.0, True, True)], "name string, accuracy double, energy_joules double, power_watts double, complete boolean, imputed boolean")
    assert {r["name"]: (r["per_joule"], r["reason"]) for r in imports.efficiency(rows).collect()} == {"a": (2.0, None), "b": (None, "telemetry_incomplete")}
    for key in (b"k", b"long" * 40):
        got = spark.range(1).select(imports.pseudonym(F.lit("session"), key, "run")).first()[0]
        assert got == "run-" + hmac.new(key, b"run\x1fsession", hashlib.sha256).hexdigest()[:32]
    old = spark.createDataFrame([(1, "s", "r", "x"), (2, "s", "r", "x"), (3, "s", "r", "x"), (4, "s", "r", "x")], "row_id int, subject string, result string, raw string")
    new = spark.createDataFrame([(1, "s", "r", "x"), (2, "t", "r", "x"), (3, "s", "q", "x"), (5, "s", "r", "x")], "row_id int, subject string, result string, raw string")
    assert {r["row_id"]: r["change"] for r in imports.feed_change(old, new).collect()} == {2: "subject", 3: "result", 4: "removed", 5: "added"}
    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", None)], "publication_id string, previous_id string")
    assert [r["publication_id"] for r in imports.manifest_chain(chain, "c").collect()] == ["c", "b", "a"]
