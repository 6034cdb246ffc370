"""Documents, oracles, evidence, speech estimates, runtime benchmarks and feeds against plain Python."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from paretoflow.operators import catalogs, estimates, evidence, local
from paretoflow.operators.oracles import OracleError, Oracles
from paretoflow.plans import policy
from paretoflow.sources import documents, imports, sinks


def distance(a, b):
    """Word errors by the whole table."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
    return rows[-1][-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_alignment(a, b):
    s, d, i, n = estimates.aligned(a, b)
    assert s + d + i == distance(a, b) and d - i == len(a) - len(b) and min(s, d, i) >= 0 and n == len(a)


def test_word_errors_of_nulls(spark):
    rows = spark.createDataFrame([("a b c", "a x c d"), (None, "a"), ("a", None), ("", "")], "r string, h string")
    got = [tuple(x["e"]) for x in rows.select(estimates.word_errors(F.col("r"), F.col("h")).alias("e")).collect()]
    assert got == [(1, 0, 1, 3), (0, 0, 1, 0), (0, 1, 0, 1), (0, 0, 0, 0)]


def test_grids_must_match(spark):
    full = [(s, t, 1) for s in (1, 2) for t in "ab"]
    make = lambda rows: spark.createDataFrame(rows, "s int, t string, n int")
    assert estimates.paired_grid(make(full), make(full), ["s", "t"], ["n"]).count() == 4
    for left, right in ((full, full[:3]), (full[:3], full[:3]), (full, full[:3] + [(2, "b", 9)]), (full + full[:1], full)):
        with pytest.raises(estimates.GridError):
            estimates.paired_grid(make(left), make(right), ["s", "t"], ["n"])


def test_oracles(spark):
    known = Oracles()

    @F.pandas_udf("double")
    def twice(x):
        return x * 2

    def score(offering, signals, metadata):
        o = signals["cost"]
        return o.withField("value", twice(o["value"].cast("double")).cast("decimal(38,12)")).withField("unit", F.lit("points"))

    known.register("double", "1", score)
    with pytest.raises(OracleError):
        known.register("double", "1", score)
    observation = "struct<value:decimal(38,12),unit:string,evidence_tier:string,lower:decimal(38,12),upper:decimal(38,12),sample_count:bigint,observed_at:timestamp,source:struct<id:string>>"
    rows = spark.createDataFrame([("a", 3), ("b", 2), ("c", 9)], "offering_id string, v int").select(
        "offering_id", F.lit("p").alias("provider"), F.lit("eu").alias("region"), F.array().cast("array<string>").alias("capabilities"),
        F.explode(F.array(F.lit("cost"), F.lit("age"))).alias("signal"), F.col("v").cast("decimal(38,12)").alias("value"), F.lit("usd").alias("unit"), F.lit("measured").alias("evidence_tier"),
        *[F.lit(None).cast("decimal(38,12)").alias(c) for c in ("lower", "upper")], F.lit(1).cast("bigint").alias("sample_count"),
        F.lit("2024-01-01").cast("timestamp").alias("observed_at"), F.struct(F.lit("s").alias("id")).alias("source"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"),
    )
    assert observation
    project = policy.load("""
metrics: {points: {unit: points, oracle: double@1}, age: {unit: usd, signal: age}, gone: {unit: points, oracle: none@1}}
frontiers: {f: {axes: [{metric: points, goal: max}, {metric: age, goal: min}], maximum: {points: 10}, metadata_fields: [k]}, g: {axes: [{metric: gone, goal: max}, {metric: age, goal: min}]}}
""")
    members, evaluated, rejected = policy.evaluate(project, "f", rows, "2024-01-01 00:00:00", known)
    assert {(r["offering_id"], float(r["points"]), r["metadata"]["k"]) for r in members.collect()} == {("a", 6, "v"), ("b", 4, "v")}
    assert [tuple(r) for r in rejected.collect()] == [("c", ["points:above_maximum"])]
    with pytest.raises(OracleError):
        policy.evaluate(project, "g", rows, "2024-01-01 00:00:00", known)
    with pytest.raises(policy.PolicyError):
        policy.load("metrics: {m: {unit: USD, expression: signals.billed_total_cost_usd + signals.other_usd, cost_basis: billed_total}}")
    with pytest.raises(policy.PolicyError):
        policy.load("metrics: {m: {unit: USD, expression: signals.other_usd * 2}}")
    assert policy.load("metrics: {m: {unit: USD, expression: signals.billed_total_cost_usd / 2, cost_basis: billed_total}}")


def test_documents(spark, tmp_path):
    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    at = lambda k: f"2024-01-0{k}T00:00:00Z"
    history = {"frontier_id": "f", "entries": [{"snapshot_id": "b", "generated_at": at(2)}, {"snapshot_id": "a", "generated_at": at(1)}]}
    found = documents.history_entries(documents.read_document(spark, write("h.json", history), "history")).collect()
    assert [(r["place"], r["snapshot_id"]) for r in found] == [(0, "b"), (1, "a")]
    history["entries"].reverse()
    with pytest.raises(Exception, match="newest first"):
        documents.history_entries(documents.read_document(spark, write("h2.json", history), "history")).collect()
    with pytest.raises(Exception, match="required field"):
        documents.read_document(spark, write("h3.json", {"frontier_id": "f"}), "history").collect()
    with pytest.raises(documents.DocumentError):
        documents.read_document(spark, "x", "novel")
    point = lambda k, v: {"offering": {"offering_id": k}, "axes": {"m": {"value": v, "unit": "u"}}}
    frontier = {"snapshot_id": "s", "frontier_id": "f", "workload": {"id": "w"}, "axes": [{"metric": "m"}], "members": [point("a", "1.5")], "evaluated": [point("a", "1.5"), point("b", "2")],
                "axis_evidence": {"candidates": [point("c", "7")]}}
    read = documents.read_document(spark, write("f.json", frontier), "frontier")
    assert {(r["offering_id"], float(r["value"]), r["member"], r["rank"]) for r in documents.frontier_points(read).collect()} == {("a", 1.5, True, 1), ("b", 2.0, False, None)}
    assert [(r["offering_id"], float(r["value"])) for r in documents.axis_inventory(read).collect()] == [("c", 7.0)]
    rows = {"rights": {"publication_permission": "derived_only"}, "rows": [{"subject": {"row_id": "r"}, "result": {"measurements": [{"id": "q", "role": "quality", "value": "1"}, {"id": "c", "role": "cost"}]}}]}
    row = documents.evidence_rows(documents.read_document(spark, write("e.json", rows), "quality_evidence"))
    got = row.select("row_id", F.size(evidence.quality_only(F.col("result.measurements"))), evidence.permits(F.col("rights.publication_permission"), "full")).first()
    assert tuple(got) == ("r", 1, False)
    empty = {"hardware_id": "h"}
    record = {"measurement_id": "m", "completed_at": at(1), "hardware": empty, "artifact": {"model_id": "x"}, "runtime": {"runtime_id": "r"}, "workload": {"kind": "k"}, "provenance": {"tool": "t"},
              "performance": {"metrics": {"decode": {"unit": "u", "values": ["1.5", "2"]}}}}
    sample = documents.measurement_samples(documents.read_document(spark, write("m.json", record), "local_measurement")).first()
    assert (sample["metric"], [float(v) for v in sample["values"]]) == ("decode", [1.5, 2.0])


def test_evidence_is_refused(spark):
    offerings = spark.createDataFrame([("a", 5)], "offering_id string, context_length int").withColumns({c: F.create_map(F.lit("x"), F.lit("1")) for c in ("pricing", "telemetry")})
    scores = spark.createDataFrame([("b", "q", "m", "l", "1")], "offering_id string, benchmark string, methodology string, evidence_label string, score string")
    with pytest.raises(evidence.EvidenceError):
        evidence.provisional(offerings, scores)
    with pytest.raises(evidence.EvidenceError):
        evidence.provisional(offerings.unionAll(offerings), scores.limit(0))
    catalog = spark.createDataFrame([("a", "k", "s", 1.0, 1.0, 1.0, True)], "offering_id string, key_sha256 string, signal string, value double, lower double, upper double, publication_safe boolean")
    for bad in (("a", "other", "t"), ("a", "k", "s"), ("z", "k", "t")):
        with pytest.raises(evidence.EvidenceError):
            evidence.apply_paired(catalog, spark.createDataFrame([(*bad, 1.0, 1.0, 1.0)], "offering_id string, key_sha256 string, signal string, value double, lower double, upper double"))
    sources = spark.createDataFrame([("s", "MIT"), ("t", None)], "id string, license string")
    evidence.check_public(catalog, sources, ["MIT"], ["t"])
    for args in ((catalog, sources, ["MIT"]), (catalog.withColumn("publication_safe", F.lit(False)), sources, ["MIT"], ["t"]), (catalog, sources.limit(0), ["MIT"])):
        with pytest.raises(evidence.EvidenceError):
            evidence.check_public(*args)
    assert catalogs.superset_missing(sources.select("id"), sources.select("id").limit(1), ["id"]).count() == 1


def test_portfolio_verification(spark):
    rows = spark.createDataFrame([("a", "x", [], 50), ("a", "y", [], 90), ("b", "x", ["missing"], None), ("b", "y", [], 70)], "candidate string, component string, failures array<string>, d int")
    rows = rows.withColumn("deadline", F.timestamp_seconds("d"))
    build = evidence.portfolio_build(rows, ["x"], 2)
    assert {r["candidate"]: (r["eligible"], r["measured"], r["audit"]) for r in build.collect()} == {"a": (True, 2, []), "b": (False, 1, ["x:missing"])}
    at = lambda s: F.timestamp_seconds(F.lit(s))
    check = lambda rec, made, now: tuple(evidence.portfolio_problems(build, rec, at(made), at(now)).first())[1:]
    assert check(build, 10, 20) == (False, False, False) and check(build, 10, 60) == (False, True, False) and check(build, 1000, 20) == (True, False, False)
    assert check(build.filter("candidate = 'a'"), 10, 20) == (False, False, True)


def test_local_records_must_be_comparable(spark):
    base = {"measurement_id": "m", "offering_id": "o", "w": "w", "position": {"seed": "1"}, "cache_state": "disabled", "cache_hits": None, "metrics": {"d": [3.0, 1.0, 2.0, 9.0]}, "input_tokens": 10, "checks": {"retrieval": (3, 4)}}
    schema = "measurement_id string, offering_id string, w string, position map<string,string>, cache_state string, cache_hits array<double>, metrics map<string,array<double>>, input_tokens int, checks map<string,struct<passed:bigint,total:bigint>>"
    make = lambda *more: spark.createDataFrame([base, *({**base, "measurement_id": "n", "offering_id": "p", **m} for m in more)], schema)
    got = {(r["offering_id"], r["signal"]): r["value"] for r in local.local_signals(make({"position": {"seed": "1", "finish_reasons": "x"}}), ["w"]).collect()}
    assert got["o", "local_d"] == 2.5 and got["p", "local_retrieval_success_percent"] == 75.0
    for bad in ({"position": {"seed": "2"}}, {"measurement_id": "m"}, {"offering_id": "o"}, {"w": "v"}, {"cache_state": "hit"}):
        with pytest.raises(local.LocalError):
            local.local_signals(make(bad), ["w"]).collect()
    with pytest.raises(local.LocalError):
        local.local_signals(make({"cache_state": "miss", "cache_hits": [0.0, 2.0]}), ["w"], uncached=True)


def test_runtime_benchmarks(spark):
    schema = "model string, n_prompt int, n_gen int, avg_ts double, stddev_ts double, samples_ts array<double>"
    rows = spark.createDataFrame([("a", 0, 8, 5.0, 0.5, [4.0, 6.0]), ("b", 0, 8, 7.0, None, None), ("a", 9, 0, 50.0, 0.0, []), ("b", 9, 0, 60.0, 0.0, []), ("b", 7, 0, 61.0, 0.0, [])], schema)
    r = imports.fastest_generation(rows, ["model"]).first()
    assert (r["model"], r["toks"], r["stddev"], r["sample_count"], r["prefill_tok_s"], r["prefill_n_prompt"]) == ("b", 7.0, 0.0, 1, 61.0, 7)
    p = imports.fastest_profile(spark.createDataFrame([("x", 3.0, 9.0, 500.0), ("y", 4.0, None, 250.0)], "profile string, gen_tps double, processing_tps double, ttft_ms double")).first()
    assert tuple(p) == ("y", 4.0, None, 0.25)
    e = imports.epoch_rates(spark.createDataFrame([("m", 1e9, 5e8, 2e9), ("m", 5e8, None, 4e9)], "m string, generate_ns double, prefill_ns double, ttft_ns double"), ["m"]).first()
    assert (e["toks"], e["prefill_tok_s"], e["ttft_s"], e["sample_count"]) == (1.5, 2.0, 3.0, 2) and e["stddev"] == pytest.approx(0.5**0.5)


def test_signed_events_and_results(spark):
    usage = "usage struct<input:int,cache_read:int,cache_write:int,output:int,reasoning:int>"
    rows = spark.createDataFrame(
        [(str(k), u, "w", "1", "unit", "run", 1, f"c{k}", "o", (9, 1, 2, o, 3)) for k, (u, o) in enumerate((("request", 7), ("turn", 7), ("request", 2), ("request", 8)))],
        f"event_id string, unit string, workload_id string, workload_version string, work_unit_id string, run_id string, run_attempt int, call_id string, offering_id string, {usage}",
    ).withColumns({"timestamp": F.current_timestamp(), "work_unit_success": F.lit(1)})
    signed = rows.withColumn("signature", F.when(F.col("event_id") != "3", imports.event_signature(b"key")).otherwise("forged"))
    fine, bad = imports.signed_event_traces(signed, b"key")
    assert [(r["observation_unit"], float(r["output_tokens"]), r["model_request_count"]) for r in fine.collect()] == [("model_call", 4.0, None)]
    assert {r["event_id"]: r["reasons"] for r in bad.collect()} == {"1": ["no_request"], "2": ["reasoning_above_output"], "3": ["signature_invalid"]}
    model = "map<string,struct<cost:double,input:int,output:int,cache_read:int,cache_write:int>>"
    messages = spark.createDataFrame([("a", 1.0, {"m": (1.0, 5, 6, 7, 8)}), ("b", 2.0, {"m": (1.0, 5, 6, 7, 8)}), ("c", 2.0, {"m": (1.0, 1, 1, 1, 1), "n": (1.0, 1, 1, 1, 1)})], f"id string, total_cost double, model_usage {model}")
    fine, bad = imports.result_traces(messages)
    assert [float(r["output_total_tokens"]) for r in fine.collect()] == [6.0]
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {"b": ["cost_differs"], "c": ["several_models"]}


def test_feed_text(spark):
    rows = spark.createDataFrame([("f", 1, "s<1>", True, [], [], [], []), ("f", 2, "s2", False, ["a&b"], [], ["x:1->2"], [])],
                                 "frontier_id string, item int, snapshot_id string, baseline_reset boolean, entrants array<string>, removals array<string>, rank_changes array<string>, value_changes array<string>")
    xml = sinks.rss_feed(rows.withColumn("generated_at", F.lit("2024-01-02").cast("timestamp")), "f", "urn:f")
    import xml.etree.ElementTree as ET

    titles = [i.find("title").text for i in ET.fromstring(xml.encode()).iter("item")]
    assert titles == ["Frontier s<1>: baseline reset", "Frontier s2: +1 / -0 / ranks 1 / values 0"]


def test_canonical_order_does_not_depend_on_partitions(spark):
    r = random.Random(1)
    rows = [(f"o{r.randrange(99)}", r.choice("xyz"), None if k % 3 else k) for k in range(40)]
    df = spark.createDataFrame(rows, "offering_id string, provider string, tier int")
    order = lambda d: [x["identity"] for x in evidence.canonical_order(d, d.columns).collect()]
    assert order(df.repartition(5)) == order(df.repartition(2)) == sorted(order(df))


def test_memory_peak_follows_the_given_score(spark, tmp_path):
    """Events far apart: the SQL's score weighs a hundredth of value against a million of event ids; without a score the greatest value counts."""
    rows = [(5, 1, "view", 10.0), (2_000_017, 1, "view", 10.01), (3_000_099, 1, "error", 99.0), (7, 2, "error", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r[0]: tuple(r)[1:] for r in __spark_entry__.queries()["memory_summary"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 2, 99.0, 99, 10.01, 5), 2: (1, 0, 1.0, 7, None, None)}
    samples = spark.createDataFrame([(5, 1, 10.0, 10.0), (2_000_017, 2, 10.01, 10.01), (3_000_000, 3, 10.01, 10.01)], "elapsed long, device long, host double, combined double").withColumn("k", F.lit("a"))
    found = local.memory_summary(samples, ["k"]).first()
    assert (found.peak_combined, found.at_elapsed, found.device_at_peak) == (10.01, 2_000_017, 2)
