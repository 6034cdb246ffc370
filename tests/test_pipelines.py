"""Traces, catalogs, estimates, sources, sinks, policies and streams on small literal cases."""

import json
import random
import statistics
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paretoflow.operators import catalogs, estimates, traces
from paretoflow.plans import policy
from paretoflow.sources import files, sinks
from paretoflow.streaming import traces as streams


def trace(**more):
    base = {
        "timestamp": datetime(2024, 1, 1), "workload_id": "w", "workload_version": "1", "work_unit_id": "u1", "offering_id": "o",
        "request_id": "r1", "attempt_id": "a1", "work_unit_success": Decimal(1), "input_uncached_tokens": Decimal(100),
        "input_cache_read_tokens": Decimal(500), "other_cost_usd": Decimal("0.1"), "ttft_ms": Decimal(100),
    }
    return base | more


def frame(spark, *rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in traces.SCHEMA} for r in rows], traces.SCHEMA)


def some_rows(seed, n=60):
    """Random requests of four work units; one unit fails."""
    r = random.Random(seed)
    units = [f"unit-{k}" for k in range(4)]
    return [
        trace(
            request_id=f"q{k}", work_unit_id=(u := r.choice(units)), attempt_id=f"{u}-{r.randrange(2)}", work_unit_success=Decimal(int(u != "unit-2")),
            input_uncached_tokens=Decimal(r.randrange(900)), input_cache_read_tokens=Decimal(r.randrange(50)), input_cache_write_tokens=Decimal(r.randrange(9)),
            other_cost_usd=Decimal(r.randrange(1000)) / 1000, ttft_ms=Decimal(r.randrange(5000)) if r.random() < 0.7 else None,
        )
        for k in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_traces_to_rates(spark, seed):
    rows = some_rows(seed)
    df = frame(spark, *rows)
    traces.check(df)
    meters = ["input_uncached_tokens", "input_cache_read_tokens", "input_cache_write_tokens", "other_cost_usd", "tool_calls"]
    got = {r["signal"]: r["value"] for r in traces.rates(traces.offerings(traces.work_units(df, meters), meters), meters).collect()}
    units = {r["work_unit_id"] for r in rows}
    wins = len(units - {"unit-2"})
    total = {m: float(sum(r[m] for r in rows)) for m in meters[:4]}
    for m in meters[:4]:
        assert got[f"{m}_per_work_unit"] == pytest.approx(total[m] / len(units)) and got[f"{m}_per_success"] == pytest.approx(total[m] / wins)
    assert got["success_rate"] == pytest.approx(wins / len(units)) and got["request_count_per_success"] == pytest.approx(len(rows) / wins)
    parts = [total[m] for m in meters[:3]]
    assert got["observed_cache_hit_rate"] == pytest.approx(parts[1] / sum(parts)) and "tool_calls_per_success" not in got
    seen = sorted(float(r["ttft_ms"]) for r in rows if r["ttft_ms"] is not None)
    p = traces.latency(df).first()
    assert p["samples"] == len(seen) and float(p["ttft_ms_p50"]) == pytest.approx(statistics.median(seen))
    assert traces.outside_workload(df, "w", "1") == 0 and traces.outside_workload(df, "w", "2") == len(rows)


def test_unknown_meter_and_zero_success(spark):
    df = frame(spark, trace(work_unit_success=Decimal(0)), trace(request_id="r2", work_unit_success=Decimal(0), other_cost_usd=None))
    totals = traces.offerings(traces.work_units(df, ["other_cost_usd"]), ["other_cost_usd"])
    assert totals.first()["other_cost_usd"] is None
    assert {r["signal"] for r in traces.rates(totals, ["other_cost_usd"]).collect()} == {"success_rate", "request_count_per_work_unit"}


def test_scopes_and_cache_writes(spark):
    df = frame(
        spark,
        trace(observation_unit="work_unit", attempt_count=3, model_request_count=7, input_cache_write_5m_tokens=Decimal(1), input_cache_write_1h_tokens=Decimal(2), ttft_ms=None),
        trace(work_unit_id="u2", request_id="r2", observation_unit="attempt", input_cache_write_tokens=Decimal(5)),
    )
    got = {r["work_unit_id"]: r for r in traces.work_units(df).collect()}
    assert (got["u1"]["request_count"], got["u1"]["attempt_count"], got["u1"]["complete_cache_write_tokens"]) == (7, 3, 3)
    assert (got["u2"]["request_count"], got["u2"]["attempt_count"], got["u2"]["complete_cache_write_tokens"]) == (None, 1, 5)


@pytest.mark.parametrize(
    "guard, rows",
    [
        ("invalid_rows", [trace(request_id=" ")]),
        ("invalid_rows", [trace(other_cost_usd=Decimal(-1))]),
        ("invalid_rows", [trace(observation_unit="page")]),
        ("multi_offering", [trace(), trace(request_id="r2", offering_id="p")]),
        ("invalid_rows", [trace(input_cache_write_tokens=Decimal(1), input_cache_write_1h_tokens=Decimal(1))]),
        ("invalid_rows", [trace(input_total_tokens=Decimal(700), input_cache_write_tokens=Decimal(1))]),
        ("invalid_rows", [trace(observation_unit="attempt")]),
        ("invalid_rows", [trace(adapter_id="a")]),
        ("mixed_scope", [trace(), trace(request_id="r2", observation_unit="attempt", ttft_ms=None)]),
        ("duplicate_attempts", [trace(observation_unit="attempt", ttft_ms=None), trace(request_id="r2", observation_unit="attempt", ttft_ms=None)]),
        ("inconsistent_outcome", [trace(), trace(request_id="r2", work_unit_success=Decimal(0))]),
        ("duplicate_requests", [trace(), trace(work_unit_id="u2")]),
    ],
)
def test_guards(spark, guard, rows):
    with pytest.raises(traces.TraceError, match=f"^{guard}$"):
        traces.check(frame(spark, *rows))


def test_enrichment_refuses_unknown_offerings(spark):
    catalog, summary = spark.createDataFrame([("a",), ("b",)], "offering_id string"), spark.createDataFrame([("a", 1)], "offering_id string, n int")
    assert {tuple(r) for r in traces.enrich(catalog, summary).collect()} == {("a", 1), ("b", None)}
    with pytest.raises(traces.TraceError):
        traces.enrich(catalog.filter("offering_id = 'b'"), summary)


LONG = "offering_id string, signal string, value int, unit string"


def test_compose_and_enrich(spark):
    one = spark.createDataFrame([("a", "x", 1, "u"), ("b", "x", 2, "u")], LONG)
    same, other = one.filter("offering_id = 'a'"), spark.createDataFrame([("a", "x", 9, "u")], LONG)
    assert catalogs.compose_strict([one, same]).count() == 2
    with pytest.raises(catalogs.CatalogError):
        catalogs.compose_strict([one, other])
    mapping = spark.createDataFrame([("s", "a")], "source_id string, target_id string")
    extra = spark.createDataFrame([("s", "y", 5, "u"), ("t", "y", 6, "u")], LONG)
    assert ("a", "y", 5, "u") in {tuple(r) for r in catalogs.enrich_across(one, extra, mapping, ["y"]).collect()}
    for source, target, signal in (("gone", "a", "y"), ("s", "gone", "y"), ("s", "a", "z")):
        with pytest.raises(catalogs.CatalogError):
            catalogs.enrich_across(one, extra, spark.createDataFrame([(source, target)], "source_id string, target_id string"), [signal])


def test_reconcile_outcomes(spark):
    evidence = spark.createDataFrame([(k, "s", k != 3) for k in range(1, 9)], "row_id int, subject_sha256 string, valid boolean")
    rows = [(1, "s", "ok", 1, True), (2, "t", "ok", 2, True), (3, "s", "ok", 3, True), (4, "s", "mutable_alias", 4, True), (5, "s", "ok", None, True),
            (6, "s", "ok", 7, True), (7, "s", "ok", 7, True), (9, "s", "ok", 9, True), (8, "s", "ok", 8, False)]
    reviewed = spark.createDataFrame(rows, "row_id int, subject_sha256 string, status string, offering_id int, allowed boolean")
    got = {r["row_id"]: r["outcome"] for r in catalogs.reconcile(evidence, reviewed).collect()}
    assert got == {1: "mapped", 2: "identity_drift", 3: "invalid_result", 4: "mutable_alias", 5: "unmapped", 6: "duplicate_target",
                   7: "duplicate_target", 8: "license_blocked", 9: "missing_required_row"}


def test_views_portfolio_capacity_basis(spark):
    panel = spark.createDataFrame([("m", "e1"), ("m", "e2"), ("k", "e1"), ("k", "e2")], "model string, environment string")
    seen = spark.createDataFrame([("m", "e1", 1.0), ("m", "e2", 3.0), ("k", "e1", 5.0)], "model string, environment string, v double")
    assert {r["model"]: r["v"] for r in catalogs.balanced(seen, "model", panel, ["v"]).collect()} == {"m": 2.0, "k": None}
    est = spark.createDataFrame([("a", "x", 5), ("a", "y", 3), ("b", "y", 9)], "candidate string, component string, deadline int")
    got = {r["candidate"]: (r["eligible"], r["deadline"]) for r in catalogs.portfolio(est, est.select("candidate").distinct(), ["x", "y"], ["x"], 2).collect()}
    assert got == {"a": (True, 3), "b": (False, 9)}
    recs = spark.createDataFrame([("k", True, 5, 1, 1), ("k", True, 9, 1, 2), ("k", False, 99, 1, 3), ("j", False, 4, 1, 4)], "key string, passed boolean, size int, at int, id int")
    assert {r["key"]: r["id"] for r in catalogs.arg_max_capacity(recs, "key", "passed", "size", "at", "id").collect()} == {"k": 2, "j": 4}
    groups = {
        ("included", "included"): "included", ("provider_reported",): "provider_reported", ("provider_reported", "estimated"): "estimated", ("estimated",): "estimated",
        ("included", "provider_reported"): "unknown", ("included", "estimated"): "unknown", ("unknown", "included"): "unknown", ("provider_reported", None): "unknown",
    }
    rows = [(k, b, 1.0) for k, g in enumerate(groups) for b in g] + [(99, "included", None)]
    bases = spark.createDataFrame(rows, "k int, basis string, amount double").groupBy("k").agg(catalogs.combined_basis("basis", "amount").alias("b"))
    assert {r["k"]: r["b"] for r in bases.collect()} == dict(enumerate(groups.values())) | {99: "unknown"}


def test_estimates(spark):
    items = spark.createDataFrame([("g", 1, 3, 2), ("g", 4, 2, 1)], "k string, a int, c int, w int")
    assert estimates.paired_delta(items, ["k"], F.col("a"), F.col("c"), F.col("w")).first()["delta"] == pytest.approx(2 / 3, abs=1e-6)
    row = spark.range(1).select(*estimates.paired_interval(*(F.lit(float(x)) for x in (98, 1, -1, 4, 0.5)))).first()
    assert tuple(row) == (99.0, 96.5, 100.0)
    on = spark.createDataFrame([("a", k, k in (1, 2, 5)) for k in range(7)], "k string, t int, f boolean")
    assert {(r["run_start"], r["run_end"], r["run_length"]) for r in estimates.islands(on, ["k"], ["t"], F.col("f")).collect()} == {(1, 2, 2), (5, 5, 1)}
    rows = spark.range(400).withColumn("one", F.lit(1)).withColumn("x", F.col("id") % 2)
    draws = estimates.bootstrap(rows.withColumn("g", F.lit(0)), ["g"], ["x", "one"], "id", 50, 3).collect()
    assert len(draws) == 50 and abs(sum(r["x"] / r["one"] for r in draws) / 50 - 0.5) < 0.02
    assert {tuple(r) for r in estimates.bootstrap(rows.withColumn("g", F.lit(0)).repartition(3), ["g"], ["x", "one"], "id", 50, 3).collect()} == {tuple(r) for r in draws}


CATALOG = {
    "schema_version": "1", "workload": {"id": "w", "version": "1", "unit": "task"},
    "offerings": [
        {"offering": {"offering_id": o, "provider": p, "region": "eu", "capabilities": ["tools"]}, "metadata": {"k": "v"},
         "signals": {"cost": {"value": c, "unit": "usd", "evidence_tier": "measured", "observed_at": "2024-01-01T00:00:00Z", "sample_count": 5},
                     "score": {"value": s, "unit": "percent", "evidence_tier": t, "observed_at": "2024-01-01T00:00:00Z", "sample_count": 5}},
         "default_source": {"id": "src", "version": "1"}}
        for o, p, c, s, t in (("a", "p", "0.10", "50", "measured"), ("b", "p", "0.20", "40", "measured"), ("c", "q", "0.50", "90", "measured"),
                              ("d", "q", "0.01", "99", "estimated"), ("e", "z", "0.01", "99", "measured"))
    ],
}
POLICY = """
workload: {tasks: 2}
metrics:
  cost: {unit: usd, expression: signals.cost * workload.tasks}
  score: {unit: percent, signal: score, requirements: {max_age_hours: 48, minimum_samples: 2}}
frontiers:
  main:
    providers: [p, q]
    capabilities: [tools]
    axes: [{metric: cost, goal: min, epsilon_relative: 0.02}, {metric: score, goal: max}]
"""


def test_policy_over_a_catalog_file(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps(CATALOG))
    catalog = files.read_catalog(spark, str(tmp_path / "catalog.json"))
    assert catalog.count() == 10 and files.source_conflicts(catalog).count() == 0
    project = policy.load(POLICY)
    members, evaluated, rejected = policy.evaluate(project, "main", catalog, "2024-01-02 00:00:00")
    assert [(r["offering_id"], r["rank"], r["cost"]) for r in members.orderBy("rank").collect()] == [("a", 1, Decimal("0.2")), ("c", 2, Decimal("1"))]
    assert {r["offering_id"]: r["dominated_by"] for r in evaluated.collect()} == {"a": [], "b": ["a"], "c": []}
    assert {r["offering_id"]: r["reasons"] for r in rejected.collect()} == {"d": ["score:tier_not_accepted"], "e": ["provider_not_allowed"]}
    with pytest.raises(policy.PolicyError):
        policy.load("frontiers: {f: {axes: [{metric: x, goal: min}, {metric: x, goal: max}]}}")
    with pytest.raises(policy.PolicyError):
        policy.load("nothing: 1")
    with pytest.raises(policy.PolicyError):
        policy.load("workload: {x: .inf}")


def test_trace_files(spark, tmp_path):
    frame(spark, *some_rows(3, 3)).write.parquet(f"{tmp_path}/t.parquet")
    assert files.read_traces(spark, f"{tmp_path}/t.parquet").count() == 3
    (tmp_path / "t.jsonl").write_text(json.dumps({"workload_id": "w", "other_cost_usd": "0.25", "timestamp": "2024-01-01T00:00:00Z"}) + "\n")
    assert files.read_traces(spark, f"{tmp_path}/t.jsonl").first()["other_cost_usd"] == Decimal("0.25")
    for name, column in (("a", F.lit(1.5).alias("tool_calls")), ("b", F.lit(1).alias("secret")), ("c", F.current_timestamp().cast("timestamp_ntz").alias("timestamp"))):
        spark.range(1).select(column).write.parquet(f"{tmp_path}/{name}.parquet")
        with pytest.raises(traces.TraceError):
            files.read_traces(spark, f"{tmp_path}/{name}.parquet")


def test_small_sources(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><guid>g1</guid><pubDate>d</pubDate></item><item><title>U</title><link>l</link></item></channel></rss>")
    found = files.read_feed(spark, str(tmp_path / "feed.xml")).collect()
    assert {r["title"] for r in found} == {"T", "U"} and all(len(r["offering_id"]) == 21 for r in found)
    (tmp_path / "models.json").write_text(json.dumps({"data": [{"id": "a/b", "context_length": 5, "pricing": {"prompt": "0.000001", "completion": "x"}}, {"id": "c"}]}))
    rows = {r["offering_id"]: r for r in files.read_model_list(spark, str(tmp_path / "models.json")).collect()}
    assert rows["a/b"]["prompt_price"] == Decimal("0.000001") and rows["a/b"]["completion_price"] is None and rows["c"]["context_length"] is None
    head = "ctx_tokens,prefill_tokens,prefill_tps,gen_tokens,gen_tps,gen_first_ms,gen_steady_tokens,gen_steady_tps,kvcache_bytes\n"
    (tmp_path / "bench.csv").write_text(head + "10,1,1,1,5,1,1,1,1\n20,1,1,1,7,1,1,1,1\n")
    assert files.read_context_bench(spark, str(tmp_path / "bench.csv")).first()["gen_tps"] == 7
    assert files.read_context_bench(spark, str(tmp_path / "bench.csv"), 10).first()["gen_tps"] == 5
    (tmp_path / "log.txt").write_text("x\nPrompt: 10 tokens, 12.5 tokens-per-sec\nGeneration: 5 tokens, 3.0 tokens-per-sec\n")
    assert {r["phase"]: r["tokens_per_second"] for r in files.read_speed_text(spark, str(tmp_path / "log.txt")).collect()} == {"prompt": 12.5, "generation": 3.0}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, None)], "rank int, name string")
    assert sinks.digest(df) == sinks.digest(df.repartition(5)) != sinks.digest(df.limit(1))
    root = str(tmp_path / "pub")
    first = sinks.publish(df, root, "f", "2024-01-01")
    assert sinks.publish(df, root, "f", "2024-01-02") == first
    second = sinks.publish(df.limit(1), root, "f", "2024-01-03")
    assert second != first and sinks.latest(spark, root, "f").count() == 1
    sinks.write_safe_csv(df, str(tmp_path / "csv"))
    assert "'=x" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_streams(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    rows = [("o", "r1", at(1), 1), ("o", "r1", at(1, 5), 1), ("o", "r2", at(1, 10), 2), ("o", "r3", at(9), 4)]
    schema = "offering_id string, request_id string, timestamp timestamp, spend int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["request_id"] for r in run(streams.deduplicated(stream()), "dedup")) == ["r1", "r2", "r3"]
    totals = run(streams.windowed_totals(stream(), "1 hour"), "totals", "complete")
    assert sorted((r["requests"], r["spend"]) for r in totals) == [(1, 4), (3, 4)]
    assert len(run(streams.sessions(stream()), "sessions", "complete")) == 2
    up = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 2, "c"), ("t", 1, "x")], "selection_id string, generated_at int, digest string")
    got = {r["selection_id"]: (r["generated_at"], r["equivocated"]) for r in streams.newest(up).collect()}
    assert got == {"s": (2, True), "t": (1, False)}


def test_exact_environments(spark):
    sets = {"all": "abc", "few": "a", "more": "abcd", "other": "ad", "apart": "x", "none": ""}
    rows = spark.createDataFrame([(m, e) for m, v in sets.items() for e in (v or [None])] + [("all", "a")], "m string, e string")
    required = spark.createDataFrame([("p", e) for e in "abca"] + [("q", "x"), ("q", None)], "p string, e string")
    found = {(r["p"], r["m"]): r["verdict"] for r in catalogs.exact_environments(rows, required, "m", "e", "p").collect()}
    assert found == {("p", "all"): "exact", ("p", "few"): "too_few", ("p", "more"): "too_many", ("p", "other"): "different", ("q", "apart"): "exact"}
