"""Imports of published and private measurement files, as DataFrame plans over parsed rows.

Each function takes rows in the file's own shape and returns accepted rows with derived columns, or
rows with an explicit verdict. Reported totals are recomputed and compared, never trusted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import close, quantile_type7, wilson
from ..functions.text import opaque_id
from ..functions.written import written
from ..operators.admission import reasons
from ..operators.catalogs import combined_basis, cost_meter
from ..operators.traces import SCHEMA
from .rules import json_failures


def coding_leaderboard(rows: DataFrame, expected_cases: int) -> DataFrame:
    """Pass rates with their Wilson interval; ``reasons`` lists what is wrong with a row.

    rows: dirname, test_cases, pass_num_2, pass_rate_2, total_cost, seconds_per_case, date.
    """
    rate = F.round(100 * F.col("pass_num_2") / F.col("test_cases"), 1)
    low, high = wilson(F.col("pass_num_2"), F.col("test_cases"))
    bad = reasons(
        (F.col("dirname").isNull(), "name_missing"),
        (F.col("test_cases") != expected_cases, "incomplete"),
        (~F.col("pass_num_2").between(0, F.col("test_cases")), "count_out_of_range"),
        (F.abs(rate - F.col("pass_rate_2")) > 0.05 + 1e-9, "incoherent_rate"),
        (F.col("total_cost") < 0, "negative_cost"),
    )
    return rows.select("*", low.alias("low"), high.alias("high"), F.to_timestamp("date").alias("observed_at"), bad.alias("reasons"))


def section_totals(rows: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    """Aliases whose overall section disagrees with the sum of the others.

    rows: section, alias, tasks, successes, cost; section ``overall`` sums the rest.
    """
    parts = rows.filter("section <> 'overall'").groupBy("alias").agg(*[F.sum(c).alias(c) for c in ("tasks", "successes", "cost")])
    o, p = rows.filter("section = 'overall'").alias("o"), parts.alias("p")
    joined = o.join(p, F.col("o.alias") == F.col("p.alias"), "full_outer")
    differs = F.lit(False)
    for c in ("tasks", "successes"):
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}"))
    differs = differs | F.coalesce(F.abs(F.col("o.cost") - F.col("p.cost")) > tolerance, F.lit(True))
    return joined.filter(differs).select(F.coalesce("o.alias", "p.alias").alias("alias"))


def same_roster(rows: DataFrame) -> DataFrame:
    """Sections whose set of aliases is not everybody's."""
    everybody = rows.select("alias").distinct().agg(F.count(F.lit(1)).alias("all"))
    # One row: the size of the roster.
    return rows.groupBy("section").agg(F.count_distinct("alias").alias("n")).crossJoin(everybody).filter(F.col("n") != F.col("all")).select("section")


def recomputed_instances(rows: DataFrame, instances: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """Score, cost and calls of each entry, recomputed from its instances, with a verdict.

    rows: name, resolved (reported percent), cost, details map<string, struct<resolved boolean, cost double, calls long>>.
    """
    each = rows.select("name", "resolved", "cost", F.explode_outer("details").alias("instance", "d"))
    sums = each.groupBy("name", "resolved", "cost").agg(
        F.count("instance").alias("instances"),
        F.count_if(F.col("d.resolved")).alias("n_resolved"),
        F.sum("d.cost").alias("sum_cost"),
        F.sum("d.calls").alias("sum_calls"),
    )
    score = F.try_divide(100.0 * F.col("n_resolved"), F.col("instances"))
    verdict = (
        F.when(F.col("instances") != instances, "incomplete")
        .when(F.abs(score - F.col("resolved")) > tolerance, "score_differs")
        .when(F.abs(F.col("sum_cost") - F.col("cost")) > tolerance, "cost_differs")
        .otherwise("valid")
    )
    return sums.select("name", "instances", score.alias("score"), "sum_cost", "sum_calls", verdict.alias("verdict"))


def task_averages(rows: DataFrame, tasks: int = 120, tolerance: float = 1e-9) -> DataFrame:
    """Mean task score over the fixed number of tasks against the reported one, and complete costs.

    rows: name, reported, task, score, cost.
    """
    mean = F.sum("score") / F.lit(float(tasks))
    return rows.groupBy("name", "reported").agg(
        mean.alias("average"),
        (F.count_distinct("task") == tasks).alias("complete"),
        F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")).alias("total_cost"),
    ).withColumn("matches", F.abs(F.col("average") - F.col("reported")) <= tolerance)


def decision_signals(results: DataFrame) -> DataFrame:
    """Signals of a case-by-repetition run: coverage, accuracies, rescues, harms, latency quantiles.

    results: run, case, correct, answered, overridden, base_correct, latency_ms.
    """
    pct = lambda hit, given: F.try_divide(100.0 * F.count_if(hit & given), F.count_if(given))
    everything, answered, over = F.lit(True), F.col("answered"), F.col("overridden")
    shares = results.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        pct(F.col("correct"), everything).alias("accuracy"),
        pct(answered, everything).alias("coverage"),
        pct(F.col("correct"), answered).alias("autonomous_accuracy"),
        pct(F.col("correct"), over & ~F.col("base_correct")).alias("rescue"),
        pct(~F.col("correct"), over & F.col("base_correct")).alias("override_harm"),
    )
    return shares.join(quantile_type7(results, ["run"], "latency_ms", {"p50": "0.5", "p95": "0.95"}), "run", "left")


def with_prices(offerings: DataFrame, mapping: DataFrame, prices: DataFrame) -> DataFrame:
    """Offerings with a reviewed price binding; tiered prices are refused with a reason.

    mapping: offering_id, provider_id, model_id; prices: provider_id, model_id, input, output, tiers.
    """
    bound = offerings.join(mapping, "offering_id").join(prices, ["provider_id", "model_id"], "left")
    why = F.when(F.col("input").isNull() | F.col("output").isNull(), "price_missing").when(F.coalesce(F.size("tiers"), F.lit(0)) > 0, "tiered_price")
    return bound.withColumn("reason", why)


def cost_per_turn(input_price: Column, output_price: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Prices are per million tokens."""
    return (input_price * input_tokens + output_price * output_tokens) / 1_000_000


def ledger_sessions(sessions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sessions whose ledger adds up: one route, equal counters, combined cost basis.

    sessions: session_id, input_tokens, output_tokens; ledger: session_id, route, input_tokens,
    output_tokens, cost, basis.
    """
    per = ledger.groupBy("session_id").agg(
        F.count_distinct("route").alias("routes"), F.sum("input_tokens").alias("l_input"), F.sum("output_tokens").alias("l_output"),
        F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")).alias("cost"), combined_basis("basis", "cost").alias("basis"),
    )
    bad = reasons(
        (F.col("routes").isNull(), "no_ledger"),
        (F.col("routes") > 1, "several_routes"),
        (F.col("input_tokens") != F.col("l_input"), "input_differs"),
        (F.col("output_tokens") != F.col("l_output"), "output_differs"),
    )
    return sessions.join(per, "session_id", "left").select("session_id", "cost", "basis", bad.alias("reasons"))


#: Fixed value: which event may follow which state of one turn.
TURN = {("", "thread.started"): "thread", ("thread", "turn.started"): "turn", ("turn", "item"): "turn", ("turn", "turn.completed"): "complete", ("turn", "turn.failed"): "failed"}


def turn_states(events: DataFrame) -> DataFrame:
    """Final state of each file's event sequence, ``invalid`` where an event is out of place, and its usage.

    events: file, line, type, usage struct<input, cached, cache_write, output, reasoning>. A file is one
    turn, so its events are few.
    """
    kind = F.when(F.col("type").startswith("item."), "item").otherwise(F.col("type"))
    table = F.create_map(*[F.lit(x) for (state, event), after in TURN.items() for x in (f"{state}|{event}", after)])
    ordered = events.groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", kind.alias("kind")))), lambda e: e["kind"]).alias("kinds"),
        F.max_by("usage", F.when(F.col("type") == "turn.completed", F.col("line"))).alias("usage"),
    )
    step = lambda s, k: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("|"), k)), F.lit("invalid"))
    state = F.aggregate("kinds", F.lit(""), step)
    done = state == "complete"
    u = F.col("usage")
    return ordered.select(
        "file",
        state.alias("state"),
        F.when(done, u["input"] - u["cached"] - u["cache_write"]).alias("input_uncached_tokens"),
        F.when(done, u["output"] - u["reasoning"]).alias("visible_output_tokens"),
        F.when(done, u["reasoning"]).alias("reasoning_tokens"),
    )


def single_model_results(messages: DataFrame) -> DataFrame:
    """Result messages of one model whose model cost equals the total.

    messages: id, total_cost, model_usage map<string, struct<cost double, input long, output long>>.
    """
    entry = F.element_at(F.map_values("model_usage"), 1)
    one = F.size("model_usage") == 1
    ok = one & close(entry["cost"], F.col("total_cost"))
    return messages.select(
        "id", F.when(one, F.element_at(F.map_keys("model_usage"), 1)).alias("model"), F.when(ok, entry["cost"]).alias("cost"),
        F.when(~one, "several_models").when(~ok, "cost_differs").alias("reason"),
    )


def efficiency(rows: DataFrame) -> DataFrame:
    """Intelligence per joule and per watt; partial or imputed telemetry is refused.

    rows: name, accuracy, energy_joules, power_watts, complete, imputed.
    """
    good = F.col("complete") & ~F.col("imputed") & (F.col("energy_joules") > 0) & (F.col("power_watts") > 0)
    value = lambda d: F.when(good, F.col("accuracy") / F.col(d))
    return rows.select("name", value("energy_joules").alias("per_joule"), value("power_watts").alias("per_watt"), F.when(~good, "telemetry_incomplete").alias("reason"))


def pseudonym(value: Column, key: bytes, kind: str) -> Column:
    """Keyed HMAC-SHA-256 identifier, separated by kind, from built-in functions."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block) for p in (0x36, 0x5C))
    message = F.concat(F.lit(kind + "\x1f").cast("binary"), value.cast("binary"))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 32))


def feed_change(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """How each row of a feed changed: added, removed, subject, result or raw only.

    Both: row_id, subject, result, raw (digests). Rows without a change are left out.
    """
    p, c = pinned.alias("p"), current.alias("c")
    kind = (
        F.when(F.col("p.row_id").isNull(), "added")
        .when(F.col("c.row_id").isNull(), "removed")
        .when(F.col("p.subject") != F.col("c.subject"), "subject")
        .when(F.col("p.result") != F.col("c.result"), "result")
        .when(F.col("p.raw") != F.col("c.raw"), "raw_only")
    )
    return p.join(c, F.col("p.row_id") == F.col("c.row_id"), "full_outer").select(F.coalesce("p.row_id", "c.row_id").alias("row_id"), kind.alias("change")).filter("change IS NOT NULL")


def manifest_chain(manifests: DataFrame, newest: str) -> DataFrame:
    """Publications from ``newest`` back to the first, by a recursive query over the manifest."""
    manifests.select("publication_id", "previous_id").createOrReplaceTempView("_manifests")
    return manifests.sparkSession.sql(
        """WITH RECURSIVE chain(publication_id, previous_id, depth) AS (
             SELECT publication_id, previous_id, 0 FROM _manifests WHERE publication_id = :newest
             UNION ALL SELECT m.publication_id, m.previous_id, c.depth + 1 FROM chain c JOIN _manifests m ON m.publication_id = c.previous_id)
           SELECT * FROM chain ORDER BY depth""",
        args={"newest": newest},
    )



# Importers that end in trace rows. Each returns (rows of the trace schema, refused rows with reasons).


def as_traces(df: DataFrame) -> DataFrame:
    """All columns of the trace schema, those that the frame lacks as nulls."""
    own = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


def _split(df: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    fine = F.size("reasons") == 0
    return as_traces(df.filter(fine)), df.filter(~fine).select(id_column, "reasons")


def _output(total: Column, reasoning: Column) -> dict[str, Column]:
    """Visible output is known only if both the total and its reasoning part are."""
    return {"output_total_tokens": total, "reasoning_tokens": reasoning, "output_tokens": total - reasoning}


def _costs(basis: Column, amount: Column) -> dict[str, Column]:
    of = lambda *kinds: F.when(basis.isin(*kinds), amount)
    return {"estimated_total_cost_usd": of("estimated"), "provider_reported_total_cost_usd": of("provider_reported"), "provider_marginal_cost_usd": of("included")}


def session_traces(sessions: DataFrame, ledger: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """One work-unit row for each ended session whose summary its ledger's main loop confirms; totals count all its tasks.

    sessions: session_id, ended_at, workload_id, workload_version, offering_id, work_unit_success, model, provider,
    tool_calls, the counters, cost_status, cost_source, estimated, actual; ledger: session_id, task ('' is the main
    loop), model, provider, the counters, cost_status, cost_source, estimated, actual. Counters: api_calls, input,
    cache_read, cache_write, output, reasoning. Session ids leave as keyed hashes.
    """
    counters = ("api_calls", "input", "cache_read", "cache_write", "output", "reasoning")
    basis, amount, problem = cost_meter(F.col("cost_status"), F.col("cost_source"), F.col("estimated"), F.col("actual"))
    rows = ledger.withColumns({"_basis": basis, "_amount": amount, "_problem": problem})
    main = F.col("task") == ""
    per = rows.groupBy("session_id").agg(
        F.count_distinct(F.struct("model", "provider")).alias("_routes"), F.min("model").alias("_model"), F.min("provider").alias("_provider"),
        F.count("_problem").alias("_problems"), combined_basis("_basis", "_amount").alias("_basis"), F.sum("_amount").alias("_amount"),
        *[F.sum(c).alias(f"_{c}") for c in counters], *[F.sum(F.when(main, F.col(c)).otherwise(0)).alias(f"_main_{c}") for c in counters],
    )
    joined = sessions.join(per, "session_id", "left")
    differs = F.lit(False)
    for c in counters:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_main_{c}"))
    why = reasons(
        (F.col("ended_at").isNull(), "active_session"),
        (F.col("_routes").isNull(), "no_ledger"),
        (F.coalesce(F.col("_routes") > 1, F.lit(False)), "several_routes"),
        (F.coalesce((F.col("_model") != F.col("model")) | (F.col("_provider") != F.col("provider")), F.lit(False)), "route_differs"),
        (F.coalesce(F.col("_problems") > 0, F.lit(False)), "cost_contradicted"),
        (F.col("_routes").isNotNull() & differs, "summary_differs"),
    )
    name = lambda prefix: opaque_id(F.col("session_id"), key, prefix, "session:v1")
    found = joined.withColumns(
        {
            "reasons": why, "timestamp": F.col("ended_at"), "observation_unit": F.lit("work_unit"), "work_unit_id": name("work-unit-"), "attempt_id": name("attempt-"),
            "request_id": name("aggregate-"), "attempt_count": F.lit(1), "model_request_count": F.col("_api_calls"), "input_uncached_tokens": F.col("_input"),
            "input_cache_read_tokens": F.col("_cache_read"), "input_cache_write_tokens": F.col("_cache_write"),
        } | _output(F.col("_output"), F.col("_reasoning")) | _costs(F.col("_basis"), F.col("_amount"))
    )
    return _split(found, "session_id")


def usage_report_traces(reports: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """One work-unit row for each usage report whose total is the sum of its exclusive buckets.

    reports: session_id, observed_at, workload_id, workload_version, offering_id, work_unit_success, api_calls, input,
    cache_read, cache_write, output, reasoning, total, cost_status, cost_source, cost, single_route (attested).
    """
    buckets = F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output")
    actual = F.when(F.col("cost_status") == "actual", F.col("cost"))
    basis, amount, problem = cost_meter(F.col("cost_status"), F.col("cost_source"), F.col("cost"), actual)
    why = reasons(
        (F.col("session_id").isNull() | (F.col("session_id") == ""), "session_missing"),
        (~F.coalesce("single_route", F.lit(False)), "route_not_attested"),
        (F.coalesce(F.col("total") != buckets, F.lit(False)), "total_differs"),
        (F.coalesce(F.col("reasoning") > F.col("output"), F.lit(False)), "reasoning_above_output"),
        (problem.isNotNull(), "cost_contradicted"),
    )
    name = lambda prefix: opaque_id(F.col("session_id"), key, prefix, "session:v1")
    found = reports.withColumns(
        {
            "reasons": why, "timestamp": F.col("observed_at"), "observation_unit": F.lit("work_unit"), "work_unit_id": name("work-unit-"), "attempt_id": name("attempt-"),
            "request_id": name("aggregate-"), "attempt_count": F.lit(1), "model_request_count": F.col("api_calls"), "input_uncached_tokens": F.col("input"),
            "input_cache_read_tokens": F.col("cache_read"), "input_cache_write_tokens": F.col("cache_write"),
        } | _output(F.col("output"), F.col("reasoning")) | _costs(basis, amount)
    )
    return _split(found, "session_id")


def turn_traces(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One attempt row for each turn that :func:`turn_states` found complete or failed; a failed one has no usage.

    turns: file, state, usage struct<input, cached, cache_write, output, reasoning>, and the identity columns of a
    trace (workload_id, workload_version, work_unit_id, offering_id, request_id, attempt_id, timestamp, work_unit_success).
    """
    u = F.when(F.col("state") == "complete", F.col("usage"))
    why = reasons(
        (~F.col("state").isin("complete", "failed"), "turn_not_ended"),
        (F.coalesce(u["cached"] + F.coalesce(u["cache_write"], F.lit(0)) > u["input"], F.lit(False)), "cache_above_input"),
        (F.coalesce(u["reasoning"] > u["output"], F.lit(False)), "reasoning_above_output"),
    )
    found = turns.withColumns(
        {
            "reasons": why, "observation_unit": F.lit("attempt"), "input_total_tokens": u["input"], "input_cache_read_tokens": u["cached"],
            "input_cache_write_tokens": u["cache_write"], "input_uncached_tokens": u["input"] - u["cached"] - u["cache_write"],
        } | _output(u["output"], u["reasoning"])
    )
    return _split(found, "file")


def result_traces(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One attempt row for each result message of one model whose cost is the total.

    messages: id, total_cost, model_usage (as in :func:`single_model_results`, with cache_read and cache_write), and a
    trace's identity columns.
    """
    entry, one = F.element_at(F.map_values("model_usage"), 1), F.size("model_usage") == 1
    why = reasons((~one, "several_models"), (one & ~close(entry["cost"], F.col("total_cost")), "cost_differs"))
    found = messages.withColumns({
        "reasons": why, "observation_unit": F.lit("attempt"), "input_uncached_tokens": entry["input"], "input_cache_read_tokens": entry["cache_read"],
        "input_cache_write_tokens": entry["cache_write"], "output_total_tokens": entry["output"], "estimated_total_cost_usd": F.col("total_cost"),
    })
    return _split(found, "id")


def signed_event_traces(events: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """One model-call row for each signed event; ids are keyed hashes of workload, unit, run, attempt and call.

    events: event_id, unit ('request' or 'turn'), signature (of :func:`event_signature`), workload_id, workload_version,
    work_unit_id, run_id, run_attempt, call_id, offering_id, timestamp, work_unit_success, usage struct<input, cache_read,
    cache_write, output, reasoning>. How many requests a call made stays unknown.
    """
    scope = ["workload_id", "workload_version", "work_unit_id", "run_id", "run_attempt"]
    joined = lambda names: F.concat_ws("\x1f", *[F.col(n).cast("string") for n in names])
    u = F.col("usage")
    why = reasons(
        (F.col("unit") != "request", "no_request"),
        (~F.col("signature").eqNullSafe(event_signature(key)), "signature_invalid"),
        (F.coalesce(u["reasoning"] > u["output"], F.lit(False)), "reasoning_above_output"),
    )
    found = events.withColumns(
        {
            "reasons": why, "observation_unit": F.lit("model_call"), "request_id": opaque_id(joined([*scope, "call_id"]), key, "model-call-", "model-call"),
            "attempt_id": opaque_id(joined(scope), key, "attempt-", "attempt"), "input_uncached_tokens": u["input"], "input_cache_read_tokens": u["cache_read"],
            "input_cache_write_tokens": u["cache_write"],
        } | _output(u["output"], u["reasoning"])
    )
    return _split(found, "event_id")


def event_signature(key: bytes) -> Column:
    """Keyed hash of an event's content-free fields."""
    fields = ("event_id", "unit", "workload_id", "workload_version", "work_unit_id", "run_id", "run_attempt", "call_id", "offering_id")
    return opaque_id(F.concat_ws("\x1f", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in fields]), key, "", "event")


def agent_benchmark(tasks: DataFrame, keys: list[str], binary: bool = True) -> DataFrame:
    """Quality evidence of runs of agent tasks: mean score, tool success, 95 % wall time, and a verdict.

    tasks: task_sha256, score_percent, wall_seconds, tool_passed, tool_total, declared (number of tasks), manifest_sha256
    (hash of the run's sorted task digests, one a line).
    """
    digests = F.sha2(F.array_join(F.array_sort(F.collect_list("task_sha256")), "\n"), 256)
    found = tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.count_distinct("task_sha256").alias("_distinct"), F.max("declared").alias("_declared"),
        (digests == F.max("manifest_sha256")).alias("_manifest"), F.avg("score_percent").alias("quality"),
        F.count_if(~F.col("score_percent").isin(0, 100)).alias("_graded"), F.count_if(~F.col("score_percent").between(0, 100)).alias("_outside"),
        F.try_divide(100.0 * F.sum("tool_passed"), F.sum("tool_total")).alias("tool_percent"),
    )
    verdict = (
        F.when(F.col("tasks") != F.col("_declared"), "task_count_differs")
        .when(F.col("_distinct") != F.col("tasks"), "task_repeated")
        .when(F.col("_outside") > 0, "score_out_of_range")
        .when(F.lit(binary) & (F.col("_graded") > 0), "score_not_binary")
        .when(~F.col("_manifest"), "manifest_differs")
        .otherwise("valid")
    )
    wall = quantile_type7(tasks, keys, "wall_seconds", {"p95_wall_seconds": "0.95"}).drop("samples")
    shown = [*keys, "tasks", "quality", "tool_percent", "p95_wall_seconds", "verdict"]
    return found.withColumn("verdict", verdict).join(wall, keys, "left").select(*shown)


#: What a submission to a terminal benchmark must look like.
SUBMISSION = {
    "type": "object", "additionalProperties": False, "required": ["agent", "model", "reported", "trials"],
    "properties": {
        "agent": {"type": "string", "minLength": 1, "maxLength": 256}, "model": {"type": "string", "minLength": 1, "maxLength": 256},
        "url": {"type": "string", "format": "uri"}, "reported": {"type": "number", "minimum": 0, "maximum": 100},
        "trials": {
            "type": "array", "minItems": 1, "uniqueItems": True,
            "items": {
                "type": "object", "additionalProperties": False, "required": ["task", "trial", "passed"],
                "properties": {"task": {"type": "string", "minLength": 1}, "trial": {"type": "integer", "minimum": 1}, "passed": {"type": "boolean"}},
            },
        },
    },
}


def terminal_leaderboard(rows: DataFrame, trials: int) -> DataFrame:
    """Entries of a terminal benchmark with accuracy recomputed from its trials, its standard error and a verdict.

    rows: entry, agent, model, reported (percent), task, trial, passed; ``trials`` are expected for each task.
    """
    per = rows.groupBy("entry", "agent", "model", "reported", "task").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("rate"))
    found = per.groupBy("entry", "agent", "model", "reported").agg(
        F.count(F.lit(1)).alias("tasks"), (100 * F.avg("rate")).alias("accuracy"), (F.min("n") == trials).alias("_least"), (F.max("n") == trials).alias("_most"),
        (100 * F.sqrt(F.sum(F.col("rate") * (1 - F.col("rate")))) / F.count(F.lit(1)) / F.sqrt(F.lit(float(max(1, trials - 1))))).alias("standard_error"),
    )
    verdict = F.when(~(F.col("_least") & F.col("_most")), "trials_missing").when(F.abs(F.col("accuracy") - F.col("reported")) > 0.05 + 1e-9, "accuracy_differs").otherwise("valid")
    return found.select("entry", "agent", "model", "tasks", "accuracy", "standard_error", verdict.alias("verdict"))


def terminal_submissions(texts: DataFrame, trials: int) -> DataFrame:
    """Entries (entry, text) of a terminal benchmark as JSON: those that break the contract are refused with every
    broken rule, the others judged by :func:`terminal_leaderboard`.
    """
    shape = "agent string, model string, reported double, trials array<struct<task:string,trial:bigint,passed:boolean>>"
    judged = texts.select("entry", "text", json_failures(F.col("text"), SUBMISSION).alias("failures"))
    # Written once: both the refused and the judged are read from it.
    judged = written(judged.select("entry", "failures", F.when(F.size("failures") == 0, F.from_json("text", shape)).alias("s")), "submissions")
    # By entry, as are all groups and the join after it.
    whole = judged.filter(F.size("failures") == 0).repartition("entry")
    rows = whole.select("entry", "s.agent", "s.model", "s.reported", F.explode("s.trials").alias("t")).select("*", "t.*").drop("t")
    found = terminal_leaderboard(rows, trials)
    shown = judged.select("entry", "failures").join(found, "entry", "left")
    return shown.withColumn("verdict", F.coalesce("verdict", F.lit("refused")))


# Benchmark files of local runtimes.


def fastest_generation(rows: DataFrame, config: list[str]) -> DataFrame:
    """The fastest generation row of a runtime's benchmark, and the fastest prompt row of the same configuration.

    rows: n_prompt, n_gen, avg_ts, stddev_ts, samples_ts array<double>, and the ``config`` columns.
    """
    timed = rows.filter("avg_ts > 0")
    best = timed.filter("n_gen > 0").agg(F.max_by(F.struct(*config, "n_gen", "avg_ts", "stddev_ts", "samples_ts"), "avg_ts").alias("b"))
    prompts = timed.filter("n_prompt > 0").select(F.struct(*config).alias("c"), "avg_ts", "n_prompt")
    # One row on the left side.
    matched = best.join(prompts, F.struct(*[F.col(f"b.{c}").alias(c) for c in config]).eqNullSafe(F.col("c")), "left")
    top = matched.groupBy("b").agg(F.max("avg_ts").alias("prefill_tok_s"), F.max_by("n_prompt", "avg_ts").alias("prefill_n_prompt"))
    return top.filter("b IS NOT NULL").select(*[f"b.{c}" for c in config], F.col("b.avg_ts").alias("toks"), F.coalesce("b.stddev_ts", F.lit(0.0)).alias("stddev"),
        F.greatest(F.coalesce(F.size("b.samples_ts"), F.lit(0)), F.lit(1)).alias("sample_count"), "prefill_tok_s", "prefill_n_prompt")


def fastest_profile(rows: DataFrame) -> DataFrame:
    """The fastest row of a benchmark with its rates in seconds. rows: profile, gen_tps, processing_tps, ttft_ms."""
    best = rows.filter("gen_tps > 0").agg(F.max_by(F.struct("*"), "gen_tps").alias("b")).filter("b IS NOT NULL")
    return best.select("b.profile", F.col("b.gen_tps").alias("toks"), F.col("b.processing_tps").alias("prefill_tok_s"), (F.col("b.ttft_ms") / 1000).alias("ttft_s"))


def epoch_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median rates and their deviation over epochs of nanosecond timings: generate_ns, prefill_ns (a token), ttft_ns."""
    rate = lambda c: F.try_divide(F.lit(1e9), F.col(c))
    return rows.groupBy(*keys).agg(
        F.median(rate("generate_ns")).alias("toks"), F.median(rate("prefill_ns")).alias("prefill_tok_s"), F.median(F.col("ttft_ns") / 1e9).alias("ttft_s"),
        F.coalesce(F.when(F.count("generate_ns") > 1, F.stddev_samp(rate("generate_ns"))), F.lit(0.0)).alias("stddev"),
        F.greatest(F.count("generate_ns"), F.lit(1)).alias("sample_count"),
    )
