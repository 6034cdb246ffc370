"""Rules of JSON texts and of whole documents: each is broken once, and named."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from paretoflow.sources import imports, rules

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["a", "n"],
    "properties": {
        "a": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^x"}, "n": {"type": ["integer", "null"], "minimum": 0, "maximum": 10},
        "u": {"type": "string", "format": "uri"}, "c": {"type": "boolean", "const": True}, "odd name": {"type": "number", "exclusiveMinimum": 0.1},
        "t": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number"}, "e": {"type": "string", "enum": ["p", "é"]}}}},
    },
}
CASES = [
    ('{"a":"xy","n":3}', []), ('{"a":"xy","n":null,"extra":1,"b.c":2}', ["$.b.c additionalProperties", "$.extra additionalProperties"]),
    ('{"a":"y","n":10.5}', ["$.a minLength", "$.a pattern", "$.n maximum", "$.n type"]), ('{"n":-1,"a":7}', ["$.a type", "$.n minimum"]), ("{}", ["$.a required", "$.n required"]),
    ('{"a":"xxxxx","n":5.0,"u":"no uri","c":false,"odd name":0.1}', ["$.a maxLength", "$.c const", "$.odd name exclusiveMinimum", "$.u format"]),
    ('{"a":"xé😀","n":10,"u":"https://a.b/c","t":[{"k":1,"e":"é"},{"k":1.5}]}', []), ('{"a":"xx","n":1,"t":[]}', ["$.t minItems"]),
    ('{"a":"xx","n":1,"t":[{"k":1},{"e":"r"},3,{"k":1}]}', ["$.t maxItems", "$.t uniqueItems", "$.t[1].e enum", "$.t[1].k required", "$.t[2] type"]),
    ('{"a":"xx","n":12345678901234567890123456789012345678901234567890}', ["$.n maximum"]),
    ("[1]", ["$ type"]), ('{"a":"xx"', ["$ json"]), ('{"a":"xx","a":"xy","n":1}', ["$ json"]), ("", ["$ json"]), (None, None),
]


def test_every_broken_keyword_is_named(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", rules.json_failures(F.col("t"), SCHEMA).alias("f")).collect()}
    assert got == {i: f for i, (_, f) in enumerate(CASES)}
    assert rows.limit(0).select(rules.json_failures(F.col("t"), SCHEMA)).collect() == []


#: Without a pattern, so that plain texts are judged in batches.
PLAIN = {**SCHEMA, "properties": {k: {n: x for n, x in v.items() if n != "pattern"} for k, v in SCHEMA["properties"].items()}}


def _odd(r, depth=0):
    """A JSON text of what may be seen in two ways: limits, near and long numbers, nulls, escapes, repeated keys, white space."""
    scalars = ["null", "true", "false", "0", "-0", "10", "10.0", "10.0000000000001", "1e1", "0.1", "0.10000000000000000001", "9.9999999999999", "5.5", "-1", "123456789012345678901234567890",
               '"xy"', '"x"', '"xé😀y"', '"\\u0041b"', '"a\\n"', '"p"', '"é"', '"https://a.b/c"', '"https://a b"', '"h:\u2028"', '"\u007f"', "NaN", "01", '"\t"', "\ufeff1"]
    kind = r.random()
    if depth > 2 or kind < 0.6:
        return r.choice(scalars)
    if kind < 0.75:
        return "[" + r.choice(["", " "]) + ",".join(_odd(r, depth + 1) for _ in range(r.randint(0, 4))) + "]"
    return "{" + ",".join(f'"{r.choice(["k", "e", "a", "n", "x.y", "k"])}":{_odd(r, depth + 1)}' for _ in range(r.randint(0, 3))) + "}"


def test_batches_and_variants_judge_alike(spark):
    r, texts = random.Random(4), [t for t, _ in CASES]
    for _ in range(4000):
        parts = [f'"{k}": {r.choice([_odd(r), d, d, d])}' for k, d in (("a", '"xy"'), ("n", "3"), ("u", '"s:t"'), ("c", "true"), ("odd name", "1.5"), ("t", '[{"k":1},{"k":2,"e":"p"}]')) if r.random() < 0.85]
        parts += [f'"t": [{_odd(r)},{_odd(r)}]'] * (r.random() < 0.1) + ['"more": ' + _odd(r)] * (r.random() < 0.1)
        texts.append("{" + ", ".join(parts) + "}" + r.choice(["", "", "", " ", "\n", " 1", "}"]))
    texts += [_odd(r) for _ in range(300)] + ['{"a":"xy","n":1,"deep":' + "[" * n + "]" * n + "}" for n in (400, 800, 1100)]
    judged = rules._judge(json.dumps(PLAIN))
    told = [judged(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for how in (rules.variant_failures, rules.json_failures):
        want = {x.i: x.f for x in rows.select("i", how(F.col("t"), PLAIN).alias("f")).collect()}
        assert [(texts[i], f, want[i]) for i, f in enumerate(told) if f is not None and f != want[i]] == []
    assert sum(f is not None for f in told) > 1000 and len({tuple(f) for f in told if f}) > 60
    assert all(rules._judge(json.dumps(imports.SUBMISSION))(t) is not None for t in ['{"agent":"a","model":"m","reported":33.333333333333336,"trials":[{"task":"0","trial":1,"passed":true}]}', "{}"])


@pytest.mark.parametrize(
    "schema",
    [{}, {"type": "text"}, {"type": "string", "oneOf": []}, {"type": "string", "minimum": 1}, {"type": "number", "minimum": 2, "maximum": 1}, {"type": "string", "pattern": "("},
     {"type": "object", "properties": {}, "required": ["a"]}, {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string", "format": "date"}}}}],
)
def test_schemas_that_would_skip_a_rule_are_refused(spark, schema):
    with pytest.raises(rules.SchemaError):
        rules.json_failures(F.lit("{}"), schema)


def test_submissions_are_refused_recomputed_and_accepted(spark):
    trials = [{"task": t, "trial": k, "passed": t == "one"} for t in ("one", "two") for k in (1, 2)]
    base = {"agent": "a", "model": "m", "reported": 50.0, "trials": trials}
    texts = [("good", base), ("differs", base | {"reported": 61}), ("short", base | {"trials": trials[:3]}), ("refused", base | {"agent": "", "note": 1})]
    rows = spark.createDataFrame([(n, json.dumps(d)) for n, d in texts], "entry string, text string")
    got = {r.entry: (r.verdict, r.failures, r.accuracy) for r in imports.terminal_submissions(rows, 2).collect()}
    assert got == {
        "good": ("valid", [], 50.0), "differs": ("accuracy_differs", [], 50.0), "short": ("trials_missing", [], 50.0),
        "refused": ("refused", ["$.agent minLength", "$.note additionalProperties"], None),
    }


def _point(name, beaten=(), value="5"):
    bounds = {"value": value, "lower": "1", "upper": "9"}
    axes = {"cost": bounds | {"unit": "usd", "sources": [{"id": "s", "url": "https://a.b"}]}, "quality": bounds | {"unit": "points"}}
    return {"offering": {"offering_id": name, "provider": "p" + name}, "axes": axes, "metadata": {"m": name}, "dominated_by": list(beaten)}


FRONTIER = {
    "snapshot_id": "x", "frontier_id": "f", "workload": {"id": "w"}, "order_by": "cost", "axes": [{"metric": "cost", "unit": "usd"}, {"metric": "quality", "unit": "points"}],
    "evaluated": [_point("1"), _point("2", ["1"])], "members": [_point("1")], "rejected": [{"offering_id": "3"}], "sources": [{"id": "s", "url": "https://a.b"}],
    "source_watermarks": {"s": "2024-01-01T00:00:00Z"}, "axis_evidence": {"candidates": [{"offering": {"offering_id": k}} for k in "123"]},
}
SELECTION = {
    "snapshot_id": "x", "selection_id": "s", "order_by": "cost", "requested_count": 2, "max_per_provider": 1, "on_insufficient": "error",
    "generated_at": "2024-01-01T00:00:00Z", "valid_until": "2024-01-02T00:00:00Z", "default": _point("1"), "fallbacks": [_point("2")],
}
PUBLICATION = {
    "publication_id": "x", "project_id": "p", "frontiers": [{"frontier_id": "f", "snapshot_id": "1"}, {"frontier_id": "g", "snapshot_id": "2"}],
    "selections": [{"selection_id": "s", "frontier_id": "f", "frontier_snapshot_id": "1"}],
}
HISTORY = {"frontier_id": "f", "entries": [{"snapshot_id": "b", "generated_at": "2024-01-02T00:00:00Z"}, {"snapshot_id": "a", "generated_at": "2024-01-01T00:00:00Z"}]}
RESULT = {"primary_metric": "q", "measurements": [{"id": "q", "value": "5", "lower": "1", "upper": "9"}, {"id": "r", "value": "1"}]}
EVIDENCE = {"rights": {"license_expression": "MIT"}, "rows": [{"subject": {"row_id": "1", "kind": "single_model_system", "model_claims": [{"model_id": "m"}]}, "result": RESULT}, {"subject": {"row_id": "2"}, "invalid_result": {"code": "c"}}]}
MEASUREMENT = {
    "measurement_id": "m", "started_at": "2024-01-01T00:00:00Z", "completed_at": "2024-01-01T01:00:00Z", "hardware": {"hardware_id": "h"}, "artifact": {"model_id": "m"},
    "runtime": {"context_capacity_tokens": 100}, "workload": {"repetitions": 2, "max_output_tokens": 9}, "provenance": {"tool": "t"}, "capabilities": ["a", "b"],
    "performance": {"actual_input_tokens": 100, "output_token_counts": [9, 1], "metrics": {"t": {"unit": "s", "values": ["1", "2"]}}}, "integrity": {"retrieval": {"passed": 2, "total": 2}},
}
PORTFOLIO = {
    "portfolio_id": "p", "output_workload": {"id": "out"}, "required_component_ids": ["a"], "minimum_measured_components": 1,
    "components": [{"component_id": c, "frontier_id": "f" + c, "workload": {"id": "w" + c}, "output_signal": "s" + c, "correlation_group": "g"} for c in "ab"],
}
REPORT = {
    "schema_version": "1", "records": [{"row_id": "1", "outcome": "mapped"}, {"row_id": "2", "outcome": "unmapped"}],
    "mapped_rows": [{"row_id": "1", "offering": {"offering_id": "o"}}],
}
DERIVATION = {
    "snapshot_id": "x", "generated_at": "2024-01-01T00:00:00Z", "valid_until": "2024-01-02T00:00:00Z", "candidates": [{"offering": {"offering_id": "1"}}, {"offering": {"offering_id": "2"}}],
}
RECONCILIATION = {"entries": [{"row_id": "1"}, {"row_id": "2"}]}


def _set(path, value):
    def change(d):
        for p in path[:-1]:
            d = d[p]
        d[path[-1]] = value

    return change


def _add(path, value):
    def change(d):
        for p in path:
            d = d[p]
        d.append(value)

    return change


BROKEN = [
    ("frontier", FRONTIER, "order_is_axis", _set(["order_by"], "speed")), ("frontier", FRONTIER, "axes_distinct", _add(["axes"], {"metric": "cost", "unit": "usd"})),
    ("frontier", FRONTIER, "evaluated_unique", _add(["evaluated"], _point("2", ["1"]))), ("frontier", FRONTIER, "members_unique", _add(["members"], _point("1"))),
    ("frontier", FRONTIER, "rejected_unique", _add(["rejected"], {"offering_id": "3"})), ("frontier", FRONTIER, "rejected_not_evaluated", _add(["rejected"], {"offering_id": "2"})),
    ("frontier", FRONTIER, "members_are_undominated", _add(["members"], _point("2", ["1"]))), ("frontier", FRONTIER, "members_as_evaluated", _set(["members", 0, "axes", "cost", "value"], "6")),
    ("frontier", FRONTIER, "axes_complete", lambda d: [x["axes"].update(more={"value": "1"}) for x in d["evaluated"] + d["members"]]),
    ("frontier", FRONTIER, "axis_units", lambda d: [x["axes"]["cost"].update(unit="eur") for x in d["evaluated"] + d["members"]]),
    ("frontier", FRONTIER, "axis_bounds", _set(["evaluated", 1, "axes", "cost", "value"], "9.5")), ("frontier", FRONTIER, "dominators_evaluated", _set(["evaluated", 1, "dominated_by"], ["3"])),
    ("frontier", FRONTIER, "no_self_dominance", _set(["evaluated", 1, "dominated_by"], ["2"])), ("frontier", FRONTIER, "watermarks_known", _set(["source_watermarks"], {"t": "2024-01-01T00:00:00Z"})),
    ("frontier", FRONTIER, "sources_known", _set(["evaluated", 1, "axes", "quality", "sources"], [{"id": "t"}])),
    ("frontier", FRONTIER, "sources_consistent", _add(["sources"], {"id": "s", "url": "https://c.d"})), ("frontier", FRONTIER, "evidence_covers_all", _add(["axis_evidence", "candidates"], {"offering": {"offering_id": "4"}})),
    ("selection", SELECTION, "validity_follows", _set(["valid_until"], "2024-01-01T00:00:00Z")), ("selection", SELECTION, "choices_unique", _set(["fallbacks", 0, "offering", "offering_id"], "1")),
    ("selection", SELECTION, "provider_limit", _set(["fallbacks", 0, "offering", "provider"], "p1")), ("selection", SELECTION, "strict_count", _set(["requested_count"], 3)),
    ("selection", SELECTION | {"on_insufficient": "return_available"}, "not_above_requested", _set(["requested_count"], 1)), ("selection", SELECTION, "order_axis_present", _set(["order_by"], "speed")),
    ("publication", PUBLICATION, "frontiers_unique", _add(["frontiers"], {"frontier_id": "f", "snapshot_id": "3"})), ("publication", PUBLICATION, "selections_current", _set(["selections", 0, "frontier_snapshot_id"], "2")),
    ("publication", PUBLICATION, "selections_unique", _add(["selections"], {"selection_id": "s", "frontier_id": "g", "frontier_snapshot_id": "2"})),
    ("publication", PUBLICATION, "selections_current,selections_published", _set(["selections", 0, "frontier_id"], "h")),
    ("history", HISTORY, "newest_first", lambda d: d["entries"].reverse()), ("history", HISTORY, "entries_unique", _set(["entries", 0, "snapshot_id"], "a")),
    ("quality_evidence", EVIDENCE, "rows_unique", _set(["rows", 1, "subject", "row_id"], "1")), ("quality_evidence", EVIDENCE, "one_result", _set(["rows", 0, "invalid_result"], {"code": "c"})),
    ("quality_evidence", EVIDENCE, "measurements_unique", _add(["rows", 0, "result", "measurements"], {"id": "r"})), ("quality_evidence", EVIDENCE, "primary_measured", _set(["rows", 0, "result", "primary_metric"], "z")),
    ("quality_evidence", EVIDENCE, "measured_bounds", _set(["rows", 0, "result", "measurements", 0, "lower"], "6")), ("quality_evidence", EVIDENCE, "claims_fit_kind", _set(["rows", 0, "subject", "kind"], "undisclosed_system")),
    ("local_measurement", MEASUREMENT, "completed_after_start", _set(["completed_at"], "2023-01-01T00:00:00Z")), ("local_measurement", MEASUREMENT, "input_fits_context", _set(["performance", "actual_input_tokens"], 101)),
    ("local_measurement", MEASUREMENT, "outputs_match_repetitions", _add(["performance", "output_token_counts"], 3)), ("local_measurement", MEASUREMENT, "outputs_within_limit", _set(["performance", "output_token_counts", 1], 10)),
    ("local_measurement", MEASUREMENT, "series_match_repetitions", _add(["performance", "metrics", "t", "values"], "3")), ("local_measurement", MEASUREMENT, "checks_within_total", _set(["integrity", "retrieval", "passed"], 3)),
    ("local_measurement", MEASUREMENT, "capabilities_unique", _add(["capabilities"], "a")), ("local_measurement", MEASUREMENT, "has_evidence", lambda d: d.update(performance=None, integrity=None)),
    ("portfolio_policy", PORTFOLIO, "components_unique", _set(["components", 1, "component_id"], "a")), ("portfolio_policy", PORTFOLIO, "frontiers_unique", _set(["components", 1, "frontier_id"], "fa")),
    ("portfolio_policy", PORTFOLIO, "signals_unique", _set(["components", 1, "output_signal"], "sa")), ("portfolio_policy", PORTFOLIO, "required_declared", _set(["required_component_ids"], ["z"])),
    ("portfolio_policy", PORTFOLIO, "coverage_possible", _set(["minimum_measured_components"], 3)), ("portfolio_policy", PORTFOLIO, "output_is_new", _set(["output_workload", "id"], "wa")),
    ("portfolio_policy", PORTFOLIO, "workload_one_group", lambda d: d["components"][1].update(workload={"id": "wa"}, correlation_group="h")),
    ("portfolio_derivation", DERIVATION, "validity_follows", _set(["valid_until"], "2024-01-01T00:00:00Z")), ("portfolio_derivation", DERIVATION, "candidates_unique", _set(["candidates", 0, "offering", "offering_id"], "2")),
    ("reconciliation", RECONCILIATION, "rows_unique", _set(["entries", 0, "row_id"], "2")),
    ("import_report", REPORT, "records_unique", _set(["records", 1, "row_id"], "1")), ("import_report", REPORT, "mapped_rows_recorded", _set(["records", 0, "outcome"], "refused")),
    ("import_report", REPORT, "rows_unique", _add(["mapped_rows"], {"row_id": "1", "offering": {"offering_id": "u"}})), ("import_report", REPORT, "mapped_rows_recorded,offerings_unique", _add(["mapped_rows"], {"row_id": "2", "offering": {"offering_id": "o"}})),
]


@pytest.mark.parametrize("kind", sorted(rules.RULES))
def test_each_rule_refuses_its_document_and_no_other(spark, kind):
    cases = [(base, broken, change) for k, base, broken, change in BROKEN if k == kind]
    assert {n for _, b, _ in cases for n in b.split(",")} == set(rules.RULES[kind]())
    texts, wanted = [], {}
    for i, (base, broken, change) in enumerate(cases):
        other = copy.deepcopy(base)
        change(other)
        texts += [(2 * i, json.dumps(base)), (2 * i + 1, json.dumps(other))]
        wanted |= {2 * i: "", 2 * i + 1: broken}
    rows = rules.parsed(spark.createDataFrame(texts, "i int, text string"), kind)
    got = {r.i: r.f for r in rows.select("i", F.array_join(rules.document_failures(kind), ",").alias("f")).collect()}
    # A change may break related rules as well; the one it aims at is always among them.
    assert {i for i, f in got.items() if f} == {i for i, f in wanted.items() if f}
    assert all(set(wanted[i].split(",")) <= set(f.split(",")) for i, f in got.items()), (got, wanted)


def test_reader_refuses_by_the_names_of_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(HISTORY))
    assert rules.read_coherent(spark, str(tmp_path), "history").count() == 1
    (tmp_path / "b.json").write_text(json.dumps(HISTORY | {"entries": HISTORY["entries"][::-1]}))
    with pytest.raises(Exception, match="breaks: newest_first"):
        rules.read_coherent(spark, str(tmp_path), "history").collect()
