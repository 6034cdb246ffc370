"""What rows and documents must keep, as columns that list every rule that is broken.

:func:`json_failures` compiles a JSON Schema of a closed set of keywords into one expression over a JSON
text: parsed once into a variant, every node is judged where it lies, unknown fields and wrong types too. That is
interpreted, so plain texts are judged in Python batches by the same rules, and only the others by the variant. A
failure reads ``$.path keyword``, sorted. A schema that uses another keyword, or contradicts itself, is refused
when it is compiled, so no rule is skipped in silence.

:func:`document_failures` holds the rules between fields of a whole document (identities that must be
unique, references that must lead somewhere, values that must agree): sets are compared by hashing, in one pass
over nested arrays. A rule whose fields are absent holds.

Defined cases: a null text has null failures; text that is no JSON, or repeats a key, fails with ``$ json``; an
empty table gives an empty result; numbers beyond 38 digits are compared as doubles.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from decimal import Decimal
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import KINDS, SOURCE, DocumentError, read_document


class SchemaError(ValueError):
    """A schema cannot be compiled."""


#: Keywords of each type; ``enum`` and ``const`` go with all.
KEYWORDS = {
    "object": {"properties", "required", "additionalProperties"}, "array": {"items", "minItems", "maxItems", "uniqueItems"},
    "string": {"minLength", "maxLength", "pattern", "format"}, "number": {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"},
    "boolean": set(), "null": set(),
}
KEYWORDS["integer"] = KEYWORDS["number"]
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+$"
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")


def _checked(schema: Any) -> list[str]:
    """The types of a schema node, all of whose keywords are known and agree."""
    if not isinstance(schema, dict):
        raise SchemaError("a schema must be an object")
    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    if not isinstance(types, list) or not types or not set(types) <= set(KEYWORDS):
        raise SchemaError("a schema must name known types")
    unknown = set(schema) - {"type", "enum", "const", "title", "description"}.union(*(KEYWORDS[t] for t in types))
    if unknown:
        raise SchemaError(f"unsupported keywords: {sorted(unknown)}")
    for low, high in (("minLength", "maxLength"), ("minItems", "maxItems"), ("minimum", "maximum")):
        if low in schema and high in schema and schema[low] > schema[high]:
            raise SchemaError(f"{low} is above {high}")
    if not set(schema.get("required", ())) <= set(schema.get("properties", ())):
        raise SchemaError("required names a field without a schema")
    if schema.get("format", "uri") != "uri" or not isinstance(schema.get("additionalProperties", True), bool):
        raise SchemaError("unsupported format or additionalProperties")
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except re.error as error:
            raise SchemaError("pattern is no regular expression") from error
    return types


def _node(v: Column, schema: Any, at: Column) -> Column:
    """Failures of a variant that is there, as an array of texts.

    The value and its shape are bound to a variable of a one-element array, so that each is computed once.
    """
    bound = F.array(F.struct(v.alias("v"), F.schema_of_variant(v).alias("shape")))
    return F.get(F.transform(bound, lambda x: _judged(x["v"], x["shape"], schema, at)), F.lit(0))


def _judged(v: Column, shape: Column, schema: Any, at: Column) -> Column:
    types = _checked(schema)
    number = F.try_variant_get(v, "$", "double")
    exact = F.try_variant_get(v, "$", "decimal(38,12)")
    is_number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    is_a = {
        "object": shape.startswith("OBJECT"), "array": shape.startswith("ARRAY"), "string": shape == "STRING",
        "boolean": shape == "BOOLEAN", "null": shape == "VOID", "number": is_number, "integer": is_number & (F.rint(number) == number),
    }
    found: list[Column] = []

    def rule(keyword: str, kind: str, broken: Column) -> None:
        found.append(F.when(is_a[kind] & broken, F.array(F.concat(at, F.lit(f" {keyword}")))))

    fits = is_a[types[0]]
    for t in types[1:]:
        fits = fits | is_a[t]
    found.append(F.when(~fits, F.array(F.concat(at, F.lit(" type")))))
    if "enum" in schema or "const" in schema:
        allowed = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema.get("enum", [schema.get("const")])]
        found.append(F.when(~F.to_json(v).isin(allowed), F.array(F.concat(at, F.lit(" enum" if "enum" in schema else " const")))))
    if "string" in types:
        s = F.try_variant_get(v, "$", "string")
        tests = {
            "minLength": lambda x: F.char_length(s) < x, "maxLength": lambda x: F.char_length(s) > x,
            "pattern": lambda x: ~s.rlike(x), "format": lambda _: ~s.rlike(ABSOLUTE),
        }
        for k in KEYWORDS["string"] & set(schema):
            rule(k, "string", tests[k](schema[k]))
    if {"number", "integer"} & set(types):
        for k in KEYWORDS["number"] & set(schema):
            x = schema[k]
            sides = ((exact, F.lit(str(x)).cast("decimal(38,12)")), (number, F.lit(float(x))))
            past = {
                "minimum": lambda a, b: a < b, "maximum": lambda a, b: a > b,
                "exclusiveMinimum": lambda a, b: a <= b, "exclusiveMaximum": lambda a, b: a >= b,
            }[k]
            rule(k, "number", F.coalesce(*[past(a, b) for a, b in sides]))
    if "array" in types:
        items = F.try_variant_get(v, "$", "array<variant>")
        if "minItems" in schema:
            rule("minItems", "array", F.size(items) < schema["minItems"])
        if "maxItems" in schema:
            rule("maxItems", "array", F.size(items) > schema["maxItems"])
        if schema.get("uniqueItems"):
            shown = F.transform(items, lambda x: F.to_json(x))
            rule("uniqueItems", "array", F.size(F.array_distinct(shown)) < F.size(shown))
        if "items" in schema:
            each = F.transform(items, lambda x, i: _node(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
            found.append(F.when(is_a["array"], F.flatten(each)))
    if "object" in types:
        own = schema.get("properties", {})
        for name, child in own.items():
            inner = F.try_variant_get(v, f"$.{name}" if NAME.match(name) else f'$["{name}"]', "variant")
            place = F.concat(at, F.lit(f".{name}"))
            missing = F.array(F.concat(place, F.lit(" required"))) if name in schema.get("required", ()) else F.array().cast("array<string>")
            inside = F.transform(F.array(inner), lambda x: F.when(x.isNull(), missing).otherwise(_node(x, child, place)))  # noqa: B023
            found.append(F.when(is_a["object"], F.get(inside, F.lit(0))))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, own)).cast("array<string>"))
            found.append(F.when(is_a["object"], F.transform(extra, lambda k: F.concat(at, F.lit("."), k, F.lit(" additionalProperties")))))
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(x, empty) for x in found]))


def json_failures(text: Column, schema: dict) -> Column:
    """Every broken rule of a JSON text, sorted; empty for a text that keeps them all."""
    exact = variant_failures(text, schema)
    if '"pattern"' in json.dumps(schema):  # Java's regular expressions
        return exact
    written = json.dumps(schema)

    @F.arrow_udf("array<string>")
    def quick(texts: pa.Array) -> pa.Array:
        judged = _judge(written)
        return pa.array([judged(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.coalesce(quick(text), exact)


def variant_failures(text: Column, schema: dict) -> Column:
    """:func:`json_failures` as one expression over a variant."""
    parsed = F.try_parse_json(text)
    once = F.transform(F.array(parsed), lambda v: F.when(v.isNull(), F.array(F.lit("$ json"))).otherwise(F.array_sort(_node(v, schema, F.lit("$")))))
    return F.when(text.isNotNull(), F.get(once, F.lit(0)))


# The same rules over a batch of texts in Python, which are compiled once for each worker. What it may see otherwise than the
# variant does is left to that: texts that don't parse, repeat a key or escape by number, long or exponential numbers,
# numbers within a rounding of a limit, and strings whose form in JSON or as a URI hangs on characters beyond the usual.


class _Doubt(Exception):
    """A text is left to the variant."""


#: Nearer than this to a limit, or to an integer, a number's rounding counts.
NEAR = Decimal("1e-9")
#: Longer texts and names, and deeper ones, a JSON parser may refuse.
LONG, NAMES, DEPTH = 10_000_000, 20_000, 500


def _integer(written: str) -> int:
    if len(written) > 18:
        raise _Doubt
    return int(written)


def _decimal(written: str) -> Decimal:
    if len(written) > 25 or "e" in written or "E" in written:
        raise _Doubt
    return Decimal(written)


def _constant(written: str) -> None:
    raise _Doubt


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Doubt
    return found


def _usual(value: Any) -> None:
    """Doubts names and depths that a JSON parser may refuse."""
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > DEPTH or any(len(k) > NAMES for x in level if type(x) is dict for k in x):
            raise _Doubt
        level = [y for x in level if type(x) in (dict, list) for y in (x.values() if type(x) is dict else x)]


_PARSE = json.JSONDecoder(object_pairs_hook=_object, parse_int=_integer, parse_float=_decimal, parse_constant=_constant).decode
_URI = re.compile(ABSOLUTE, re.ASCII)
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", Decimal: "number"}
Judge = Callable[[Any, str, list[str]], None]


@lru_cache
def _judge(written: str) -> Callable[[str | None], list[str] | None]:
    """The failures of a text, None where that is left to the variant."""
    node = _rules(json.loads(written))

    def judged(text: str | None) -> list[str] | None:
        if text is None or "\\u" in text or len(text) > LONG:
            return None
        found: list[str] = []
        try:
            value = _PARSE(text)
            if len(text) > NAMES or text.count("[") + text.count("{") > DEPTH:
                _usual(value)
            node(value, "$", found)
        except (_Doubt, ValueError, TypeError, RecursionError):
            return None
        return sorted(found) if found else found

    return judged


def _unlike(items: list) -> bool:
    """No two items are equal; keys of objects in any order."""
    shown = set(map(repr, items))
    if len(shown) == len(items) and all(type(x) is str for x in items):
        return True
    first = list(items[0]) if items and type(items[0]) is dict else None
    if first is not None and all(type(x) is dict and list(x) == first and _FLAT.issuperset(map(type, x.values())) for x in items):
        return len(shown) == len(items)
    return len({json.dumps(x, sort_keys=True) for x in items}) == len(items)


_FLAT = {str, int, bool, type(None)}


def _sound(schema: dict) -> dict[type, Callable[[Any], bool]]:
    """By type, a test that only a value passes which breaks nothing: most do, and need no place."""
    types, tests = set(_checked(schema)), {}
    if "enum" in schema or "const" in schema:
        return tests
    if "boolean" in types:
        tests[bool] = lambda v: True
    if "string" in types:
        least, most = schema.get("minLength", 0), schema.get("maxLength", LONG)
        if "format" not in schema:
            tests[str] = lambda v: least <= len(v) <= most
    if types & {"number", "integer"}:
        low = max([Decimal(str(schema[k])) for k in ("minimum", "exclusiveMinimum") if k in schema], default=Decimal(-LONG))
        high = min([Decimal(str(schema[k])) for k in ("maximum", "exclusiveMaximum") if k in schema], default=Decimal(LONG))
        inner = (math.floor(low) + 1, math.ceil(high) - 1)
        if low == inner[0] - 1 and "exclusiveMinimum" not in schema:
            inner = (inner[0] - 1, inner[1])
        tests[int] = lambda v, a=inner[0], b=inner[1]: a <= v <= b
        if "number" in types:
            tests[Decimal] = lambda v, a=low + 1, b=high - 1: a < v < b
    return tests


def _rules(schema: dict) -> Judge:
    """Appends what a value breaks at a place."""
    types = set(_checked(schema))
    tests: dict[str, list[Judge]] = {k: [] for k in KEYWORDS}
    if "enum" in schema or "const" in schema:
        allowed = {json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema.get("enum", [schema.get("const")])}
        broken = " enum" if "enum" in schema else " const"

        def listed(v: Any, at: str, found: list[str]) -> None:
            if type(v) in (dict, list, Decimal) or type(v) is str and not v.isprintable():
                raise _Doubt
            if json.dumps(v, ensure_ascii=False) not in allowed:
                found.append(at + broken)

        for k in tests:
            tests[k].append(listed)
    if "string" in types:
        least, most = schema.get("minLength"), schema.get("maxLength")

        def string(v: str, at: str, found: list[str]) -> None:
            if least is not None and len(v) < least:
                found.append(at + " minLength")
            if most is not None and len(v) > most:
                found.append(at + " maxLength")

        def uri(v: str, at: str, found: list[str]) -> None:
            if not (v.isascii() and v.isprintable()):
                raise _Doubt
            if not _URI.search(v):
                found.append(at + " format")

        tests["string"] += [string] * (least is not None or most is not None) + [uri] * ("format" in schema)
    if types & {"number", "integer"}:
        past = {
            "minimum": lambda a, b: a < b, "maximum": lambda a, b: a > b,
            "exclusiveMinimum": lambda a, b: a <= b, "exclusiveMaximum": lambda a, b: a >= b,
        }
        limits = [(f" {k}", Decimal(str(schema[k])), past[k]) for k in KEYWORDS["number"] & set(schema)]

        def number(v: int | Decimal, at: str, found: list[str]) -> None:
            for name, limit, is_past in limits:
                if 0 < abs(v - limit) < NEAR:
                    raise _Doubt
                if is_past(v, limit):
                    found.append(at + name)

        for k in ("number", "integer"):
            tests[k] += [number] * bool(limits)
    if "array" in types:
        few, many, unique = schema.get("minItems"), schema.get("maxItems"), schema.get("uniqueItems")
        item, quick = (_rules(schema["items"]), _sound(schema["items"])) if "items" in schema else (None, {})

        def array(v: list, at: str, found: list[str]) -> None:
            if few is not None and len(v) < few:
                found.append(at + " minItems")
            if many is not None and len(v) > many:
                found.append(at + " maxItems")
            if unique and not _unlike(v):
                found.append(at + " uniqueItems")
            if item:
                for i, x in enumerate(v):
                    if (ok := quick.get(type(x))) is None or not ok(x):
                        item(x, f"{at}[{i}]", found)

        tests["array"].append(array)
    if "object" in types:
        own = [(name, "." + name, _rules(child), _sound(child).get) for name, child in schema.get("properties", {}).items()]
        names, required = {n for n, *_ in own}, set(schema.get("required", ()))
        closed = schema.get("additionalProperties") is False

        def record(v: dict, at: str, found: list[str]) -> None:
            seen = 0
            for name, place, child, quick in own:
                if name in v:
                    seen += 1
                    x = v[name]
                    if (ok := quick(type(x))) is None or not ok(x):
                        child(x, at + place, found)
                elif name in required:
                    found.append(f"{at}{place} required")
            if closed and seen < len(v):
                found.extend(f"{at}.{k} additionalProperties" for k in v if k not in names)

        tests["object"].append(record)
    fits = types | ({"integer"} if "number" in types else set())

    def judged(v: Any, at: str, found: list[str]) -> None:
        kind = _KINDS[type(v)]
        if kind == "number" and "number" not in types and "integer" in types:
            gap = abs(v - round(v))
            if 0 < gap < NEAR or abs(v) > 10**15:
                raise _Doubt
            kind = "number" if gap else "integer"
        if kind not in fits:
            found.append(at + " type")
        for test in tests[kind]:
            test(v, at, found)

    return judged


# Rules between the fields of a document.


def _unique(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)) == F.size(xs)


def _within(xs: Column, ys: Column) -> Column:
    return F.size(F.array_except(xs, ys)) == 0


def _each(xs: str | Column, field: str) -> Column:
    def inner(x: Column) -> Column:
        for part in field.split("."):
            x = x[part]
        return x

    return F.transform(xs, inner)


def _bounded(x: Column) -> Column:
    value, lower, upper = (x[c].try_cast("decimal(38,12)") for c in ("value", "lower", "upper"))
    return _holds(lower <= value) & _holds(value <= upper)


def _holds(rule: Column) -> Column:
    """The rule, which holds where its fields are absent."""
    return F.coalesce(rule, F.lit(True))


def _frontier() -> dict[str, Column]:
    evaluated, members = _each("evaluated", "offering.offering_id"), _each("members", "offering.offering_id")
    rejected = F.coalesce(_each("rejected", "offering_id"), F.array().cast("array<string>"))
    none = F.array().cast(f"array<{SOURCE}>")
    used = F.flatten(F.transform("evaluated", lambda e: F.flatten(F.transform(F.map_values(e["axes"]), lambda x: F.coalesce(x["sources"], none)))))
    beaten = F.transform("evaluated", lambda e: F.coalesce(e["dominated_by"], F.array().cast("array<string>")))
    free = F.transform(F.filter("evaluated", lambda e: F.coalesce(F.size(e["dominated_by"]) == 0, F.lit(True))), lambda e: e["offering"]["offering_id"])
    # Maps do not compare; their sorted entries do.
    flat = lambda xs: F.transform(xs, lambda e: F.struct(e["offering"], F.array_sort(F.map_entries(e["axes"])), F.array_sort(F.map_entries(e["metadata"]))))
    metrics = _each("axes", "metric")
    complete = lambda e: F.array_sort(F.map_keys(e["axes"])) == F.array_sort(metrics)
    same_unit = lambda e: F.forall("axes", lambda a: F.coalesce(F.try_element_at(e["axes"], a["metric"])["unit"].eqNullSafe(a["unit"]), F.lit(False)))
    known = F.coalesce(F.col("sources"), none)
    candidates = _each("axis_evidence.candidates", "offering.offering_id")
    return {
        "axes_distinct": _unique(metrics), "order_is_axis": F.array_contains(metrics, F.col("order_by")),
        "evaluated_unique": _unique(evaluated), "members_unique": _unique(members), "rejected_unique": _unique(rejected),
        "rejected_not_evaluated": F.size(F.array_intersect(evaluated, rejected)) == 0,
        "members_are_undominated": _within(members, free) & _within(free, members),
        "members_as_evaluated": _within(flat("members"), flat("evaluated")),
        "axes_complete": F.forall("evaluated", complete) & F.forall("members", complete),
        "axis_units": F.forall("evaluated", same_unit) & F.forall("members", same_unit),
        "axis_bounds": F.forall("evaluated", lambda e: F.forall(F.map_values(e["axes"]), _bounded)),
        "dominators_evaluated": _within(F.flatten(beaten), evaluated),
        "no_self_dominance": ~F.exists("evaluated", lambda e: F.coalesce(F.array_contains(e["dominated_by"], e["offering"]["offering_id"]), F.lit(False))),
        "sources_known": _within(used, known),
        "sources_consistent": F.size(F.array_distinct(_each(F.array_union(used, known), "id"))) == F.size(F.array_union(used, known)),
        "watermarks_known": _within(F.map_keys("source_watermarks"), _each(known, "id")),
        "evidence_covers_all": _within(candidates, F.concat(evaluated, rejected)) & _within(F.concat(evaluated, rejected), candidates),
    }


def _selection() -> dict[str, Column]:
    choices = F.concat(F.array("default"), F.coalesce("fallbacks", F.array().cast("array<" + KINDS["selection"].rsplit("fallbacks array<", 1)[1])))
    # Sorted, so that a run of one provider longer than the limit shows in one pass.
    providers = F.array_sort(_each(choices, "offering.provider"))
    limit = F.col("max_per_provider").cast("int")
    crowded = F.exists(F.transform(providers, lambda p, i: F.get(providers, i + limit) == p), lambda x: F.coalesce(x, F.lit(False)))
    return {
        "validity_follows": F.col("valid_until") > F.col("generated_at"), "choices_unique": _unique(_each(choices, "offering.offering_id")),
        "not_above_requested": F.size(choices) <= F.col("requested_count"), "strict_count": (F.col("on_insufficient") != "error") | (F.size(choices) == F.col("requested_count")),
        "provider_limit": ~crowded, "order_axis_present": F.forall(choices, lambda c: F.array_contains(F.map_keys(c["axes"]), F.col("order_by"))),
    }


def _publication() -> dict[str, Column]:
    pair = lambda xs, a, b: F.transform(xs, lambda x: F.struct(x[a].alias("f"), x[b].alias("s")))
    chosen = F.coalesce(pair("selections", "frontier_id", "frontier_snapshot_id"), F.array().cast("array<struct<f:string,s:string>>"))
    return {
        "frontiers_unique": _unique(_each("frontiers", "frontier_id")), "selections_unique": _unique(_each("selections", "selection_id")),
        "selections_published": _within(_each(chosen, "f"), _each("frontiers", "frontier_id")), "selections_current": _within(chosen, pair("frontiers", "frontier_id", "snapshot_id")),
    }


def _history() -> dict[str, Column]:
    key = F.transform("entries", lambda e: F.struct(e["generated_at"], e["snapshot_id"]))
    return {"entries_unique": _unique(_each("entries", "snapshot_id")), "newest_first": F.sort_array(key, asc=False) == key}


def _evidence() -> dict[str, Column]:
    named = lambda r: F.array_contains(_each(r["measurements"], "id"), r["primary_metric"])
    claims = lambda r: F.coalesce(F.size(r["subject"]["model_claims"]), F.lit(0))
    kind = lambda r: r["subject"]["kind"]
    good = lambda r: F.when(kind(r) == "single_model_system", claims(r) == 1).when(kind(r) == "composite_system", claims(r) >= 1).when(kind(r) == "undisclosed_system", claims(r) == 0).otherwise(F.lit(True))
    return {
        "rows_unique": _unique(_each("rows", "subject.row_id")), "one_result": F.forall("rows", lambda r: r["result"].isNull() != r["invalid_result"].isNull()),
        "measurements_unique": F.forall("rows", lambda r: _holds(_unique(_each(r["result"]["measurements"], "id")))),
        "primary_measured": F.forall("rows", lambda r: _holds(named(r["result"]))),
        "measured_bounds": F.forall("rows", lambda r: _holds(F.forall(r["result"]["measurements"], _bounded))), "claims_fit_kind": F.forall("rows", good),
    }


def _measurement() -> dict[str, Column]:
    runs = F.col("workload.repetitions")
    return {
        "completed_after_start": F.col("completed_at") >= F.col("started_at"), "has_evidence": F.col("performance").isNotNull() | F.col("integrity").isNotNull(),
        "input_fits_context": F.col("performance.actual_input_tokens") <= F.col("runtime.context_capacity_tokens"),
        "outputs_match_repetitions": F.size("performance.output_token_counts") == runs,
        "outputs_within_limit": F.forall("performance.output_token_counts", lambda n: n <= F.col("workload.max_output_tokens")),
        "series_match_repetitions": F.forall(F.map_values("performance.metrics"), lambda m: F.size(m["values"]) == runs),
        "checks_within_total": F.forall(F.array(*[f"integrity.{c}" for c in ("retrieval", "retrieval_value", "tool_calls", "tool_argument_parsing", "structured_output")]), lambda c: _holds(c["passed"] <= c["total"])),
        "capabilities_unique": _unique(F.col("capabilities")),
    }


def _portfolio() -> dict[str, Column]:
    ids, needed = _each("components", "component_id"), F.col("required_component_ids")
    least = F.col("minimum_measured_components")
    groups = F.array_distinct(F.transform("components", lambda c: F.struct(c["workload"], c["correlation_group"])))
    return {
        "components_unique": _unique(ids), "frontiers_unique": _unique(_each("components", "frontier_id")), "signals_unique": _unique(_each("components", "output_signal")),
        "required_declared": _unique(needed) & _within(needed, ids), "coverage_possible": (least >= F.size(needed)) & (least <= F.size(ids)),
        "output_is_new": ~F.array_contains(_each("components", "workload"), F.col("output_workload")), "workload_one_group": _unique(_each(groups, "workload")),
    }


RULES = {
    "frontier": _frontier, "selection": _selection, "publication": _publication, "history": _history, "quality_evidence": _evidence,
    "local_measurement": _measurement, "portfolio_policy": _portfolio,
    "portfolio_derivation": lambda: {"validity_follows": F.col("valid_until") > F.col("generated_at"), "candidates_unique": _unique(_each("candidates", "offering"))},
    "reconciliation": lambda: {"rows_unique": _unique(_each("entries", "row_id"))},
    "import_report": lambda: {
        "records_unique": _unique(_each("records", "row_id")), "rows_unique": _unique(_each("mapped_rows", "row_id")), "offerings_unique": _unique(_each("mapped_rows", "offering.offering_id")),
        "mapped_rows_recorded": _within(_each("mapped_rows", "row_id"), _each(F.filter("records", lambda r: r["outcome"] == "mapped"), "row_id")) & _within(_each(F.filter("records", lambda r: r["outcome"] == "mapped"), "row_id"), _each("mapped_rows", "row_id")),
    },
}


def document_failures(kind: str) -> Column:
    """Names of the broken rules of a document in the columns of its kind, sorted."""
    if kind not in RULES:
        raise DocumentError("no rules for this kind of document")
    broken = [F.when(~_holds(rule), F.lit(name)) for name, rule in sorted(RULES[kind]().items())]
    return F.array_compact(F.array(*broken))


def parsed(texts: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Rows with the fields of the documents that their texts hold; a text that does not fit its kind fails the job."""
    return texts.select(*[c for c in texts.columns if c != text], F.from_json(text, KINDS[kind], {"mode": "FAILFAST"}).alias("_d")).select("*", "_d.*").drop("_d")


def read_coherent(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The documents of a kind at a path; one that breaks a rule between its fields fails the read, by the rules' names."""
    broken = document_failures(kind)
    refused = F.raise_error(F.concat(F.lit(f"a {kind} document breaks: "), F.array_join(broken, ", ")))
    return read_document(spark, path, kind).filter(F.when(F.size(broken) > 0, refused).otherwise(F.lit(True)).cast("boolean"))
