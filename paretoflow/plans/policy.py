"""Policies: exact YAML, dataclasses, reference checks, and the plan that evaluates a frontier."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal, InvalidOperation
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, formula
from ..functions.written import written
from ..operators import admission, frontier
from ..operators.oracles import Oracles


class PolicyError(ValueError):
    """A policy does not hold together, or does not fit the catalog."""


class _ExactLoader(yaml.SafeLoader):
    """YAML numbers become exact decimals, never binary floats."""


def _exact(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> Decimal:
    try:
        value = Decimal(loader.construct_scalar(node).replace("_", ""))
    except InvalidOperation:  # .inf and .nan
        raise PolicyError("number is not finite") from None
    return value


_ExactLoader.add_constructor("tag:yaml.org,2002:float", _exact)

# The accounting bases of a bill, and the signals that hold a whole bill.
TOTALS = {
    "estimated_total": "estimated_total_cost_usd", "provider_reported_total": "provider_reported_total_cost_usd",
    "billed_total": "billed_total_cost_usd", "provider_marginal": "provider_marginal_cost_usd",
}
COMPONENTS = "reconstructed_components"


@dataclass(frozen=True)
class Metric:
    """A signal, a formula over signals or an oracle ("name@version"), with what its evidence must bring."""

    unit: str
    signal: str | None = None
    expression: str | None = None
    oracle: str | None = None
    cost_basis: str | None = None
    requirements: admission.Requirements = field(default_factory=admission.Requirements)

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.signal, self.expression, self.oracle)) != 1:
            raise PolicyError("a metric is a signal, a formula or an oracle")
        if self.oracle and self.oracle.count("@") != 1:
            raise PolicyError("an oracle is written name@version")
        if self.expression:
            self.check_cost_basis()

    def check_cost_basis(self) -> None:
        """A formula over money says which bill it reads, and reads no other one."""
        signals = {p.split(".", 1)[1] for p in formula.parse(self.expression).paths() if p.startswith("signals.")}
        basis_of = lambda s: next((b for b, t in TOTALS.items() if s == t or s.startswith(f"{t}_")), None)
        bases = {b for s in signals if (b := basis_of(s))}
        money = {s for s in signals if "usd" in s.lower()}
        if self.cost_basis is None:
            if money or bases:
                raise PolicyError("a formula over cost signals declares its cost_basis")
        elif self.cost_basis == COMPONENTS:
            if bases:
                raise PolicyError("reconstructed components and a whole bill are mixed")
        elif self.cost_basis not in TOTALS:
            raise PolicyError("unknown cost_basis")
        elif bases != {self.cost_basis} or money != {s for s in signals if basis_of(s) == self.cost_basis}:
            raise PolicyError("a formula reads another bill than its cost_basis, or parts beside it")


@dataclass(frozen=True)
class Frontier:
    """Two axes of metrics, eligibility, thresholds, gates and the order of preference."""

    axes: tuple[tuple[str, str, str, str], ...]  # metric, goal, absolute and relative tolerance
    providers: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()
    minimum: dict[str, str] = field(default_factory=dict)
    maximum: dict[str, str] = field(default_factory=dict)
    minimum_gates: dict[str, str] = field(default_factory=dict)
    maximum_gates: dict[str, str] = field(default_factory=dict)
    robust: bool = False
    order_by: str | None = None
    allow_unknown_age: bool = False
    max_source_age_hours: dict[str, str] = field(default_factory=dict)
    metadata_fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        names = [a[0] for a in self.axes]
        if len(names) != 2 or names[0] == names[1]:
            raise PolicyError("a frontier has two distinct axes")
        if self.order_by is not None and self.order_by not in names:
            raise PolicyError("order_by is not an axis")
        if not {*self.minimum, *self.maximum} <= set(names):
            raise PolicyError("a threshold is on no axis")
        if (set(self.minimum_gates) | set(self.maximum_gates)) & set(names):
            raise PolicyError("a gate is on an axis")

    def gates(self) -> list[str]:
        return sorted({*self.minimum_gates, *self.maximum_gates})


@dataclass(frozen=True)
class Project:
    metrics: dict[str, Metric]
    frontiers: dict[str, Frontier]
    workload: dict[str, Decimal] = field(default_factory=dict)
    #: id, version and unit that a catalog's workload must have; None leaves it open.
    workload_key: tuple[str, str, str] | None = None

    def __post_init__(self) -> None:
        for f in self.frontiers.values():
            if any(m not in self.metrics for m in [*(a[0] for a in f.axes), *f.gates()]):
                raise PolicyError("a frontier names an unknown metric")


# The keys of a policy's frontiers.
_TUPLES = ("providers", "regions", "capabilities", "metadata_fields")
_LIMITS = ("minimum", "maximum", "minimum_gates", "maximum_gates", "max_source_age_hours")


def load(text: str) -> Project:
    """A project from YAML text. Unknown keys are refused."""
    raw: dict[str, Any] = yaml.load(text, Loader=_ExactLoader)  # noqa: S506 - a SafeLoader
    if set(raw) - {"metrics", "frontiers", "workload", "workload_key"}:
        raise PolicyError("unknown key")

    def requirements(x: dict[str, Any]) -> admission.Requirements:
        x = dict(x)
        if "tiers" in x:
            x["tiers"] = tuple(x["tiers"])
        for k in ("max_age_hours", "max_future_skew_minutes"):
            if k in x:
                x[k] = float(x[k])
        return admission.Requirements(**x)

    def axis(a: dict[str, Any]) -> tuple[str, str, str, str]:
        return a["metric"], a["goal"], str(a.get("epsilon_absolute", 0)), str(a.get("epsilon_relative", 0))

    def one(v: dict[str, Any]) -> Frontier:
        if set(v) - {"axes", "uncertainty", "order_by", "allow_unknown_age", *_TUPLES, *_LIMITS}:
            raise PolicyError("unknown key of a frontier")
        if v.get("uncertainty", "point") not in ("point", "robust"):
            raise PolicyError("uncertainty is point or robust")
        return Frontier(
            tuple(axis(a) for a in v["axes"]),
            robust=v.get("uncertainty") == "robust", order_by=v.get("order_by"), allow_unknown_age=bool(v.get("allow_unknown_age", False)),
            **{k: tuple(v.get(k, ())) for k in _TUPLES}, **{k: {m: str(x) for m, x in v.get(k, {}).items()} for k in _LIMITS},
        )

    metrics = {
        k: Metric(v["unit"], v.get("signal"), v.get("expression"), v.get("oracle"), v.get("cost_basis"), requirements(v.get("requirements", {})))
        for k, v in raw.get("metrics", {}).items()
    }
    key = raw.get("workload_key")
    return Project(
        metrics,
        {k: one(v) for k, v in raw.get("frontiers", {}).items()},
        {k: Decimal(str(v)) for k, v in raw.get("workload", {}).items()},
        (str(key["id"]), str(key["version"]), str(key["unit"])) if key else None,
    )


def policy_hash(project: Project, frontier_id: str) -> str:
    """The identity of what one frontier's evaluation depends on: its definition, the metrics it names and the workload.

    What is as if it were not written (empty limits, the default tiers of evidence) does not count, so
    adding an optional key to the format changes no identity.
    """
    if frontier_id not in project.frontiers:
        raise PolicyError("unknown frontier")
    f = project.frontiers[frontier_id]

    def plain(value: Any) -> Any:
        if isinstance(value, Mapping):
            return {str(k): plain(v) for k, v in value.items() if v not in (None, (), {}, [])}
        if isinstance(value, (list, tuple, set, frozenset)):
            return [plain(v) for v in value]
        return Decimal(str(value)) if isinstance(value, float) else value

    names = [a[0] for a in f.axes] + f.gates()
    metrics = {n: plain(asdict(project.metrics[n])) for n in names}
    default = plain(list(admission.Requirements().tiers))
    for m in metrics.values():
        if m.get("requirements", {}).get("tiers") == default:
            del m["requirements"]["tiers"]
    whole = {"frontier_id": frontier_id, "frontier": plain(asdict(f)), "metrics": metrics, "workload": plain(project.workload), "workload_key": plain(project.workload_key)}
    return canonical.value_hash(whole)


def check_catalog(project: Project, f: Frontier, catalog: DataFrame) -> None:
    """The catalog's workload is the project's, each source id has one descriptor, and aged sources exist."""
    if project.workload_key is not None:
        names = ("workload_id", "workload_version", "workload_unit")
        same = [F.col(n).eqNullSafe(v) for n, v in zip(names, project.workload_key)]
        if catalog.filter(~(same[0] & same[1] & same[2])).limit(1).count():
            raise PolicyError("the catalog describes another workload")
    sources = catalog.filter("source IS NOT NULL").select("source.id", F.to_json("source").alias("descriptor"))
    if sources.groupBy("id").agg(F.min("descriptor").alias("a"), F.max("descriptor").alias("b")).filter("a <> b").limit(1).count():
        raise PolicyError("a source id has different descriptors")
    # As many rows as the policy names sources.
    named = list(f.max_source_age_hours)
    if named and sources.filter(F.col("id").isin(named)).select("id").distinct().count() < len(named):
        raise PolicyError("an age limit names a source that the catalog does not have")


def _metric(project: Project, f: Frontier, name: str, now: Column, oracles: Oracles) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Of a metric over a row's ``signals`` map: its formula, then value, lower and upper bound, and over these its first failing reason."""
    m = project.metrics[name]
    need = replace(m.requirements, allow_unknown_age=m.requirements.allow_unknown_age or f.allow_unknown_age)
    ages = F.create_map(*[x for s, h in f.max_source_age_hours.items() for x in (F.lit(s), F.lit(float(h)))]) if f.max_source_age_hours else None
    because = lambda text: F.lit(f"{name}:{text}")

    def admitted(o: Column) -> Column:
        limit = F.try_element_at(ages, o["source"]["id"]) if ages is not None else None
        why = admission.observation_reason(need, now, o["evidence_tier"], o["source"]["id"], o["observed_at"], o["sample_count"], o["lower"], o["upper"], limit)
        return F.concat(because(""), why)

    def lookup(path: str) -> Column:
        root, rest = path.split(".", 1)
        if root == "signals":
            return F.try_element_at("signals", F.lit(rest))["value"]
        if root == "workload":
            return F.lit(project.workload.get(rest))
        return F.try_element_at("metadata", F.lit(rest))

    if m.expression is not None:
        first = {f"_formula_{name}": formula.exact_with_paths(m.expression, lookup)}
        values = {
            name: F.col(f"_formula_{name}")["value"].try_cast("decimal(38,12)"), f"_used_{name}": F.col(f"_formula_{name}")["used"],
            f"{name}_lower": F.lit(None).cast("decimal(38,12)"), f"{name}_upper": F.lit(None).cast("decimal(38,12)"),
        }
        # Only what the evaluation read counts; a missing branch of coalesce is read as missing.
        read = sorted(p.split(".", 1)[1] for p in formula.parse(m.expression).paths() if p.startswith("signals."))
        seen = {s: F.when(F.array_contains(f"_used_{name}", f"signals.{s}"), F.try_element_at("signals", F.lit(s))) for s in read}
        reasons = [F.when(F.col(name).isNull(), because("no_value"))]
        reasons += [F.when(o.isNotNull(), admitted(o)) for o in seen.values()]
        reasons += [F.when(o["evidence_tier"] == "estimated", because("formula_over_estimate")) for o in seen.values()]
        if f.robust:
            reasons.append(because("formula_without_bounds"))
        return first, values, F.coalesce(*reasons)
    if m.oracle is not None:
        offering = F.struct("offering_id", "provider", "region", "capabilities")
        o = oracles.evaluate(*m.oracle.split("@"), offering, F.col("signals"), F.col("metadata"))
        missing = F.when(o.isNull() | o["value"].isNull(), because("oracle_failed"))
    else:
        o = F.try_element_at("signals", F.lit(m.signal))
        missing = F.when(o.isNull(), because(f"missing_signal:{m.signal}"))
    reasons = [missing, F.when(~o["unit"].eqNullSafe(m.unit), because("unit_mismatch")), admitted(o), F.when(o["value"].isNull(), because("no_value"))]
    if f.robust:
        reasons.append(F.when(o["lower"].isNull() | o["upper"].isNull(), because("bounds_missing")))
    return {}, {f"{name}{end}": o[c].cast("decimal(38,12)") for end, c in (("", "value"), ("_lower", "lower"), ("_upper", "upper"))}, F.coalesce(*reasons)


def evaluate(project: Project, frontier_id: str, catalog: DataFrame, generated_at: str, oracles: Oracles | None = None, lists: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members with rank, all evaluated with dominated_by, rejected with reasons).

    ``catalog`` is the long table of :func:`paretoflow.sources.files.read_catalog`. Stages: eligibility,
    axis metrics, gate metrics, thresholds and gates; a rejected offering keeps all reasons of the
    first stage that gave any. Without ``lists`` the evaluated have ``dominators``, the length of the list, which needs no pairs.
    """
    if frontier_id not in project.frontiers:
        raise PolicyError("unknown frontier")
    f = project.frontiers[frontier_id]
    check_catalog(project, f, catalog)
    names = [a[0] for a in f.axes]
    judged = measured(project, f, catalog, generated_at, oracles)
    kept = [c for n in names for c in (n, f"{n}_lower", f"{n}_upper")]
    shown = F.map_filter("metadata", lambda k, _: k.isin(list(f.metadata_fields))).alias("metadata")
    # The inventory is written once: members, dominators and rejected ones all read it.
    inventory = written(judged.select("offering_id", "provider", *kept, shown, "reasons"), "policy-inventory")
    accepted, rejected = admission.split(inventory)
    axes = [frontier.Axis(n, goal, absolute, relative, f"{n}_lower", f"{n}_upper") for n, goal, absolute, relative in f.axes]
    order = sorted(axes, key=lambda a: a.value != (f.order_by or names[0]))
    evaluated = (frontier.dominated_by if lists else frontier.dominator_counts)(accepted, "offering_id", axes, f.robust)
    members = frontier.ranked(frontier.members(accepted, "offering_id", axes, f.robust), "offering_id", order)
    return members, evaluated, rejected.select("offering_id", "reasons")


def measured(project: Project, f: Frontier, catalog: DataFrame, generated_at: str, oracles: Oracles | None = None) -> DataFrame:
    """The inventory: every offering with all axis and gate values it has, and the reasons against it."""
    now = F.lit(generated_at).cast("timestamp")
    keys = ["offering_id", "provider", "region", "capabilities"]
    observation = F.struct("value", "unit", "evidence_tier", "lower", "upper", "sample_count", "observed_at", "source")
    wide = catalog.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("signal", observation))).alias("signals"), F.any_value("metadata").alias("metadata")
    )
    names, gates = [a[0] for a in f.axes], f.gates()
    first, values, reasons = {}, {}, {}
    for n in [*names, *gates]:
        formulas, found, reasons[f"_why_{n}"] = _metric(project, f, n, now, oracles or Oracles())
        first, values = first | formulas, values | found
    # Values first: a formula is evaluated once, however many reasons look at it.
    rows = wide.withColumns(first).withColumns(values).withColumns(reasons)
    why = lambda some: F.array_compact(F.array(*[F.col(f"_why_{n}") for n in some])) if some else F.array().cast("array<string>")
    eligible = admission.eligibility(F.col("provider"), F.col("region"), F.col("capabilities"), f.providers, f.regions, f.capabilities)
    point = lambda n: (F.col(n), F.col(n), F.col(n))
    bounds = lambda n: (F.col(n), F.col(f"{n}_lower"), F.col(f"{n}_upper"))
    limits = [admission.gate_reason(*point(n), f.minimum.get(n), None, False, n) for n in names]
    limits += [admission.gate_reason(*point(n), None, f.maximum.get(n), False, n) for n in names]
    limits += [admission.gate_reason(*bounds(n), f.minimum_gates.get(n), None, f.robust, f"gate:{n}") for n in gates]
    limits += [admission.gate_reason(*bounds(n), None, f.maximum_gates.get(n), f.robust, f"gate:{n}") for n in gates]
    return rows.withColumn("reasons", admission.staged(eligible, why(names), why(gates), F.array_compact(F.array(*limits)))).drop(*reasons, *first, *[f"_used_{n}" for n in names + gates])
