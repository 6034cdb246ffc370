"""Admission: eligibility, evidence checks, thresholds and gates, each with explicit reasons.

Nothing is filled in for missing evidence. An observation fails with its first failing check;
eligibility, axes, gates and thresholds are stages, and a candidate's reasons all come from the
first stage that gave any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the reasons whose condition holds; an unknown condition counts as failing."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in checks])
    return F.filter(found, lambda r: r.isNotNull())


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The first reason whose condition holds, or null."""
    return F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in checks], F.lit(None).cast("string"))


def staged(*stages: Column) -> Column:
    """The reasons of the first stage that gave any."""
    out = stages[-1]
    for s in reversed(stages[:-1]):
        out = F.when(F.size(s) > 0, s).otherwise(out)
    return out


def eligibility(
    provider: Column, region: Column, capabilities: Column, providers: Sequence[str] = (), regions: Sequence[str] = (), required: Sequence[str] = ()
) -> Column:
    """Every failing eligibility rule. An empty rule list admits all."""
    checks = []
    if providers:
        checks.append((~provider.isin(*providers), "provider_not_allowed"))
    if regions:
        checks.append((~region.isin(*regions), "region_not_allowed"))
    for c in required:
        checks.append((~F.array_contains(capabilities, c), f"missing_capability:{c}"))
    return reasons(*checks) if checks else F.array().cast("array<string>")


@dataclass(frozen=True)
class Requirements:
    """What an observation must bring. Times are hours and minutes; None switches a check off."""

    tiers: tuple[str, ...] = ("measured",)
    require_source: bool = True
    max_age_hours: float | None = None
    max_future_skew_minutes: float = 5.0
    minimum_samples: int | None = None
    require_bounds: bool = False
    allow_unknown_age: bool = False


def observation_reason(
    need: Requirements, now: Column, tier: Column, source: Column, observed_at: Column, samples: Column, lower: Column, upper: Column,
    source_max_age_hours: Column | None = None,
) -> Column:
    """First failing check: tier, source, timestamp, future, age, samples, bounds."""
    age = (F.unix_micros(now) - F.unix_micros(observed_at)).cast("double")
    limit = F.lit(need.max_age_hours).cast("double")
    if source_max_age_hours is not None:
        limit = F.least(limit, source_max_age_hours.cast("double"))
    checks = [(tier.isNull() | ~tier.isin(*need.tiers), "tier_not_accepted")]
    if need.require_source:
        checks.append((source.isNull(), "source_missing"))
    if not need.allow_unknown_age:
        checks.append((observed_at.isNull(), "observed_at_missing"))
    checks += [(age < F.lit(-need.max_future_skew_minutes * 60e6), "observed_at_in_future"), (age > limit * 3600e6, "stale")]
    if need.minimum_samples is not None:
        checks.append((samples.isNull() | (samples < need.minimum_samples), "too_few_samples"))
    if need.require_bounds:
        checks.append((lower.isNull() | upper.isNull(), "bounds_missing"))
    return first_reason(*checks)


def gate_reason(value: Column, lower: Column, upper: Column, minimum: str | None, maximum: str | None, robust: bool, name: str) -> Column:
    """A gate off the axes: the minimum tests the lower bound, the maximum the upper one, if robust."""
    checks = []
    low, high = (lower, upper) if robust else (value, value)
    if minimum is not None:
        checks += [(low.isNull(), f"{name}:missing"), (low < F.lit(minimum).cast("decimal(38,9)"), f"{name}:below_minimum")]
    if maximum is not None:
        checks += [(high.isNull(), f"{name}:missing"), (high > F.lit(maximum).cast("decimal(38,9)"), f"{name}:above_maximum")]
    return first_reason(*checks) if checks else F.lit(None).cast("string")


def split(df: DataFrame, reasons_column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; the rejected keep all reasons."""
    return df.filter(F.size(reasons_column) == 0).drop(reasons_column), df.filter(F.size(reasons_column) > 0)


def frontier_admissions(offerings: DataFrame, policies: DataFrame) -> DataFrame:
    """Each offering under each frontier's policy: decision, reason and marker.

    ``policies`` is the policy table (frontier_id, mode): a handful of rows, checked to be at most
    1024, which bounds what the join multiplies by and what is broadcast.
    """
    if policies.limit(1025).count() > 1024:
        raise ValueError("more than 1024 frontier policies")
    both = offerings.crossJoin(F.broadcast(policies))
    mode, has_quality, vendor = F.col("mode"), F.col("has_quality"), F.col("vendor_reported")
    decision = (
        F.when(has_quality, "admit")
        .when(mode == "allow_catalog_only", "admit")
        .when((mode == "allow_vendor_reported") & vendor, "admit")
        .when(mode == "mark_unverified", "admit_unverified")
        .otherwise("hold")
    )
    reason = (
        F.when(has_quality, "quality_evidence")
        .when(mode == "allow_catalog_only", "catalog_only_allowed")
        .when((mode == "allow_vendor_reported") & vendor, "vendor_reported_allowed")
        .when(mode == "mark_unverified", "unverified")
        .otherwise("quality_required")
    )
    marker = F.when(~has_quality & (decision != "hold"), F.lit("provisional"))
    return both.select("offering_id", "frontier_id", decision.alias("decision"), reason.alias("reason"), marker.alias("marker"))
