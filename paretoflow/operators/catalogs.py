"""Catalogs: composition, enrichment, reconciliation, portfolios, group views.

Catalogs are long tables, one row per (offering_id, signal). Conflicts and gaps are errors or
explicit outcomes, never silently resolved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean_complete
from ..functions.text import content_hash


class CatalogError(ValueError):
    """Catalogs disagree, or a mapping has gaps."""


def compose(catalogs: Sequence[DataFrame], keys: Sequence[str] = ("offering_id", "signal"), values: Sequence[str] = ("value", "unit")) -> DataFrame:
    """Union with equal entries merged: ``sources`` counts them, ``conflict`` marks entries that differ."""
    rows = catalogs[0]
    for c in catalogs[1:]:
        rows = rows.unionByName(c)
    same = F.struct(*values)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"),
        (F.count_distinct(same) > 1).alias("conflict"),
        *[F.min(same)[v].alias(v) for v in values],
    )


def compose_strict(catalogs: Sequence[DataFrame], **more) -> DataFrame:
    out = compose(catalogs, **more)
    if out.filter("conflict").limit(1).count():
        raise CatalogError("catalogs hold different values of one signal")
    return out.drop("conflict", "sources")


def enrich_across(base: DataFrame, projected: DataFrame, mapping: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Signals of mapped source offerings, attached to target offerings.

    ``mapping`` is (source_id, target_id). A mapped source or target that is missing, or a signal
    that the base already has, is an error.
    """
    wanted = projected.filter(F.col("signal").isin(*signals))
    targets = base.select(F.col("offering_id").alias("target_id")).distinct()
    if mapping.join(wanted, mapping.source_id == wanted.offering_id, "left_anti").limit(1).count():
        raise CatalogError("a mapped source has no such signal")
    if mapping.join(targets, "target_id", "left_anti").limit(1).count():
        raise CatalogError("a mapped target is not in the base catalog")
    found = wanted.join(mapping, wanted.offering_id == mapping.source_id).select(
        F.col("target_id").alias("offering_id"), *[c for c in wanted.columns if c != "offering_id"]
    )
    if found.join(base, ["offering_id", "signal"], "left_semi").limit(1).count():
        raise CatalogError("a projected signal would replace one of the base catalog")
    return base.unionByName(found)


#: Fixed value: the outcomes of reconciliation, first match wins.
OUTCOMES = (
    "missing_required_row", "identity_drift", "invalid_result", "research_only_composite", "mutable_alias", "unknown_route",
    "unmapped", "duplicate_target", "license_blocked", "mapped",
)


def outcome(conditions: dict[str, Column]) -> Column:
    """The first of OUTCOMES whose condition holds; ``mapped`` where none does."""
    out = F.lit(OUTCOMES[-1])
    for name in reversed(OUTCOMES[:-1]):
        if name in conditions:
            out = F.when(F.coalesce(conditions[name], F.lit(False)), F.lit(name)).otherwise(out)
    return out


def reconcile(evidence: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Full outer join of evidence and reviewed rows on row_id, with each row's outcome.

    evidence: row_id, subject_sha256, valid, license; reviewed: row_id, subject_sha256, status,
    offering_id, allowed.
    """
    e, r = evidence.alias("e"), with_duplicates(reviewed, "offering_id").alias("r")
    joined = r.join(e, F.col("e.row_id") == F.col("r.row_id"), "full_outer")
    conditions = {
        "missing_required_row": F.col("e.row_id").isNull(),
        "identity_drift": F.col("e.subject_sha256") != F.col("r.subject_sha256"),
        "invalid_result": ~F.col("e.valid"),
        "research_only_composite": F.col("r.status") == "research_only_composite",
        "mutable_alias": F.col("r.status") == "mutable_alias",
        "unknown_route": F.col("r.status") == "unknown_route",
        "unmapped": F.col("r.row_id").isNull() | F.col("r.offering_id").isNull(),
        "duplicate_target": F.col("r.duplicate"),
        "license_blocked": ~F.col("r.allowed"),
    }
    return joined.select(F.coalesce("e.row_id", "r.row_id").alias("row_id"), outcome(conditions).alias("outcome"), "r.offering_id")


def with_duplicates(df: DataFrame, target: str) -> DataFrame:
    """Mark rows whose target another row also names. Counts are combined before they are joined back."""
    twice = df.filter(F.col(target).isNotNull()).groupBy(target).count().filter("count > 1").select(target, F.lit(True).alias("duplicate"))
    return df.join(twice, target, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def portfolio(estimates: DataFrame, candidates: DataFrame, components: Sequence[str], required: Sequence[str], minimum: int) -> DataFrame:
    """Coverage of 2 to 4 components: measured ones, eligibility, and until when it holds.

    estimates: candidate, component, deadline. Eligible: all required components measured, and at
    least ``minimum`` of all. The deadline is the earliest of the measured ones.
    """
    if not 2 <= len(components) <= 4:
        raise CatalogError("a portfolio has two to four components")
    own = estimates.filter(F.col("component").isin(*components))
    per = own.groupBy("candidate").agg(
        F.count_distinct("component").alias("measured"),
        F.count_distinct(F.when(F.col("component").isin(*required), F.col("component"))).alias("required_measured"),
        F.min("deadline").alias("deadline"),
    )
    out = candidates.join(per, "candidate", "left").fillna(0, ["measured", "required_measured"])
    eligible = (F.col("required_measured") == len(set(required))) & (F.col("measured") >= minimum)
    return out.withColumn("eligible", eligible)


def best_available(members: DataFrame, model: str, rank: str = "rank") -> DataFrame:
    """Models with a frontier member, their best rank and number of members."""
    return members.groupBy(model).agg(F.min(rank).alias("best_rank"), F.count(F.lit(1)).alias("members"))


def balanced(evaluated: DataFrame, model: str, panel: DataFrame, values: Sequence[str]) -> DataFrame:
    """Equal-weight mean of each model over a panel of environments; null if one is missing.

    ``panel`` is (model, environment): every pair counts, so a missing one shows.
    """
    full = panel.join(evaluated, [model, "environment"], "left")
    return full.groupBy(model).agg(F.count(F.lit(1)).alias("environments"), *[mean_complete(v).alias(v) for v in values])


def missing_coverage(required: DataFrame, attempted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.select(*keys).distinct().join(attempted.select(*keys).distinct(), list(keys), "left_anti")


def watermarks(df: DataFrame, source: str, at: str) -> DataFrame:
    """Newest observation of each source."""
    return df.groupBy(source).agg(F.max(at).alias("watermark"))


def arg_max_capacity(records: DataFrame, key: str, passed: str, size: str, at: str, tie: str) -> DataFrame:
    """The largest passing record of each key, else the largest attempted one; ties by time, then id."""
    order = F.struct(F.col(passed).cast("int"), size, at, tie)
    return records.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in (tie, size, passed)]), order).alias("_b"), F.count(F.lit(1)).alias("attempts")
    ).select(key, f"_b.{tie}", f"_b.{size}", f"_b.{passed}", "attempts")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins: partial maxima meet before the shuffle, no window is sorted."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")


def combined_basis(basis: Column | str, amount: Column | str | None = None) -> Column:
    """Cost basis of a group. Unknown if any is, or an amount is missing; else included if all are;
    provider_reported if all are; estimated if each is one of the two last; any other mix is unknown.
    """
    b = F.col(basis) if isinstance(basis, str) else basis
    n = F.count(F.lit(1))
    all_of = lambda *kinds: F.count_if(b.isin(*kinds)) == n
    known = F.lit(True)
    if amount is not None:
        known = F.count(F.col(amount) if isinstance(amount, str) else amount) == n
    return (
        F.when(~known | (n == 0), "unknown")
        .when(all_of("included"), "included")
        .when(all_of("provider_reported"), "provider_reported")
        .when(all_of("provider_reported", "estimated"), "estimated")
        .otherwise("unknown")
    )


# Which origins a reported and an estimated cost may have.
REPORTED_SOURCES, ESTIMATED_SOURCES = ("provider_cost_api", "provider_generation_api"), ("provider_models_api", "official_docs_snapshot", "user_override", "custom_contract")


def cost_meter(status: Column, source: Column, estimated: Column, actual: Column) -> tuple[Column, Column, Column]:
    """(basis, amount, problem) of one cost row; a problem says that its fields contradict each other."""
    none = lambda c: c.isNull() | (c == 0)
    sourceless = source.isNull() | (source == "none")
    unknown, is_ = status.isNull() | (status == "unknown"), lambda s: F.coalesce(status == s, F.lit(False))
    problem = (
        F.when(unknown, F.when(~sourceless | ~none(estimated) | ~none(actual), "unknown_with_values"))
        .when(source.isNull(), "source_missing")
        .when(is_("actual"), F.when(~source.isin(*REPORTED_SOURCES) | actual.isNull(), "actual_without_report"))
        .when(is_("estimated"), F.when(~source.isin(*ESTIMATED_SOURCES) | estimated.isNull() | ~none(actual), "estimate_contradicted"))
        .when(is_("included"), F.when((source != "none") | ~none(estimated) | ~none(actual), "included_with_cost"))
        .otherwise("unknown_status")
    )
    basis = F.when(unknown, "unknown").when(is_("actual"), "provider_reported").when(is_("estimated"), "estimated").when(is_("included"), "included")
    amount = F.when(is_("actual"), actual).when(is_("estimated"), estimated).when(is_("included"), F.lit(0))
    return F.when(problem.isNull(), basis), F.when(problem.isNull(), amount), problem


def merge_leaves(leaves: DataFrame, keys: Sequence[str] = ("offering_id", "path"), value: str = "value") -> DataFrame:
    """Metadata of several catalogs, as rows of (offering, path of a leaf, value): equal leaves become one,
    ``conflict`` marks a path with different values, or one that is a leaf here and a branch there.
    """
    merged = leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("sources"), F.min(value).alias(value), (F.min(value) != F.max(value)).alias("conflict"))
    *outer, path = keys
    # All paths above a leaf; as many rows as the path has parts.
    parts = F.split(path, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    branches = merged.filter(F.size(parts) > 1).select(*outer, F.explode(above).alias(path)).distinct().withColumn("_branch", F.lit(True))
    found = merged.join(branches, [*outer, path], "left")
    return found.withColumn("conflict", F.coalesce("conflict", F.lit(False)) | F.col("_branch").isNotNull()).drop("_branch")


def union_sources(sources: Sequence[DataFrame], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(distinct descriptors with their hash, ids with more than one descriptor)."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    distinct = rows.filter(F.col(key).isNotNull()).withColumn("hash", content_hash(columns)).dropDuplicates(["hash"])
    return distinct, distinct.groupBy(key).count().filter("count > 1").select(key)


def superset_missing(earlier: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an earlier publication holds and the current one does not: must be empty before it is replaced."""
    return missing_coverage(earlier, current, keys)


def exact_environments(rows: DataFrame, required: DataFrame, model: str, environment: str, policy: str) -> DataFrame:
    """How each model's set of environments stands to a policy's: ``exact``, ``too_few``, ``too_many`` or ``different``.

    rows: ``model`` and ``environment``; required: ``policy`` and ``environment``, each any number of times. A model
    and a policy that share no environment are no row. Sets are compared by three counts: those of the
    model, of the policy, and of both; no set is gathered. Null environments are none.
    """
    held = rows.select(model, environment).filter(F.col(environment).isNotNull()).distinct()
    asked = required.select(policy, environment).filter(F.col(environment).isNotNull()).distinct()
    own = held.groupBy(model).agg(F.count(F.lit(1)).alias("held"))
    sizes = asked.groupBy(policy).agg(F.count(F.lit(1)).alias("required"))
    both = held.join(asked, environment).groupBy(policy, model).agg(F.count(F.lit(1)).alias("shared"))
    all_held, nothing_else = F.col("shared") == F.col("required"), F.col("shared") == F.col("held")
    verdict = F.when(all_held & nothing_else, "exact").when(nothing_else, "too_few").when(all_held, "too_many").otherwise("different")
    return both.join(own, model).join(sizes, policy).select(policy, model, "held", "required", "shared", verdict.alias("verdict"))
