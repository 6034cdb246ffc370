"""Evidence on its way into catalogs: launch-day facts, reviewed quality rows, paired estimates, rights.

Nothing is invented for what is missing, and nothing that exists is replaced: both are errors or
named failures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, decimal_text, set_hash


class EvidenceError(ValueError):
    """Evidence does not fit its target. The text never echoes values."""


def _refuse(bad: DataFrame, why: str) -> None:
    if bad.limit(1).count():
        raise EvidenceError(why)


# Facts of a model list, the signals they become and their units. Of two facts for one signal the first counts.
PRICES = (
    ("prompt", "input_cost_usd_per_token"), ("completion", "output_cost_usd_per_token"), ("input", "input_cost_usd_per_token"),
    ("output", "output_cost_usd_per_token"), ("cache_read", "cache_read_cost_usd_per_token"), ("cache_write", "cache_write_cost_usd_per_token"),
)
TELEMETRY = {"latency_ms": "milliseconds", "throughput_tokens_per_second": "tokens/second", "uptime": "fraction"}


def provisional(offerings: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Labelled signals of offerings that nobody has evaluated yet: offering_id, signal, value, unit, label, methodology.

    offerings: offering_id, context_length, pricing map<string,string>, telemetry map<string,string>;
    benchmarks: offering_id, benchmark, methodology, evidence_label, score (text). Facts that are no
    plain numbers are absent, not zero; an offering without a signal does not appear.
    """
    _refuse(offerings.groupBy("offering_id").count().filter("count > 1"), "offerings repeat an id")
    _refuse(benchmarks.join(offerings, "offering_id", "left_anti"), "a benchmark names an unknown offering")
    _refuse(benchmarks.groupBy("offering_id", "benchmark").count().filter("count > 1"), "an offering has two scores of one benchmark")
    none = F.lit(None).cast("string")

    def signal(name: str, value: Column, unit: str, label: str) -> Column:
        return F.struct(F.lit(name).alias("signal"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(label).alias("label"), none.alias("methodology"))

    price = lambda k: decimal_text(F.try_element_at("pricing", F.lit(k)))
    facts = [signal("context_length", F.when(F.col("context_length") > 0, F.col("context_length").cast("string")), "tokens", "catalog_verified")]
    for name in dict.fromkeys(n for _, n in PRICES):
        facts.append(signal(name, F.coalesce(*[price(k) for k, n in PRICES if n == name]), "USD/token", "catalog_verified"))
    facts += [signal(k, decimal_text(F.try_element_at("telemetry", F.lit(k))), unit, "aggregator_telemetry") for k, unit in TELEMETRY.items()]
    known = offerings.select("offering_id", F.explode(F.filter(F.array(*facts), lambda s: s["value"].isNotNull())).alias("s")).select("offering_id", "s.*")
    scores = benchmarks.select(
        "offering_id", F.concat(F.lit("benchmark:"), "benchmark").alias("signal"), decimal_text(F.col("score")).alias("value"),
        F.lit("score").alias("unit"), F.col("evidence_label").alias("label"), "methodology",
    )
    return known.unionByName(scores.filter("value IS NOT NULL"))


def discovered(batches: Sequence[DataFrame]) -> DataFrame:
    """One row for each offering id of several listings; the later listing wins."""
    rows = batches[0].withColumn("_seq", F.lit(0))
    for k, b in enumerate(batches[1:], 1):
        rows = rows.unionByName(b.withColumn("_seq", F.lit(k)))
    return rows.groupBy("offering_id").agg(F.max_by(F.struct("*"), "_seq").alias("_r")).select("_r.*").drop("_seq")


def permits(permission: Column, scope: str) -> Column:
    """May a result be published in this scope: internal always, derived and full by the rights' permission."""
    if scope not in ("internal", "derived", "full"):
        raise EvidenceError("unknown scope of publication")
    if scope == "internal":
        return F.lit(True)
    allowed = ("unrestricted", "derived_only") if scope == "derived" else ("unrestricted",)
    return F.coalesce(permission.isin(*allowed), F.lit(False))


def quality_only(measurements: Column) -> Column:
    """What a reviewed mapping may carry to a production route: quality, not the benchmark's cost, latency or usage."""
    return F.filter(measurements, lambda m: m["role"] == "quality")


def project_mapped(evidence: DataFrame, mapped: DataFrame) -> DataFrame:
    """Signals of mapped rows: offering_id, signal, value, unit, lower, upper, sample_count, observed_at.

    evidence: row_id, subject_sha256, result_sha256, observed_at, measurements array<struct<id, role, value,
    unit, lower, upper, sample_count>>; mapped: row_id, offering_id, subject_sha256, result_sha256, exact. A
    mapped row without evidence, or with another digest, is an error. Rows that are no exact route carry
    quality measurements only.
    """
    e, m = evidence.alias("e"), mapped.alias("m")
    joined = m.join(e, F.col("m.row_id") == F.col("e.row_id"), "left")
    differs = ~F.col("m.subject_sha256").eqNullSafe(F.col("e.subject_sha256")) | ~F.col("m.result_sha256").eqNullSafe(F.col("e.result_sha256"))
    _refuse(joined.filter(F.col("e.row_id").isNull() | differs), "a mapped row differs from its evidence, or has none")
    carried = F.when(F.col("m.exact"), F.col("e.measurements")).otherwise(quality_only(F.col("e.measurements")))
    rows = joined.select("m.offering_id", "e.observed_at", F.explode(carried).alias("x"))
    return rows.select("offering_id", F.col("x.id").alias("signal"), "x.value", "x.unit", "x.lower", "x.upper", "x.sample_count", "observed_at")


def item_set_hash(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identity of each group's set of paired items (item_id, task_group, seed), whatever their scores."""
    return items.groupBy(*keys).agg(set_hash([F.col("item_id"), F.col("task_group"), F.col("seed")]).alias("items_sha256"))


def apply_paired(catalog: DataFrame, estimates: DataFrame) -> DataFrame:
    """The long catalog with estimated signals; each estimated offering is marked as not for publication.

    catalog: offering_id, key_sha256 (of the whole identity), signal, value, lower, upper, publication_safe;
    estimates: offering_id, key_sha256, signal, value, lower, upper. The candidate must stand in the
    catalog with the same identity, and must not have the signal.
    """
    own = catalog.select("offering_id", "key_sha256").distinct()
    _refuse(estimates.join(own, ["offering_id", "key_sha256"], "left_anti"), "an estimate's offering is not in the catalog as it was estimated")
    _refuse(estimates.join(catalog, ["offering_id", "signal"], "left_semi"), "an estimated signal would replace one of the catalog")
    _refuse(estimates.groupBy("offering_id", "signal").count().filter("count > 1"), "two estimates of one signal")
    marked = estimates.select("offering_id", F.lit(True).alias("_estimated")).distinct()
    rows = catalog.withColumn("evidence_tier", F.lit("measured")).unionByName(
        estimates.withColumn("publication_safe", F.lit(False)).withColumn("evidence_tier", F.lit("estimated"))
    )
    safe = F.when(F.col("_estimated"), F.lit(False)).otherwise(F.col("publication_safe"))
    return rows.join(marked, "offering_id", "left").withColumn("publication_safe", safe).drop("_estimated")


def failures(sources: Column, observed_at: Column, now: Column, max_age_seconds: Column, skew_seconds: int = 300) -> Column:
    """Sorted names of what is wrong with an estimate's evidence; empty if nothing is, ``missing`` without an estimate.

    ``sources`` is an array of source descriptors, null without an estimate. Faults of sources hide those of times.
    """
    any_source = lambda test: F.exists(sources, lambda s: test(s))
    ahead = F.timestamp_micros(F.unix_micros(now) + skew_seconds * 1_000_000)
    blank = lambda c: c.isNull() | (c == "")
    of_sources = [
        (F.size(sources) == 0, "source_missing"),
        (any_source(lambda s: blank(s["version"])), "source_version_missing"),
        (any_source(lambda s: blank(s["methodology"])), "source_methodology_missing"),
        (any_source(lambda s: s["raw_sha256"].isNull()), "source_raw_digest_missing"),
        (any_source(lambda s: blank(s["license"]) & s["terms_url"].isNull()), "source_rights_missing"),
        (any_source(lambda s: s["retrieved_at"].isNull()), "source_retrieved_at_missing"),
        (any_source(lambda s: F.coalesce(s["retrieved_at"] > ahead, F.lit(False))), "source_retrieved_at_future"),
    ]
    named = F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in of_sources])))
    micros = F.unix_micros(observed_at) + max_age_seconds.cast("long") * 1_000_000
    time = F.when(observed_at.isNull(), "observed_at_missing").when(observed_at > ahead, "observed_at_future").when(F.unix_micros(now) >= micros, "evidence_stale")
    one = F.array_compact(F.array(time))
    return F.when(sources.isNull(), F.array(F.lit("missing"))).when(F.size(named) > 0, named).otherwise(one)


def portfolio_build(evaluations: DataFrame, required: Sequence[str], minimum: int) -> DataFrame:
    """Candidates with the components they have, their audit and whether they are eligible.

    evaluations: candidate, component, failures array<string>, deadline; one row for each of a
    candidate's two to four components.
    """
    good = F.size("failures") == 0
    return evaluations.groupBy("candidate").agg(
        F.count_if(good).alias("measured"),
        (F.count_if(good & F.col("component").isin(*required)) == len(set(required))).alias("has_required"),
        F.array_sort(F.collect_list(F.when(~good, F.concat_ws(":", F.col("component"), F.array_join("failures", "+"))))).alias("audit"),
        F.min(F.when(good, F.col("deadline"))).alias("deadline"),
    ).withColumn("eligible", F.col("has_required") & (F.col("measured") >= minimum))


def portfolio_problems(build: DataFrame, recorded: DataFrame, generated_at: Column, now: Column, skew_seconds: int = 300) -> DataFrame:
    """One row: is a recorded derivation future-dated, expired, or not what a rebuild gives?

    Both tables are of :func:`portfolio_build`; the record is valid until the first deadline of an eligible candidate.
    """
    columns = ["candidate", "measured", "eligible", "audit", "deadline"]
    left, right = build.select(*columns), recorded.select(*columns)
    differs = left.exceptAll(right).limit(1).unionAll(right.exceptAll(left).limit(1))
    until = recorded.filter("eligible").agg(F.min("deadline").alias("valid_until"))
    # Single rows on both sides.
    found = until.crossJoin(differs.agg((F.count(F.lit(1)) > 0).alias("differs")))
    ahead = F.unix_micros(generated_at) > F.unix_micros(now) + skew_seconds * 1_000_000
    return found.select(
        "valid_until", F.coalesce(ahead, F.lit(False)).alias("future_dated"), F.coalesce(now >= F.col("valid_until"), F.lit(True)).alias("expired"), "differs"
    )


def unlicensed(sources: DataFrame, allowed: Sequence[str], authorized: Sequence[str] = ()) -> DataFrame:
    """Ids of sources that a public publication must not redistribute."""
    fine = F.coalesce(F.col("license").isin(*allowed), F.lit(False)) | F.col("id").isin(*authorized) if allowed or authorized else F.lit(False)
    return sources.filter(~fine).select("id").distinct()


def check_public(catalog: DataFrame, sources: DataFrame, allowed: Sequence[str], authorized: Sequence[str] = ()) -> None:
    """Refuse a public publication of private catalogs, without sources, or with unlicensed ones."""
    _refuse(catalog.filter("publication_safe = false"), "the catalog is marked as not for publication")
    if not sources.limit(1).count():
        raise EvidenceError("a public publication cites its sources")
    _refuse(unlicensed(sources, allowed, authorized), "a source does not permit redistribution")


def provenance_fold(inputs: Column) -> Column:
    """What a formula's inputs say together: oldest time and least sample count if all are known, tiers and sources.

    ``inputs``: array<struct<observed_at, sample_count, evidence_tier, source_id>>.
    """
    all_known = lambda f: (F.size(inputs) > 0) & F.forall(inputs, lambda o: o[f].isNotNull())
    least = lambda f: F.when(all_known(f), F.array_min(F.transform(inputs, lambda o: o[f])))
    names = lambda f: F.array_sort(F.array_distinct(F.array_compact(F.transform(inputs, lambda o: o[f]))))
    tiers = names("evidence_tier")
    return F.struct(
        least("observed_at").alias("oldest_observed_at"), least("sample_count").alias("minimum_sample_count"),
        F.when(F.size(tiers) > 0, tiers).otherwise(F.array(F.lit("measured"))).alias("evidence_tiers"), names("source_id").alias("source_ids"),
    )


def canonical_order(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates by the hash-independent text of their whole identity, and the identity's digest."""
    text = F.to_json(F.struct(*sorted(key)), {"ignoreNullFields": "false"})
    return candidates.withColumn("identity", text).withColumn("identity_sha256", content_hash([F.col("identity")])).orderBy("identity")
