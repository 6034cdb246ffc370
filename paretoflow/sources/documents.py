"""Artifact documents: snapshots, policies, manifests, evidence and records, one JSON object a file.

Each kind has its schema; a field of the wrong type fails the read, and so does a document without
what its kind requires. Decimals arrive as text and stay text in nested fields; the functions that
explode a document cast them. A folder of documents is read as one table, a row for each.

Snapshots, selections, views and publications carry the SHA-256 of their own canonical JSON without that
field. :func:`read_verified` checks it on the text as written, unknown fields included, and refuses a
document that was changed; :func:`sealed` names documents that are built from columns. A format that gained
optional fields keeps older identities by leaving unused ones out; ``IDENTITIES`` lists each kind's rules,
today's first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical
from .files import EXACT, OFFERING_KEY, SOURCE

# The shapes of the document formats.
WORKLOAD = "struct<id:string,version:string,unit:string>"
AXIS = "struct<metric:string,goal:string,unit:string,epsilon_absolute:string,epsilon_relative:string>"
ESTIMATE = f"struct<value:string,unit:string,evidence_tiers:array<string>,lower:string,upper:string,dependencies:array<string>,source_ids:array<string>,sources:array<{SOURCE}>,oldest_observed_at:timestamp,minimum_sample_count:bigint>"
EVALUATED = f"struct<offering:{OFFERING_KEY},axes:map<string,{ESTIMATE}>,metadata:map<string,string>,dominated_by:array<string>>"
CANDIDATE = f"struct<offering:{OFFERING_KEY},axes:map<string,{ESTIMATE}>>"
CHOICE = f"struct<offering:{OFFERING_KEY},axes:map<string,{ESTIMATE}>,metadata:map<string,string>>"
FILE = "struct<path:string,sha256:string,bytes:bigint>"
MEASUREMENT = "struct<id:string,role:string,value:string,unit:string,evidence_tier:string,lower:string,upper:string,sample_count:bigint>"
RESULT = f"struct<primary_metric:string,measurements:array<{MEASUREMENT}>,counts:array<struct<id:string,role:string,value:bigint>>,observed_at:timestamp,metadata:map<string,string>>"
RIGHTS = "struct<license_expression:string,terms_locator:string,publication_permission:string,reviewed_at:timestamp,review_evidence:string>"
SUBJECT = "struct<row_id:string,kind:string,system_label:string,route_disclosure:string,model_claims:array<struct<model_id:string,provider:string,revision:string>>>"
CHECKS = "struct<passed:bigint,total:bigint>"
AXIS_VALUE = "struct<value:string,unit:string,lower:string,upper:string,environment_values:map<string,string>>"
POINT = f"struct<model_id:string,axes:map<string,{AXIS_VALUE}>,dominated_by:array<string>>"
KINDS = {
    "frontier": f"snapshot_id string, config_hash string, catalog_hash string, generated_at timestamp, frontier_id string, workload {WORKLOAD}, order_by string, uncertainty string, axes array<{AXIS}>, members array<{EVALUATED}>, evaluated array<{EVALUATED}>, rejected array<struct<offering_id:string,reasons:array<string>>>, axis_evidence struct<inventory_id:string,candidate_universe_hash:string,candidates:array<{CANDIDATE}>>, public_release_blocked boolean, sources array<{SOURCE}>, source_watermarks map<string,timestamp>",
    "model_view_policy": "schema_version string, policy_id string, source_snapshot_id string, aggregation string, environments array<struct<environment_id:string>>, models array<struct<model_id:string,provider:string,offerings:map<string,string>>>",
    "model_view": f"view_id string, policy_id string, source_snapshot_id string, frontier_id string, workload {WORKLOAD}, order_by string, uncertainty string, axes array<{AXIS}>, best_available struct<reduction:string,members:array<struct<model_id:string,offerings:array<{CANDIDATE}>>>>, balanced_average struct<aggregation:string,panel_rule:string,members:array<{POINT}>,evaluated:array<{POINT}>>",
    "selection": f"snapshot_id string, policy_hash string, frontier_snapshot_id string, selection_id string, frontier_id string, workload {WORKLOAD}, strategy string, order_by string, requested_count bigint, max_per_provider bigint, on_insufficient string, generated_at timestamp, valid_until timestamp, default {CHOICE}, fallbacks array<{CHOICE}>",
    "publication": f"publication_id string, project_id string, previous_publication_id string, project_hash string, generated_at timestamp, policy struct<public:boolean,allowed_licenses:array<string>,authorized_source_ids:array<string>>, frontiers array<struct<frontier_id:string,snapshot_id:string,snapshot:{FILE},csv:{FILE},table:{FILE},history:{FILE},feed:{FILE}>>, selections array<struct<selection_id:string,snapshot_id:string,frontier_id:string,frontier_snapshot_id:string,snapshot:{FILE}>>",
    "history": f"frontier_id string, entries array<struct<snapshot_id:string,generated_at:timestamp,workload:{WORKLOAD},config_hash:string,catalog_hash:string,axis_hash:string,view_hash:string,snapshot:{FILE}>>",
    "quality_evidence": f"schema_version string, source_identity struct<source_id:string,source_version:string,split:string>, rights {RIGHTS}, rows array<struct<subject:{SUBJECT},result:{RESULT},invalid_result:struct<code:string,detail:string>>>",
    "local_measurement": f"measurement_id string, status string, started_at timestamp, completed_at timestamp, hardware struct<hardware_id:string,power_mode:string>, artifact struct<model_id:string,format:string,quantization:string,source_url:string,license:string>, runtime struct<runtime_id:string,version:string,backend:string,context_capacity_tokens:bigint,kv_cache:string,prefix_cache_enabled:boolean,agent_harness:string>, workload struct<reference:{WORKLOAD},kind:string,input_definition_sha256:string,requested_input_tokens:bigint,max_output_tokens:bigint,repetitions:bigint,concurrency:bigint,runner_state:string,prefix_cache_state:string,position:map<string,string>>, performance struct<actual_input_tokens:bigint,output_token_counts:array<bigint>,metrics:map<string,struct<unit:string,values:array<string>>>>, integrity struct<retrieval:{CHECKS},retrieval_value:{CHECKS},tool_calls:{CHECKS},tool_argument_parsing:{CHECKS},structured_output:{CHECKS}>, capabilities array<string>, provenance struct<tool:string,tool_version:string,raw_artifact_path:string,raw_sha256:string,captured_at:timestamp,methodology:string,source_url:string,license:string>",
    "published_benchmarks": "offering_id string, benchmark string, methodology string, evidence_label string, score string, source_url string",
    "reconciliation": f"schema_version string, entries array<struct<row_id:string,subject_identity_sha256:string,adapter_id:string,projection_version:string,relationship:string,offering:{OFFERING_KEY},review_evidence:string,reviewed_at:timestamp>>",
    "import_report": f"schema_version string, publication_scope string, records array<struct<row_id:string,outcome:string,relationship:string,offering:{OFFERING_KEY}>>, mapped_rows array<struct<row_id:string,relationship:string,subject_identity_sha256:string,evidence_result_sha256:string,offering:{OFFERING_KEY},result:{RESULT}>>",
    "paired_estimate": f"estimate_id string, anchor_offering {OFFERING_KEY}, candidate_offering {OFFERING_KEY}, metric_id string, unit string, metric_minimum string, metric_maximum string, full_anchor_score string, items array<struct<item_id:string,task_group:string,seed:bigint,anchor_score:string,candidate_score:string,weight:string>>, paired_delta string, paired_delta_lower string, paired_delta_upper string, validation struct<held_out_offering_count:bigint,absolute_error_bound:string,coverage_probability:string>, estimated_value string, estimated_lower string, estimated_upper string, observed_at timestamp",
    "enrichment_policy": f"policy_id string, base_workload {WORKLOAD}, output_workload_id string, output_workload_unit string, projections array<struct<projection_id:string,catalog_sha256:string,workload:{WORKLOAD},mappings:array<struct<source:{OFFERING_KEY},target:{OFFERING_KEY},signals:array<string>>>>>",
    "portfolio_policy": f"portfolio_id string, version string, output_workload {WORKLOAD}, components array<struct<component_id:string,frontier_id:string,workload:{WORKLOAD},quality_axis:{AXIS},output_signal:string,max_age_seconds:bigint,correlation_group:string>>, required_component_ids array<string>, minimum_measured_components bigint",
    "portfolio_derivation": f"snapshot_id string, policy_hash string, generated_at timestamp, valid_until timestamp, bindings array<struct<component_id:string,frontier_snapshot_id:string,config_hash:string,catalog_hash:string,generated_at:timestamp>>, base_catalog_hash string, catalog_hash string, candidates array<struct<offering:{OFFERING_KEY},component_failures:map<string,array<string>>>>",
}
#: What a document of a kind cannot be without.
REQUIRED = {
    "frontier": ("snapshot_id", "frontier_id", "workload", "axes", "members", "evaluated"), "model_view_policy": ("policy_id", "source_snapshot_id", "models"),
    "model_view": ("view_id", "frontier_id", "best_available"), "selection": ("snapshot_id", "selection_id", "default", "valid_until"),
    "publication": ("publication_id", "project_id", "frontiers"), "history": ("frontier_id", "entries"), "quality_evidence": ("rights", "rows"),
    "local_measurement": ("measurement_id", "completed_at", "hardware", "artifact", "runtime", "workload", "provenance"),
    "published_benchmarks": ("offering_id", "benchmark", "methodology", "score"), "reconciliation": ("entries",), "import_report": ("records", "mapped_rows"),
    "paired_estimate": ("estimate_id", "candidate_offering", "metric_id", "estimated_value"), "enrichment_policy": ("policy_id", "projections"),
    "portfolio_policy": ("portfolio_id", "components", "required_component_ids"), "portfolio_derivation": ("snapshot_id", "generated_at", "valid_until", "candidates"),
}

# What a document's identity leaves out, by kind and rule.
_TIERS = {f"{at}.evidence_tiers": '["measured"]' for at in ("members[].axes{}", "evaluated[].axes{}", "axis_evidence.candidates[].axes{}")}
_BILLING = {f"{at}.offering.billing_mode": "null" for at in ("members[]", "evaluated[]", "axis_evidence.candidates[]")}
_UNUSED = {"axis_evidence": "null", "public_release_blocked": "false"}
_OWN = {"snapshot_id": None}
IDENTITIES: dict[str, tuple[str, tuple[canonical.Drop, ...]]] = {
    "frontier": ("snapshot_id", ({**_OWN, **_TIERS, **_BILLING, **_UNUSED}, {**_OWN, **_TIERS, **_UNUSED}, _OWN, {**_OWN, **_UNUSED})),
    "selection": ("snapshot_id", ({**_OWN, "default.offering.billing_mode": "null", "fallbacks[].offering.billing_mode": "null"},)),
    "publication": ("publication_id", ({"publication_id": None},)),
    "model_view": ("view_id", ({"view_id": None},)),
}


class DocumentError(ValueError):
    """A document is not of its kind."""


def read_document(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The documents of one kind at a path. ``published_benchmarks`` is an array of objects, the others are objects."""
    if kind not in KINDS:
        raise DocumentError("unknown kind of document")
    found = spark.read.schema(KINDS[kind]).json(path, multiLine=True, mode="FAILFAST")
    absent = F.lit(False)
    for column in REQUIRED[kind]:
        absent = absent | F.col(f"`{column}`").isNull()
    # The check belongs to the plan: no document is read twice.
    return found.filter(F.when(absent, F.raise_error(F.lit(f"a {kind} document lacks a required field"))).otherwise(F.lit(True)).cast("boolean"))


def verified_by(text: Column, kind: str) -> Column:
    """The number of the rule under which a JSON text carries its own hash; null for none: it was changed, or is no document."""
    own, rules = IDENTITIES[kind]
    named = F.get_json_object(text, f"$.{own}")
    place = F.array_position(canonical.text_hashes(text, rules), named)
    return F.when(place > 0, (place - 1).cast("int"))


def read_verified(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The documents of a kind that carries its own hash; one that was changed fails the read, by its file's name."""
    if kind not in IDENTITIES:
        raise DocumentError("this kind of document has no hash of its own")
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    refused = F.raise_error(F.concat(F.lit(f"{kind} document does not carry its own hash: "), F.col("file")))
    checked = files.select(F.when(verified_by(F.col("value"), kind).isNull(), refused).otherwise(F.col("value")).alias("value"))
    found = checked.select(F.from_json("value", KINDS[kind], {"mode": "FAILFAST"}).alias("d")).select("d.*")
    absent = F.greatest(*[F.col(f"`{c}`").isNull() for c in REQUIRED[kind]], F.lit(False))
    return found.filter(F.when(absent, F.raise_error(F.lit(f"a {kind} document lacks a required field"))).otherwise(F.lit(True)).cast("boolean"))


def identity(documents: DataFrame, kind: str, rule: int = 0) -> Column:
    """The hash that documents held in columns carry, under one rule of their kind."""
    columns = {f.name: f.dataType for f in documents.schema.fields}
    return canonical.json_hash(canonical.canonical_json(F.struct(*columns), canonical.row_kind(columns), IDENTITIES[kind][1][rule]))


def sealed(documents: DataFrame, kind: str, rule: int = 0) -> DataFrame:
    """The documents with their hash in the field for it, and their canonical text in ``text``."""
    own = IDENTITIES[kind][0]
    named = documents.drop(own).withColumn(own, identity(documents.drop(own), kind, rule))
    whole = canonical.canonical_json(F.struct(*named.columns), named.schema)
    return named.withColumn("text", whole)


def _part(documents: DataFrame, *columns: str) -> Column:
    kinds = {c: documents.schema[c].dataType for c in columns}
    return canonical.canonical_json(F.struct(*columns), canonical.row_kind(kinds))


def axis_hash(frontiers: DataFrame) -> Column:
    """What makes two snapshots comparable: workload, order, uncertainty and axes."""
    return canonical.json_hash(_part(frontiers, "axes", "order_by", "uncertainty", "workload"))


def view_hash(frontiers: DataFrame) -> Column:
    """What a reader of a frontier sees: members in order, each with its offering, the values on every axis, and metadata."""
    member = frontiers.schema["members"].dataType.elementType
    drop = {"billing_mode": "null"}
    seen = [c for c in ("value", "lower", "upper") if c in member["axes"].dataType.valueType.names]
    value_kind = T.StructType([member["axes"].dataType.valueType[c] for c in seen])

    def one(m: Column) -> Column:
        def on_axis(a: Column) -> Column:
            estimate = F.try_element_at(m["axes"], a["metric"])
            values = canonical.canonical_json(F.struct(*[estimate[c].alias(c) for c in seen]), value_kind)
            return F.concat(F.lit("["), canonical.canonical_json(a["metric"], T.StringType()), F.lit(","), values, F.lit("]"))

        axes = F.concat(F.lit("["), F.array_join(F.transform("axes", on_axis), ","), F.lit("]"))
        parts = (canonical.canonical_json(m["offering"], member["offering"].dataType, drop), axes, canonical.canonical_json(m["metadata"], member["metadata"].dataType))
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    return canonical.json_hash(F.concat(F.lit("["), F.array_join(F.transform("members", one), ","), F.lit("]")))


def catalog_hash(catalogs: DataFrame) -> Column:
    """The hash of catalogs in one row each, ``offerings`` in any order."""
    columns = {f.name: f.dataType for f in catalogs.schema.fields}
    name = lambda x: x["offering"]["offering_id"]
    ordered = F.array_sort("offerings", lambda a, b: F.when(name(a) < name(b), -1).when(name(a) > name(b), 1).otherwise(0)).alias("offerings")
    row = F.struct(*[ordered if c == "offerings" else F.col(f"`{c}`") for c in columns])
    return canonical.json_hash(canonical.canonical_json(row, canonical.row_kind(columns), {"offerings[].offering.billing_mode": "null"}))


def frontier_points(frontiers: DataFrame) -> DataFrame:
    """snapshot_id, offering_id, metric, value, lower, upper, member and rank of every evaluated point."""
    ranked = frontiers.select("snapshot_id", F.posexplode("members").alias("rank", "m")).select(
        "snapshot_id", F.col("m.offering.offering_id").alias("offering_id"), (F.col("rank") + 1).alias("rank")
    )
    points = frontiers.select("snapshot_id", F.explode("evaluated").alias("e")).select("snapshot_id", F.col("e.offering.offering_id").alias("offering_id"), F.explode("e.axes").alias("metric", "x"))
    values = [F.col(f"x.{c}").cast(EXACT).alias(c) for c in ("value", "lower", "upper")]
    return points.join(ranked, ["snapshot_id", "offering_id"], "left").select("snapshot_id", "offering_id", "metric", *values, F.col("rank").isNotNull().alias("member"), "rank")


def axis_inventory(frontiers: DataFrame) -> DataFrame:
    """Evidence of every candidate's axes, rejected ones too: snapshot_id, offering_id, metric, value, oldest_observed_at."""
    each = frontiers.select("snapshot_id", F.explode("axis_evidence.candidates").alias("c"))
    return each.select("snapshot_id", F.col("c.offering.offering_id").alias("offering_id"), F.explode("c.axes").alias("metric", "x")).select(
        "snapshot_id", "offering_id", "metric", F.col("x.value").cast(EXACT).alias("value"), "x.oldest_observed_at"
    )


def history_entries(histories: DataFrame) -> DataFrame:
    """Entries of frontier histories; an index that is not newest first, or repeats a snapshot, is refused."""
    rows = histories.select("frontier_id", "entries", F.posexplode("entries").alias("place", "e"))
    after = F.try_element_at("entries", F.col("place") + 2)
    ordered = after.isNull() | (F.struct("e.generated_at", "e.snapshot_id") > F.struct(after["generated_at"], after["snapshot_id"]))
    once = F.size(F.array_distinct(F.transform("entries", lambda x: x["snapshot_id"]))) == F.size("entries")
    checked = F.when(ordered & once, F.col("place")).otherwise(F.raise_error(F.lit("history is not newest first and unique")).cast("int"))
    return rows.select("frontier_id", checked.alias("place"), "e.*")


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """row_id, subject, result, invalid_result and rights of each row of evidence sets."""
    return evidence.select("rights", F.explode("rows").alias("r")).select(F.col("r.subject.row_id").alias("row_id"), "r.subject", "r.result", "r.invalid_result", "rights")


def measurement_samples(records: DataFrame) -> DataFrame:
    """measurement_id, metric, unit, completed_at and the exact sample values of local measurements."""
    each = records.select("measurement_id", "completed_at", F.explode("performance.metrics").alias("metric", "m"))
    return each.select("measurement_id", "metric", "m.unit", "completed_at", F.transform("m.values", lambda v: v.cast(EXACT)).alias("values"))
