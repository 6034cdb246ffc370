"""Registered queries of document identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical
from .plans.tables import MONEY, table
from .queries import query
from .sources import documents, imports, rules

_ODD = 'a "quoted"\tvalue \\ é'


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frontier snapshot for each nation; its suppliers are the members, in the order of their ids."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    offering = F.struct(
        F.lpad(key.cast("string"), 9, "0").alias("offering_id"), F.col("n_name").alias("provider"),
        F.when(key % 2 == 0, "per_token").alias("billing_mode"),
    )
    tiers = F.when(key % 3 == 0, F.array(F.lit("estimated"), F.lit("measured"))).otherwise(F.array(F.lit("measured")))

    def estimate(value, unit):
        return F.struct(value.cast(MONEY).alias("value"), F.lit(unit).alias("unit"), tiers.alias("evidence_tiers"))

    axes = F.create_map(F.lit("quality"), estimate(key, "points"), F.lit("cost"), estimate(F.col("s_acctbal"), "usd"))
    member = F.struct(offering.alias("offering"), axes.alias("axes"), F.create_map(F.lit("note"), F.lit(_ODD), F.lit("name"), F.col("s_name")).alias("metadata"))
    ordered = F.array_sort(F.collect_list(F.struct(key, member.alias("m"))), lambda a, b: (a["s_suppkey"] - b["s_suppkey"]).cast("int"))
    listed = F.transform(ordered, lambda x: x["m"])
    grouped = s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name", "n_nationkey", "n_regionkey").agg(listed.alias("members"))
    axis = lambda m, g: F.struct(F.lit(m).alias("metric"), F.lit(g).alias("goal"), F.lit(0.05).alias("epsilon_relative"))
    return grouped.select(
        F.col("n_name").alias("frontier_id"), F.lit("cost").alias("order_by"), F.lit("point").alias("uncertainty"),
        F.struct(F.lit("w").alias("id"), F.lit(1).alias("version")).alias("workload"),
        F.array(axis("cost", "min"), axis("quality", "max")).alias("axes"), "members",
        (F.col("n_regionkey") == 0).alias("public_release_blocked"), F.lit("1998-08-01 12:30:00.25").cast("timestamp").alias("generated_at"),
        F.lit(None).cast("string").alias("axis_evidence"), "n_nationkey",
    )


_NOTE = r'a \"quoted\"\tvalue \\ é'
_TEXTS = rf"""s AS (SELECT n_name, n_nationkey, n_regionkey, s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, s_name,
  rtrim(rtrim(CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS cost, s_suppkey % 3 <> 0 AS measured,
  CASE WHEN s_suppkey % 2 = 0 THEN '"billing_mode":"per_token",' ELSE '' END AS mode,
  CASE WHEN s_suppkey % 2 = 0 THEN '"billing_mode":"per_token",' ELSE '"billing_mode":null,' END AS mode_null FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT *, CASE WHEN measured THEN '' ELSE '"evidence_tiers":["estimated","measured"],' END AS tiers,
  CASE WHEN measured THEN '"evidence_tiers":["measured"],' ELSE '"evidence_tiers":["estimated","measured"],' END AS tiers_all,
  '"metadata":{{"name":"' || s_name || '","note":"{_NOTE}"}}' AS meta FROM s),
m AS (SELECT *, '"offering_id":"' || id || '","provider":"' || n_name || '"}}' AS named FROM e),
t AS (SELECT *, '{{"axes":{{"cost":{{' || tiers || '"unit":"usd","value":"' || cost || '"}},"quality":{{' || tiers || '"unit":"points","value":"' || s_suppkey || '"}}}},' || meta || ',"offering":{{' || mode || named || '}}' AS now,
  '{{"axes":{{"cost":{{' || tiers_all || '"unit":"usd","value":"' || cost || '"}},"quality":{{' || tiers_all || '"unit":"points","value":"' || s_suppkey || '"}}}},' || meta || ',"offering":{{' || mode_null || named || '}}' AS written,
  '[{{' || mode || named || ',[["cost",{{"value":"' || cost || '"}}],["quality",{{"value":"' || s_suppkey || '"}}]],' || substr(meta, 12) || ']' AS seen FROM m),
g AS (SELECT n_name, n_nationkey, n_regionkey, count(*) AS n, string_agg(now, ',' ORDER BY s_suppkey) AS now, string_agg(written, ',' ORDER BY s_suppkey) AS written, string_agg(seen, ',' ORDER BY s_suppkey) AS seen FROM t GROUP BY ALL),
c AS (SELECT *, '"axes":[{{"epsilon_relative":"0.05","goal":"min","metric":"cost"}},{{"epsilon_relative":"0.05","goal":"max","metric":"quality"}}]' AS axes,
  '"workload":{{"id":"w","version":1}}' AS work, '"frontier_id":"' || n_name || '","generated_at":"1998-08-01T12:30:00.250000Z","members":[' AS head FROM g),
d AS (SELECT *, '{{' || axes || ',' || head || now || '],"order_by":"cost",' || CASE WHEN n_regionkey = 0 THEN '"public_release_blocked":true,' ELSE '' END || '"uncertainty":"point",' || work || '}}' AS doc,
  '{{' || axes || ',"axis_evidence":null,' || head || written || '],"order_by":"cost","public_release_blocked":' || CASE WHEN n_regionkey = 0 THEN 'true' ELSE 'false' END || ',"uncertainty":"point",' || work || '}}' AS doc_written FROM c)"""


@query(
    f"""WITH {_TEXTS}
SELECT n_name AS frontier_id, n AS n_members, sha256(doc) AS snapshot_id, sha256(doc_written) AS written_id,
  sha256('{{' || axes || ',"order_by":"cost","uncertainty":"point",' || work || '}}') AS axis_hash, sha256('[' || seen || ']') AS view_hash FROM d"""
)
def snapshot_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _snapshots(spark, sf_dir).drop("n_nationkey")
    return docs.select(
        "frontier_id", F.size("members").cast("long").alias("n_members"), documents.identity(docs, "frontier").alias("snapshot_id"),
        documents.identity(docs, "frontier", 2).alias("written_id"), documents.axis_hash(docs).alias("axis_hash"), documents.view_hash(docs).alias("view_hash"),
    )


@query(
    f"""WITH {_TEXTS}
SELECT n_name AS frontier_id, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS rule, CASE WHEN n_nationkey % 4 = 1 THEN sha256(doc_written) ELSE sha256(doc) END AS snapshot_id FROM d"""
)
def documents_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, some of an older identity, some changed after they were named, some cut short."""
    rows = _snapshots(spark, sf_dir)
    kind = F.col("n_nationkey") % 4
    parts = []
    for rule in (0, 2):
        own = rows.filter(kind == 1 if rule else kind != 1)
        keys = own.select("frontier_id", "n_nationkey")
        named = documents.sealed(own.drop("n_nationkey"), "frontier", rule).select(F.col("frontier_id").alias("id"), "snapshot_id", "text")
        parts.append(named.join(keys, F.col("id") == F.col("frontier_id")))
    texts = parts[0].unionByName(parts[1])
    changed = F.when(kind == 2, F.replace("text", F.lit('"point"'), F.lit('"robust"'))).when(kind == 3, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return texts.select("frontier_id", documents.verified_by(changed, "frontier").alias("rule"), "snapshot_id")


@query(
    """WITH p AS (SELECT p_brand, '{"offering":{' || CASE WHEN p_size % 2 = 0 THEN '"billing_mode":"flat",' ELSE '' END || '"offering_id":"' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '"},"signals":{"price":"'
  || rtrim(rtrim(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') || '","size":' || p_size || '}}' AS t, p_partkey FROM part)
SELECT p_brand AS catalog_id, count(*) AS n, sha256('{"catalog_id":"' || p_brand || '","offerings":[' || string_agg(t, ',' ORDER BY p_partkey) || ']}') AS catalog_hash FROM p GROUP BY p_brand"""
)
def catalog_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    offering = F.struct(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("offering_id"), F.when(F.col("p_size") % 2 == 0, "flat").alias("billing_mode"))
    signals = F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").cast(MONEY).alias("price"))
    # The order of the list is as rows happen to arrive; the identity is not.
    nested = p.groupBy(F.col("p_brand").alias("catalog_id")).agg(F.collect_list(F.struct(offering.alias("offering"), signals.alias("signals"))).alias("offerings"))
    return nested.select("catalog_id", F.size("offerings").cast("long").alias("n"), documents.catalog_hash(nested).alias("catalog_hash"))


@query(
    """SELECT c_custkey, '{"balance":"' || CASE WHEN c_acctbal = 0 THEN '0' ELSE rtrim(rtrim(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') END || '","key":' || c_custkey || ',"name":"' || c_name || '","tags":["' || c_mktsegment || '",null]}' AS canonical FROM customer"""
)
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts in another order, with white space and exponents, made canonical."""
    value = F.format_string("%.4e", F.col("c_acctbal") / 1000)
    text = F.concat(
        F.lit('{ "tags": ["'), F.col("c_mktsegment"), F.lit('", null],\n "name": "'), F.col("c_name"), F.lit('", "key": '), F.col("c_custkey").cast("string"),
        F.lit(', "balance": '), F.col("c_acctbal").cast(MONEY).cast("string"), F.lit("0e0, \"dropped\": "), value, F.lit("}"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", canonical.canonical_text(text, {"dropped": None}).alias("canonical"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, CAST(s_acctbal AS DECIMAL(18,2)) AS bal, n_name,
  CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 12 = 0 THEN s_suppkey ELSE s_suppkey + 1 END END AS beaten,
  CASE WHEN s_suppkey % 10 = 0 THEN CASE WHEN s_suppkey % 30 = 0 THEN s_suppkey ELSE s_suppkey + 2 END END AS gone FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS frontier_id, count(*) AS n_evaluated, concat_ws(',', CASE WHEN bool_or(bal < -900) THEN 'axis_bounds' END, CASE WHEN bool_or(k % 40 = 7) THEN 'axis_units' END,
  CASE WHEN bool_or(beaten IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s t WHERE t.n = s.n AND t.k = s.beaten)) THEN 'dominators_evaluated' END,
  CASE WHEN bool_or(k % 33 = 0) THEN 'members_are_undominated' END, CASE WHEN bool_or(k % 25 = 4 AND (k % 3 <> 0 OR k % 33 = 0)) THEN 'members_as_evaluated' END,
  CASE WHEN bool_or(beaten = k) THEN 'no_self_dominance' END, CASE WHEN n % 6 = 0 THEN 'order_is_axis' END,
  CASE WHEN bool_or(EXISTS (SELECT 1 FROM s t WHERE t.n = s.n AND t.k = s.gone)) THEN 'rejected_not_evaluated' END) AS broken FROM s GROUP BY n_name, n"""
)
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier documents of nations, read from their JSON, with what breaks their coherence."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    beaten = F.when(k % 3 == 0, F.array(name(F.when(k % 12 == 0, k).otherwise(k + 1)))).otherwise(F.array().cast("array<string>"))
    cost = F.struct(F.col("s_acctbal").cast(MONEY).cast("string").alias("value"), F.when(k % 40 == 7, "eur").otherwise("usd").alias("unit"), F.lit("-900").alias("lower"))
    quality = F.struct(k.cast("string").alias("value"), F.lit("points").alias("unit"), F.lit(None).cast("string").alias("lower"))

    def entry(label):
        return F.struct(
            F.struct(name(k).alias("offering_id")).alias("offering"), F.create_map(F.lit("cost"), cost, F.lit("quality"), quality).alias("axes"),
            F.create_map(F.lit("name"), label).alias("metadata"), beaten.alias("dominated_by"),
        )

    axis = lambda m, g, u: F.struct(F.lit(m).alias("metric"), F.lit(g).alias("goal"), F.lit(u).alias("unit"))
    member = (k % 3 != 0) | (k % 33 == 0)
    gone = F.when(k % 10 == 0, F.struct(name(F.when(k % 30 == 0, k).otherwise(k + 2)).alias("offering_id")))
    grouped = s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name", "n_nationkey").agg(
        F.collect_list(entry(F.col("s_name"))).alias("evaluated"), F.collect_list(gone).alias("rejected"),
        F.collect_list(F.when(member, entry(F.when(k % 25 == 4, F.lit("other")).otherwise(F.col("s_name"))))).alias("members"),
    )
    whole = F.struct(
        F.col("n_name").alias("frontier_id"), F.when(F.col("n_nationkey") % 6 == 0, "latency").otherwise("cost").alias("order_by"),
        F.array(axis("cost", "min", "usd"), axis("quality", "max", "points")).alias("axes"), "evaluated", "rejected", "members",
    )
    found = rules.parsed(grouped.select(F.to_json(whole).alias("text")), "frontier")
    return found.select("frontier_id", F.size("evaluated").cast("long").alias("n_evaluated"), F.array_join(rules.document_failures("frontier"), ",").alias("broken"))


@query(
    """WITH r AS (SELECT l_orderkey AS entry, l_linenumber % 2 AS task, count(*) AS n, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS rate,
  max(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END) AS noted, count(DISTINCT (l_linenumber, l_returnflag = 'N')) < count(*) AS twice FROM lineitem GROUP BY ALL),
e AS (SELECT entry, count(*) AS tasks, 100 * avg(rate) AS accuracy, min(n) = 2 AND max(n) = 2 AS whole, max(noted) AS noted, bool_or(twice) AS twice FROM r GROUP BY entry),
f AS (SELECT *, concat_ws(',', CASE WHEN entry % 7 = 0 THEN '$.agent minLength' END, CASE WHEN entry % 11 = 0 THEN '$.reported maximum' END,
  CASE WHEN twice THEN '$.trials uniqueItems' END, CASE WHEN entry % 13 = 0 THEN '$.url format' END, CASE WHEN noted = 1 THEN '$.verified additionalProperties' END) AS failures, accuracy + CASE WHEN entry % 3 = 0 THEN 9 ELSE 0 END AS told FROM e)
SELECT entry, failures,
  CASE WHEN failures = '' THEN tasks END AS tasks, CASE WHEN failures = '' THEN round(accuracy, 6) END AS accuracy,
  CASE WHEN failures <> '' THEN 'refused' WHEN NOT whole THEN 'trials_missing' WHEN abs(accuracy - least(told, 100)) > 0.05 THEN 'accuracy_differs' ELSE 'valid' END AS verdict FROM f"""
)
def terminal_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions in JSON, some of which break the contract in one way or several."""
    li = table(spark, sf_dir, "lineitem")
    task, passed = F.col("l_linenumber") % 2, F.col("l_returnflag") == "N"
    trial = F.struct(task.cast("string").alias("task"), F.col("l_linenumber").alias("trial"), passed.alias("passed"))
    key = F.col("l_orderkey")
    # One pass over an order's lines: a task is one of these remainders, or null.
    tasks = (-1, 0, 1, None)
    rates = [F.avg(F.when(task.eqNullSafe(F.lit(k)), passed.cast("double"))).alias(f"rate{i}") for i, k in enumerate(tasks)]
    orders = li.groupBy("l_orderkey").agg(F.collect_list(trial).alias("trials"), F.max(F.col("l_quantity") >= 49).alias("noted"), *rates)
    found = [F.col(f"rate{i}") for i in range(len(tasks))]
    rate = F.try_divide(sum((F.coalesce(r, F.lit(0.0)) for r in found[1:]), F.coalesce(found[0], F.lit(0.0))), sum((r.isNotNull().cast("int") for r in found[1:]), found[0].isNotNull().cast("int")))
    told = F.when(key % 11 == 0, 101.0).otherwise(F.least(100 * rate + F.when(key % 3 == 0, 9.0).otherwise(0.0), F.lit(100.0)))
    orders = orders.withColumn("reported", told)
    whole = F.struct(
        F.when(key % 7 == 0, "").otherwise("a").alias("agent"), F.lit("m").alias("model"), F.when(key % 13 == 0, "nowhere").otherwise("https://example.org/run").alias("url"),
        "reported", "trials", F.when(F.col("noted"), True).alias("verified"),
    )
    found = imports.terminal_submissions(orders.select(key.alias("entry"), F.to_json(whole).alias("text")), 2)
    return found.select("entry", F.array_join("failures", ",").alias("failures"), "tasks", F.round("accuracy", 6).alias("accuracy"), "verdict")
