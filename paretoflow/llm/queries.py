"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, hyperminhash, mixing, packing, paragraphs, quality, repeats, scoring, telephony, toxicity, training_order, whitening
from .common import materialize, read


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(mixing.measured(read(spark, sf_dir, "documents")), "op4-rows")
    taken = mixing.counted(rows, mixing.plan(rows))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def op1_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store(telephony.payloads(read(spark, sf_dir, "documents")))
    return telephony.decode(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.cut(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
        F.octet_length(F.col("row.text")).cast("long").alias("n_bytes_kept"),
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"),
        "n_words_cut",
        "row.text",
    )


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(read(spark, sf_dir, "documents"))
    cut = materialize(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "op6-pieces")
    return packing.pack(cut, cut.count()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = training_order.materialise(read(spark, sf_dir, "documents"))
    return table.select(
        "shard", "first_slot", "n_sequences", "stride",
        F.octet_length("data").cast("long").alias("n_bytes"),
        F.sha2("data", 256).alias("data_sha256"),
        "doc_ids",
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit_on_labels(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "quality.base_failed",
        "quality.kept",
        "quality.content_share",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", "predicted")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
        "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(planted)
    return chat.summarize(chat.expand(turns))


_OP7_ESC = r"regexp_replace({}, '([<\[])(\\*)(/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"

OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    17 + length({_OP7_ESC.format('role')}) + length({_OP7_ESC.format('text')}) AS l FROM t),
c AS (SELECT *, sum(l) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' OR i = n THEN upto END), 0) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (SELECT doc_id, part, (len(words) < 200) AS A, (100 * len(list_distinct(words)) < 50 * len(words)) AS B,
  (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)) AS C, regexp_matches(t, '[#$%&*|]') AS D,
  coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS E FROM w),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END
  || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END AS fails FROM m LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x)
  JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
hit AS (SELECT c.*, o, s, f, contains(fails, f) AS failing,
  len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM c, steps),
r AS (SELECT part, o AS filter_order, CAST(s AS INT) AS step, f,
  CAST(sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN NOT gone AND failing THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM hit GROUP BY part, o, s, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def _op4_sql(passes: int = 4) -> str:
    key = "md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))"
    ctes = [
        f"""rows AS (SELECT row_number() OVER () AS rid, doc_id, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  CAST('0x' || substr({key}, 1, 15) AS BIGINT) AS h FROM documents)""",
        "src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM rows GROUP BY source)",
        "w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM src)",
        """o AS (SELECT *, sum(s) OVER () AS total,
  coalesce(sum(3 * s) OVER (ORDER BY s * 10 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY s * 10 // w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w)""",
        "q AS (SELECT *, 3 * s * w_left <= w * (total - before) AS capped FROM o)",
        """q2 AS (SELECT *, total - coalesce(sum(CASE WHEN capped THEN 3 * s END) OVER (), 0) AS rest,
  sum(CASE WHEN NOT capped THEN w END) OVER () AS w_open FROM q)""",
        """plan AS (SELECT source, s AS source_size,
  CASE WHEN capped THEN CAST(3 * s AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(w_open AS DOUBLE) END AS target,
  CASE WHEN capped THEN 3 ELSE CAST((w * rest) // (w_open * s) AS BIGINT) END AS whole FROM q2)""",
        "p0 AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS budget, CAST(-1 AS BIGINT) AS after, CAST(4611686018427387904 AS BIGINT) AS fits FROM plan)",
    ]
    for k in range(passes):
        ctes += [
            f"""c{k} AS (SELECT r.rid, r.source, r.h, r.size, p.budget,
  sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN p{k} p ON r.source IS NOT DISTINCT FROM p.source AND r.h > p.after AND r.size <= p.fits)""",
            f"t{k} AS (SELECT rid FROM c{k} WHERE upto <= budget)",
            f"""u{k} AS (SELECT source, coalesce(max(CASE WHEN upto <= budget THEN upto END), 0) AS used,
  coalesce(min(CASE WHEN upto > budget THEN h END), 1152921504606846976) AS bound FROM c{k} GROUP BY source)""",
            f"""p{k + 1} AS (SELECT p.* REPLACE (p.budget - coalesce(u.used, 0) AS budget, coalesce(u.bound, 1152921504606846976) AS after,
  p.budget - coalesce(u.used, 0) AS fits) FROM p{k} p LEFT JOIN u{k} u ON p.source IS NOT DISTINCT FROM u.source)""",
        ]
    more = " UNION ALL ".join(f"SELECT rid FROM t{k}" for k in range(passes))
    return f"""WITH {', '.join(ctes)}
SELECT r.doc_id, r.size, p.source_size, p.target, CAST(r.size * least(p.whole + CASE WHEN m.rid IS NULL THEN 0 ELSE 1 END, 3) AS BIGINT) AS taken,
  r.source, CAST(least(p.whole + CASE WHEN m.rid IS NULL THEN 0 ELSE 1 END, 3) AS BIGINT) AS copies
FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source LEFT JOIN (SELECT DISTINCT rid FROM ({more})) m ON r.rid = m.rid"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_score": op1_score,
        "op2_telephony": op2_telephony,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_mix_sources": op4_mix_sources,
        "op5_paragraphs": op5_paragraphs,
        "op6_pack": op6_pack,
        "op7_chat_format": op7_chat_format,
        "op8_training_order": op8_training_order,
        "op9_repeats": op9_repeats,
        "op10_quality_lines": op10_quality_lines,
        "op11_filter_audit": op11_filter_audit,
        "op12_toxicity": op12_toxicity,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": _op4_sql(), "op7_chat_format": OP7_SQL, "op11_filter_audit": OP11_SQL}
