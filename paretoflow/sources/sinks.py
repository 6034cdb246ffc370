"""Sinks: content-addressed tables, CSV with safe cells, text tables, JSON lines and change feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, escaped_markup, fixed_point, shown, spreadsheet_safe


def digest(df: DataFrame) -> str:
    """Order-independent SHA-256 of a table's rows; partitioning does not change it.

    Rows hash one by one, and the four quarters of their hashes are summed, so one row reaches the
    driver whatever the size: the count and four wide sums.
    """
    h = content_hash([F.col(f"`{c}`") for c in sorted(df.columns)])
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(f"s{k}") for k in range(4)])
    return row.select(F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row.columns]), 256)).first()[0]


def publish(df: DataFrame, root: str, name: str, generated_at: str) -> str:
    """Write an immutable, digest-named table, then append its line to the manifest; the line commits it.

    Publishing the same content again is a no-op. Returns the digest.
    """
    spark = df.sparkSession
    found = digest(df)
    manifest = f"{root}/manifest"
    schema = "name string, digest string, generated_at string"
    known = spark.read.schema(schema).option("ignoreMissingFiles", True)
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if exists and known.json(manifest).filter((F.col("name") == name) & (F.col("digest") == found)).limit(1).count():
        return found
    df.write.mode("overwrite").parquet(f"{root}/{name}/{found}")
    line = spark.sql("SELECT 1").select(F.lit(name).alias("name"), F.lit(found).alias("digest"), F.lit(generated_at).alias("generated_at"))
    line.coalesce(1).write.mode("append").json(manifest)
    return found


def latest(spark, root: str, name: str) -> DataFrame:
    """The table that the newest manifest line of ``name`` commits."""
    lines = spark.read.schema("name string, digest string, generated_at string").json(f"{root}/manifest")
    row = lines.filter(F.col("name") == name).orderBy(F.col("generated_at").desc(), "digest").first()
    if row is None:
        raise ValueError("nothing published under this name")
    return spark.read.parquet(f"{root}/{name}/{row['digest']}")


def write_safe_csv(df: DataFrame, path: str, plain: Sequence[str] = ("rank",)) -> None:
    """CSV whose text cells no spreadsheet runs as formulas."""
    kinds = dict(df.dtypes)
    cells = [spreadsheet_safe(F.col(f"`{c}`")).alias(c) if kinds[c] == "string" and c not in plain else F.col(f"`{c}`") for c in df.columns]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)


def _cells(df: DataFrame) -> list:
    kinds = dict(df.dtypes)
    return [shown(fixed_point(F.col(f"`{c}`")) if kinds[c].startswith("decimal") else F.col(f"`{c}`")).alias(c) for c in df.columns]


def text_table(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Lines of an aligned table, head first: (line_no, line). Widths come from one aggregate over all rows."""
    cells = df.select(*_cells(df), F.row_number().over(Window.orderBy(*order)).alias("_n"))
    names = df.columns
    widths = cells.agg(*[F.greatest(F.coalesce(F.max(F.char_length(f"`{c}`")), F.lit(0)), F.lit(len(c))).alias(c) for c in names]).first()
    pad = lambda c, n: F.rpad(c, n, " ")
    line = F.concat_ws(" | ", *[pad(F.col(f"`{c}`"), widths[c]) for c in names])
    head = " | ".join(c.ljust(widths[c]) for c in names)
    rule = "-+-".join("-" * widths[c] for c in names)
    top = df.sparkSession.sql("SELECT * FROM VALUES (-1, :head), (0, :rule) AS t(line_no, line)", args={"head": head, "rule": rule})
    return top.unionByName(cells.select(F.col("_n").alias("line_no"), line.alias("line")))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row: keys in order, decimals as fixed-point texts, nulls kept."""
    kinds = dict(df.dtypes)
    fields = [(fixed_point(F.col(f"`{c}`")) if kinds[c].startswith("decimal") else F.col(f"`{c}`")).alias(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def rss_items(items: DataFrame) -> DataFrame:
    """XML of the items of :func:`paretoflow.operators.history.item_changes`: frontier_id, item, xml.

    A feed is its frontier's items in order; at most a thousand, so putting them between a channel's
    head and end is one line for whoever writes the file.
    """
    join = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, escaped_markup), ", ")).otherwise("none")
    short = escaped_markup(F.col("snapshot_id"))
    counted = F.concat_ws(
        "", F.lit(": +"), F.size("entrants").cast("string"), F.lit(" / -"), F.size("removals").cast("string"), F.lit(" / ranks "),
        F.size("rank_changes").cast("string"), F.lit(" / values "), F.size("value_changes").cast("string"),
    )
    title = F.concat(F.lit("Frontier "), short, F.when(F.col("baseline_reset"), ": baseline reset").otherwise(counted))
    when = F.concat(F.date_format("generated_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    body = F.concat(*[F.concat(F.lit(f"{n}: "), join(c), F.lit("; ")) for n, c in (("Entrants", "entrants"), ("Removals", "removals"), ("Rank changes", "rank_changes"), ("Value changes", "value_changes"))])
    tag = lambda name, x, attributes="": F.concat(F.lit(f"<{name}{attributes}>"), x, F.lit(f"</{name}>"))
    xml = tag("item", F.concat(tag("title", title), tag("guid", short, ' isPermaLink="false"'), tag("pubDate", when), tag("description", body)))
    return items.select("frontier_id", "item", xml.alias("xml"))


def rss_feed(items: DataFrame, frontier_id: str, link: str) -> str:
    """The whole feed of one frontier, newest item first: what its bounded items hold."""
    rows = rss_items(items.filter(F.col("frontier_id") == frontier_id)).filter("item <= 1000").orderBy("item").collect()
    name = frontier_id.replace("&", "&amp;").replace("<", "&lt;")
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{name}</title><link>{link}</link>'
    return head + f"<description>Changes to the frontier {name}.</description>" + "".join(r["xml"] for r in rows) + "</channel></rss>"
