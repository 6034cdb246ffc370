"""Snapshots over time: entrants and removals, changed ranks and values, semantic changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame, key: str, values: Sequence[str], rank: str = "rank") -> DataFrame:
    """One row per id in either snapshot: entered, removed, moved, changed or same, and both ranks."""
    p, c = previous.alias("p"), current.alias("c")
    moved = F.col(f"p.{rank}") != F.col(f"c.{rank}")
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"p.{v}").eqNullSafe(F.col(f"c.{v}"))
    kind = (
        F.when(F.col(f"p.{key}").isNull(), "entered")
        .when(F.col(f"c.{key}").isNull(), "removed")
        .when(moved, "moved")
        .when(changed, "changed")
        .otherwise("same")
    )
    return p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer").select(
        F.coalesce(f"p.{key}", f"c.{key}").alias(key), kind.alias("change"), F.col(f"p.{rank}").alias("rank_before"), F.col(f"c.{rank}").alias("rank_now")
    )


def meaningful(snapshots: DataFrame, series: Sequence[str], at: str, view: str) -> DataFrame:
    """Snapshots whose view differs from the one before in their series; the first always counts."""
    w = Window.partitionBy(*series).orderBy(at)
    before = F.lag(view).over(w)
    return snapshots.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(view) != F.col("_before"))).drop("_before")


def newest_first(snapshots: DataFrame) -> DataFrame:
    """Snapshots in the order of a history: newest first, then by id, backwards."""
    return snapshots.orderBy(F.col("generated_at").desc(), F.col("snapshot_id").desc())


def feed_items(snapshots: DataFrame, baseline: Sequence[str], view: str = "view_hash", most: int = 20) -> DataFrame:
    """The latest ``most`` items of each frontier's feed, newest first: what changed in meaning, and where a baseline begins.

    snapshots: frontier_id, snapshot_id, generated_at, the view's hash and the ``baseline`` columns. The
    first snapshot, and one whose baseline columns differ from those before it, resets the baseline;
    others are items only if their view differs from the one before.
    """
    order = Window.partitionBy("frontier_id").orderBy("generated_at", "snapshot_id")
    before = lambda c: F.lag(F.struct(*c)).over(order)
    rows = snapshots.dropDuplicates(["frontier_id", "snapshot_id"]).withColumns({
        "previous_id": F.lag("snapshot_id").over(order),
        "_base": before(baseline),
        "_view": F.lag(view).over(order),
    })
    reset = F.col("previous_id").isNull() | ~F.col("_base").eqNullSafe(F.struct(*baseline))
    kept = rows.withColumn("baseline_reset", reset).filter(F.col("baseline_reset") | ~F.col("_view").eqNullSafe(F.col(view)))
    latest = Window.partitionBy("frontier_id").orderBy(F.col("generated_at").desc(), F.col("snapshot_id").desc())
    return kept.withColumn("item", F.row_number().over(latest)).filter(F.col("item") <= most).drop("_base", "_view")


def item_changes(items: DataFrame, members: DataFrame, values: Sequence[str]) -> DataFrame:
    """What each feed item reports: sorted entrants, removals, rank and value changes against the snapshot before.

    members: snapshot_id, offering_id, rank and the axes' ``values``. A baseline reset has no snapshot before it.
    """
    columns = ["rank", *values]
    struct = lambda name: F.struct(*columns).alias(name)
    item = items.select("snapshot_id", F.when(~F.col("baseline_reset"), F.col("previous_id")).alias("previous_id"), "baseline_reset")
    now = item.join(members, "snapshot_id").select("snapshot_id", "offering_id", struct("now"))
    old = members.select(F.col("snapshot_id").alias("previous_id"), "offering_id", struct("old"))
    then = item.filter("previous_id IS NOT NULL").join(old, "previous_id").select("snapshot_id", "offering_id", "old")
    both = now.join(then, ["snapshot_id", "offering_id"], "full_outer")
    compared = both.join(item.filter("NOT baseline_reset").select("snapshot_id"), "snapshot_id")
    ids = lambda test, what=F.col("offering_id"): F.array_sort(F.collect_list(F.when(test, what)))
    moved = F.concat("offering_id", F.lit(":"), F.col("old.rank").cast("string"), F.lit("->"), F.col("now.rank").cast("string"))
    common = F.col("now").isNotNull() & F.col("old").isNotNull()
    values_of = lambda side: F.struct(*[F.col(f"{side}.{v}").alias(v) for v in values])
    changes = compared.groupBy("snapshot_id").agg(
        ids(F.col("old").isNull()).alias("entrants"), ids(F.col("now").isNull()).alias("removals"),
        ids(common & (F.col("old.rank") != F.col("now.rank")), moved).alias("rank_changes"),
        ids(common & ~values_of("now").eqNullSafe(values_of("old"))).alias("value_changes"),
    )
    none = F.array().cast("array<string>")
    return items.join(changes, "snapshot_id", "left").withColumns({c: F.coalesce(c, none) for c in ("entrants", "removals", "rank_changes", "value_changes")})
