"""Near duplicates of shingle sets: banding, leaders, exact verification in blocks, components.

Both near-duplicate operators feed this with their own sketches. Items of equal sets (128 bits
tell sets apart) are one node from the start. Candidates are nodes that share a band.

1. The members of a band's bucket are compared by estimate inside one task, which returns a spanning
   forest of the pairs near enough to be linked, never the pairs. A bucket too large for a task is cut
   into blocks, each with the bucket's head; members whose block does not connect them to the head
   meet the other blocks too. Components of all forests are the groups: each node is in one group,
   however many buckets and bands it shares with the others.
2. A group's sets are compared exactly with its leader's and with each other in blocks of bounded
   size, which return a spanning forest of their links.
3. Members of a group of several blocks that their block does not link to the leader meet the
   group's other blocks too. Those linked to the leader need not: they are connected. So a hot
   group costs its size times the blocks of its stragglers, not its square.
4. Components of the verified links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import materialize, release
from .components import components

#: Items, and shingles, of one verification block, and bucket members that one task takes on.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
IN_TASK = 2048
#: Buckets up to this size have all their pairs estimated at once.
FEW = 4


def sketch(windows: np.ndarray, owner: np.ndarray, items: int, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets and MinHash registers of all items of a batch at once.

    ``windows`` are shingle hashes, ``owner`` the item of each. Returns the distinct hashes sorted
    within items, where each item's begin (items + 1 bounds), a 128-bit id of each set (two columns),
    and the registers: the smallest value of each of ``registers`` buckets (one-permutation MinHash; empty
    buckets borrow from others by a rule that is the same for all items). Empty sets have id 0.
    """
    order = np.lexsort((windows, owner))
    x, who = windows[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (who[1:] != who[:-1])
    x, who = x[new], who[new]
    n = np.bincount(who, minlength=items)
    bounds = np.concatenate([[0], np.cumsum(n)])
    ids = np.zeros((items, 2), np.int64)
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(hashing.mix(x ^ np.uint64(salt)), out=sums[1:])
        totals = sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)
        ids[:, k] = np.where(n > 0, hashing.mix(totals).view(np.int64), 0)
    value = (x * np.uint64(0xD1342543DE82EF95)) ^ np.uint64(0xA0761D6478BD642F)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(32)
    bucket = ((x >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
    most = np.uint64(2**64 - 1)
    low = np.full(items * registers, most)
    np.minimum.at(low, who * registers + bucket, np.minimum(value, most - np.uint64(1)))
    low = low.reshape(items, registers)
    filled = low != most
    out, have = low.copy(), filled.copy()
    have[n == 0] = True
    for donors in _donors(registers):
        todo = np.flatnonzero(~have.all(1))
        if not len(todo):
            break
        offered = filled[todo][:, donors] & ~have[todo]
        part = out[todo]
        part[offered] = low[todo][:, donors][offered]
        out[todo] = part
        have[todo] |= offered
    for k in np.flatnonzero(~have.all(1)):
        out[k, ~have[k]] = low[k].min()
    return x, bounds, ids, out


_DONORS: dict[int, np.ndarray] = {}


def _donors(registers: int) -> np.ndarray:
    """By attempt and register: from which register an empty one borrows."""
    if registers not in _DONORS:
        x = np.arange(256 * registers, dtype=np.uint64) + np.uint64(registers)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        _DONORS[registers] = ((x >> np.uint64(33)) % np.uint64(registers)).astype(np.int64).reshape(256, registers)
    return _DONORS[registers]


def band_keys(bands: int, width: int) -> Column:
    """Array of band keys from the column ``regs``, ``width`` bytes to a band."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(bands)])


def _spanning(close: Callable, items: int, split: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest, as pairs of index arrays, of the graph that ``close(one, others)`` tells.

    With ``split``, only pairs of one item before and one from ``split`` on are looked at.
    """
    out, left = [], np.arange(items)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.zeros(len(left), bool)
            asked = np.arange(len(left)) if split is None else np.flatnonzero((left < split) != (one < split))
            near[asked] = close(one, left[asked])
            if near.any():
                out.append((left[near], np.full(int(near.sum()), one)))
                front += left[near].tolist()
                left = left[~near]
    return out


def _near(keys: np.ndarray, close: Callable) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Near pairs of whole buckets, by place in the order of the sorted ``keys``: (begin, end, pairs); those of all small buckets first."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(bounds)
    few = np.repeat(sizes <= FEW, sizes)
    pairs = []
    for step in range(1, min(FEW, len(keys))):
        x = np.flatnonzero(few[step:] & (keys[step:] == keys[:-step]))
        x = x[close(x, x + step)] if len(x) else x
        pairs.append((x + step, x))
    yield 0, 0, pairs
    for s, e in zip(bounds[:-1][sizes > FEW].tolist(), bounds[1:][sizes > FEW].tolist()):
        yield s, e, [(s + x, s + y) for x, y in _spanning(lambda one, others: close(s + others, np.full(len(others), s + one)), e - s)]


def stars(nodes: DataFrame, bands: int, width: int, registers: int, estimate: Callable, dtype: str, percent: int) -> DataFrame:
    """(a, b): members and leaders of groups that hold every linked pair of the nodes (node, n, regs); a node is in one group."""
    share = percent / 100
    # Estimates get room for four standard errors, by the size of the smaller set.
    usable = np.minimum(np.arange(registers + 1).clip(1), registers)
    direct = share - 4 * np.sqrt(share * (1 - share) / usable)
    kind = np.dtype(dtype)

    def told(g: pd.DataFrame) -> Callable:
        regs, n = np.frombuffer(b"".join(g["regs"]), kind).reshape(len(g), -1), g["n"].to_numpy()

        def close(x, y):
            small = np.minimum(n[x], n[y]).clip(1, registers)
            return estimate(regs[x], regs[y], n[x], n[y]) >= direct[small]

        return close

    pool = nodes.select(F.col("node").alias("a"), F.explode(band_keys(bands, width)).alias("key"))
    shared = pool.groupBy("key").agg(F.min("a").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = pool.join(shared, "key").select("a", "key", "head", F.ceil(F.col("c") / IN_TASK).cast("long").alias("blocks"))
    met = materialize(met, "near-met")
    c, most = met.agg(F.count(F.lit(1)), F.coalesce(F.max("blocks"), F.lit(1))).first()
    bins = max(1, -(-c // IN_TASK))
    rows = _blocks(met, F.col("a") == F.col("head")).withColumn("split", F.col("blocks") > 1)
    unit = F.when(F.col("split"), F.xxhash64("key", "block")).otherwise(F.pmod("key", F.lit(bins))).alias("unit")
    rows = rows.select(unit, "a", "key", "head", "split").join(nodes.withColumnRenamed("node", "a"), "a")

    def near(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["key", "a"], ignore_index=True)
        ids, head, split, keys = (g[c].to_numpy() for c in ("a", "head", "split", "key"))
        out = []
        for s, e, pairs in _near(keys, told(g)):
            out += [pd.DataFrame({"a": ids[x], "b": ids[y], "late": False}) for x, y in pairs]
            if e and split[s]:
                root = np.arange(e - s)
                for x, y in pairs:
                    root[x - s] = root[y[0] - s]
                alone = root != root[np.flatnonzero(ids[s:e] == head[s])[0]]
                out.append(pd.DataFrame({"a": ids[s:e][alone], "b": keys[s:e][alone], "late": True}))
        return pd.concat(out, ignore_index=True)

    first = materialize(rows.groupBy("unit").applyInPandas(near, "a long, b long, late boolean"), "near-pairs")
    pairs = first.filter("NOT late").select("a", "b")
    if most > 1:

        def across(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["late", "a"], ignore_index=True)
            ids, close = g["a"].to_numpy(), told(g)
            found = _spanning(lambda one, others: close(others, np.full(len(others), one)), len(g), int((~g["late"]).sum()))
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"a": np.concatenate([none, *(ids[x] for x, _ in found)]), "b": np.concatenate([none, *(ids[y] for _, y in found)])})

        late = first.filter("late").select("a", "b")
        placed = met.select("a", F.col("key").alias("b"), F.lit(0).alias("n"), "blocks")
        pairs = pairs.unionAll(_stragglers(late, placed, nodes, across).filter("a <> b"))
    grouped = components(pairs).filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    out = materialize(grouped, "near-stars")
    release(met, first)
    return out


def _blocks(rows: DataFrame, leads: Column) -> DataFrame:
    """Each row with its ``block`` of ``blocks``; one that leads goes to every block."""
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return rows.withColumn("block", F.explode(F.when(leads, everywhere).otherwise(F.array(F.pmod(F.xxhash64("a", F.lit(1)), "blocks")))))


def forest(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Edges that connect just the linked sets: 100 * intersection >= percent * union.

    With ``split``, only pairs of one set before and one from ``split`` on are looked at.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    inter = np.zeros((n, n), np.float64)
    if n <= 8:
        for i in range(n):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort()
                    inter[i, j] = inter[j, i] = (both[1:] == both[:-1]).sum()
    else:
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        shared = counts[inverse] > 1
        column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
        owner = owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        # A few thousand shared shingles at a time, as a 0/1 matrix: products count intersections.
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            s, e = np.searchsorted(column, (low, low + 4096))
            table = np.zeros((n, 4096), np.float32)
            table[owner[s:e], column[s:e] - low] = 1
            inter += table @ table.T
    union = sizes[:, None] + sizes[None] - inter
    link = (100 * inter >= percent * union) & (union > 0)
    np.fill_diagonal(link, False)
    if split is not None:
        link[:split, :split] = link[split:, split:] = False
    out, label = [], np.full(n, -1)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(link[front].any(0) & (label < 0))
            label[front] = root
            out += [(root, int(k)) for k in front]
    return out


def linked(edges: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) within the stars ``edges``; ``sets`` are (node, shingles).

    Small stars share bins. A large one is cut into blocks by hash, each with the leader.
    """
    members = edges.unionAll(edges.select(F.col("b").alias("a"), "b").distinct()).join(nodes.select(F.col("node").alias("a"), "n"), "a")
    sizes = members.groupBy("b").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    placed = materialize(members.join(sizes.select("b", blocks.alias("blocks")), "b"), "near-members")
    c, n, most = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(1))).first()
    bins = max(1, -(-c // BLOCK), -(-n // BLOCK_SHINGLES))
    # The leader goes to every block; the unit of small stars is a bin.
    rows = _blocks(placed, F.col("a") == F.col("b"))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("b"), F.lit(bins))).otherwise(F.xxhash64("b", "block")).alias("unit")
    rows = rows.select(unit, "a", "b", "block", (F.col("blocks") > 1).alias("split")).join(sets.withColumnRenamed("node", "a"), "a")

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, bool]] = []
        for (leader, _), own in g.sort_values("a").groupby(["b", "block"], sort=False):
            ids, split = own["a"].to_numpy(), own["split"].iloc[0]
            found = forest([np.frombuffer(x, np.uint64) for x in own["shingles"]], percent)
            out += [(ids[y], ids[x], False) for x, y in found]
            if split:
                root = np.arange(len(ids))
                root[[y for _, y in found]] = [x for x, _ in found]
                alone = root != root[np.flatnonzero(ids == leader)[0]]
                out += [(v, leader, True) for v in ids[alone]]
        return pd.DataFrame(out, columns=["a", "b", "straggler"]).astype({"a": np.int64, "b": np.int64, "straggler": bool})

    first = materialize(rows.groupBy("unit").applyInPandas(verify, "a long, b long, straggler boolean"), "near-first")
    links = first.filter("NOT straggler").select("a", "b")
    if most > 1:

        def across(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["late", "a"])
            ids = g["a"].to_numpy()
            found = forest([np.frombuffer(x, np.uint64) for x in g["shingles"]], percent, int((~g["late"]).sum()))
            found = [(ids[y], ids[x]) for x, y in found if ids[x] != ids[y]]
            return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

        links = links.unionAll(_stragglers(first.filter("straggler").select("a", "b"), placed, sets, across))
    out = materialize(links, "near-links")
    release(placed, first)
    return out


def _stragglers(late: DataFrame, placed: DataFrame, items: DataFrame, across: Callable) -> DataFrame:
    """Links that ``across`` finds between members (a, b) that their block does not link to the leader and all members of their group.

    ``items`` has what it compares for each node; the rows of members that are not ``late`` go with those that are.
    """
    wide = placed.filter("blocks > 1").select("a", "b", "n", "blocks")
    mine = late.join(wide, ["a", "b"])
    sizes = mine.groupBy("b").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    count = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    sizes = sizes.select("b", count.alias("late"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = mine.join(sizes, "b").select("a", "b", F.explode(upto("blocks")).alias("i"), F.pmod(F.xxhash64("a", F.lit(2)), "late").alias("j"), F.lit(True).alias("late"))
    theirs = wide.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a", F.lit(1)), "blocks").alias("i"), F.explode(upto("late")).alias("j"), F.lit(False).alias("late"))
    rows = mine.unionAll(theirs).join(items.withColumnRenamed("node", "a"), "a")
    return rows.groupBy("b", "i", "j").applyInPandas(across, "a long, b long")


def clusters(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], bands: int, width: int, registers: int, estimate: Callable, dtype: str, percent: int) -> DataFrame:
    """(node, component) of all linked nodes (node, n, regs); ``sets`` gives (node, shingles) of wanted nodes (node)."""
    found = stars(nodes, bands, width, registers, estimate, dtype, percent)
    wanted = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).distinct()
    shingles = materialize(sets(wanted), "near-sets")
    links = linked(found, nodes, shingles, percent)
    out = materialize(components(links), "near-components")
    release(found, shingles, links)
    return out
