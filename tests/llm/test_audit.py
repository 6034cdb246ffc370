"""The filter audit against brute force over all orders, and copies that lie in several ranges."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paretoflow.llm import audit
from tests.llm.conftest import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def failing(data):
    """The letters that each row fails, by their definition."""
    out = []
    for i, text, *_ in data:
        t = text or ""
        w = WORD.findall(t)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        bad += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in t for c in "#$%&*|")
        bad += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in data))
        out.append(bad)
    return out


def expected(data, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    parts = defaultdict(list)
    for r, bad in zip(data, failing(data)):
        parts[r[3] or ""].append((r[0], bad))
    out = {}
    for part, docs in parts.items():
        removals = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removals[f] += len(here)
                lost = [i for i, _ in here]
                alone = sum(b == f for _, b in docs)
                out[part, "".join(order), k + 1] = [len(left), len(here), sum(f in b for _, b in docs) - len(here), alone, sum(i in good for i in lost), sum(i in toxic for i in lost)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removals[order[step - 1]])
    return out


def shown(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def more():
    a = prose(40, 250)
    return rows() + [
        (30, a, "en", "", 0), (31, a, "en", "src1", 0), (32, a + " X#", "en", "src1", 0), (33, "SHOUTED " * 220, "en", None, 0),
        (34, "SHOUTED " * 220, "en", None, 0), (34, "SHOUTED " * 220, "en", None, 0), (-3, "é" * 5000, "en", "src2", 0),
    ]


def test_every_order(spark):
    data = more()
    labels = [(i, i % 2, i % 3 % 2) for i in range(40)] + [(3, 0, 0), (None, 1, 1), (5, None, None), (30, None, 1)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = shown(audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert found == expected(data, labels)
    assert len(found) == 600 * len({r[3] or "" for r in data})


def test_a_group_of_copies_over_many_ranges(spark):
    """One text is most rows, some of them fully repeated; its rows lie in all ranges."""
    text = prose(41, 210)
    data = [(k // 3, text) for k in range(900)] + [(k, prose(1000 + k, 5)) for k in range(60)] + [(None, text)] * 40
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audit.masks(docs.repartition(7)).withColumn("copy", F.col("mask") >= audit.COPY)
        found = Counter((r["doc_id"], r["copy"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = Counter((k // 3, k >= 3) for k in range(900)) + Counter((k, False) for k in range(60)) + Counter({(None, False): 40})
    assert found == want


@pytest.mark.parametrize("text", ["", "a", "A B", "x#", "Àé", "\x1c \x85", "w " * 200, "w%d " * 300])
def test_masks_of_texts(text):
    bits = "".join(f for k, f in enumerate("ABCD") if audit.text_mask(text.encode()) >> k & 1)
    assert bits == failing([(1, text)])[0]


def test_nothing_and_clashing_names(spark, none, clashing):
    nothing = spark.createDataFrame([], LABELS)
    assert audit.audit(none, nothing).count() == 0
    odd = clashing.withColumns({c: F.lit(1) for c in ("mask", "part", "fp", "edge", "good", "all")})
    assert shown(audit.audit(odd, nothing)) == expected(rows(), [])
