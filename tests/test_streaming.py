"""Monotonic updates against the rule applied one by one, over micro-batches with late and equal times."""

import random
from collections import Counter
from datetime import datetime, timedelta

from paretoflow.streaming import monotonic, run

SCHEMA = "name string, at timestamp, content string"


def told(batches):
    kept, out = {}, Counter()
    for batch in batches:
        for name, at, content in sorted(batch, key=lambda r: (r[0], r[1] is not None, r[1] or datetime.min, r[2] or "")):
            if at is None or content is None:
                verdict = "incomplete"
            elif name not in kept or at > kept[name][0]:
                kept[name], verdict = (at, content), "accepted"
            elif at < kept[name][0]:
                verdict = "rolled_back"
            else:
                verdict = "repeated" if content == kept[name][1] else "equivocal"
            out[name, at, content, verdict] += 1
    return out


def test_updates_only_move_forward(spark):
    r = random.Random(2)
    day = datetime(2024, 1, 1)
    row = lambda k: (r.choice("abc"), None if r.random() < 0.05 else day + timedelta(days=r.randint(0, 6) + k), r.choice(["x", "y", None]))
    batches = [[row(0) for _ in range(25)], [row(-3) for _ in range(15)], [row(2) for _ in range(15)]]
    # An older generation, the same once more, and another one of the same time, each in a batch of its own.
    batches += [[("d", day, "x")], [("d", day - timedelta(days=1), "x"), ("d", day, "x")], [("d", day, "y")]]
    steps = [spark.createDataFrame(b, SCHEMA).repartition(2) for b in batches]
    found = run.drained_in_steps(steps, lambda s: monotonic.followed(s, "name", "at", "content"), "test-updates")
    got = Counter((x["name"], x["at"], x["content"], x["verdict"]) for x in found.collect())
    assert got == told(batches)
    assert {v for n, _, _, v in got if n == "d"} == {"accepted", "rolled_back", "repeated", "equivocal"}


def test_keys_are_judged_a_bucket_at_a_time(spark):
    """Many keys share few calls and states; a null key, an empty one and times below a microsecond's float are kept apart."""
    r = random.Random(5)
    far = datetime(2500, 1, 1)
    names = [None, "", "k", *(f"n{i}" for i in range(300))]
    row = lambda: (r.choice(names), None if r.random() < 0.05 else far + timedelta(microseconds=r.randint(0, 3)), r.choice(["x", "y", "", None]))
    batches = [[row() for _ in range(1500)] for _ in range(3)]
    steps = [spark.createDataFrame(b, SCHEMA).repartition(3) for b in batches]
    found = run.drained_in_steps(steps, lambda s: monotonic.followed(s, "name", "at", "content", buckets=2), "test-buckets")
    got = Counter((x["name"], x["at"], x["content"], x["verdict"]) for x in found.collect())
    marked = [[("0" if n is None else "1" + n, *rest) for n, *rest in b] for b in batches]
    assert got == Counter({(None if n == "0" else n[1:], *rest): k for (n, *rest), k in told(marked).items()})
