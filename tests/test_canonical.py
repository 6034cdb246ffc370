"""Canonical JSON of columns against the one of Python values, identities of documents, and changed documents refused."""

import datetime as dt
import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paretoflow.functions import canonical
from paretoflow.plans import policy
from paretoflow.sources import documents

LETTERS = ["a", "B", "é", "～", "\U0001f600", '"', "\\", "\n", "\x01", "\x7f", "\u2028", "/", " "]
KIND = "s string, m map<string,array<struct<b:decimal(20,6),a:bigint,f:boolean>>>, x double, `～k` int, `\U0001f600k` string"


def some_text(r):
    return "".join(r.choice(LETTERS) for _ in range(r.randint(0, 6)))


def some_row(r):
    entry = lambda: None if r.random() < 0.2 else (Decimal(r.randint(-(10**12), 10**12)).scaleb(-r.randint(0, 6)), r.randint(-5, 1 << 40), r.random() < 0.5)
    listed = lambda: None if r.random() < 0.2 else [entry() for _ in range(r.randint(0, 3))]
    x = r.choice([None, 0.0, -0.0, r.uniform(-1e3, 1e3), r.uniform(-1, 1) * 10.0 ** r.randint(-20, 25), float(r.randint(0, 1000))])
    return (some_text(r), {some_text(r): listed() for _ in range(r.randint(0, 4))}, x, r.choice([None, 3]), some_text(r))


def value_of(row):
    s, m, x, k, e = row
    entries = lambda v: None if v is None else [None if i is None else {"b": i[0], "a": i[1], "f": i[2]} for i in v]
    return {"s": s, "m": {a: entries(b) for a, b in m.items()}, "x": None if x is None else Decimal(repr(x)), "～k": k, "\U0001f600k": e}


def test_columns_and_values_have_the_same_text(spark):
    r = random.Random(4)
    rows = [some_row(r) for _ in range(150)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "id int, " + KIND).repartition(3)
    cells = [c for c in df.columns if c != "id"]
    kind = T.StructType([df.schema[c] for c in cells])
    text = canonical.canonical_json(F.struct(*[F.col(f"`{c}`") for c in cells]), kind)
    found = df.select("id", text.alias("t"), canonical.json_hash(text).alias("h"), canonical.canonical_text(text).alias("again")).collect()
    for x in found:
        want = canonical.canonical_bytes(value_of(rows[x["id"]]))
        assert x["t"].encode() == want and x["h"] == hashlib.sha256(want).hexdigest()
        assert x["again"] == x["t"]  # canonical text is its own canonical text
        assert json.loads(x["t"])["s"] == rows[x["id"]][0]


def test_keys_stand_by_utf16_units():
    # U+1F600 is the units D83D DE00, before U+FF5E.
    assert canonical.canonical_bytes({"～": 1, "\U0001f600": 2, "a": 3}).decode() == '{"a":3,"\U0001f600":2,"～":1}'


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b": 1.50, "a": [1e2, -0.0, 0.1]}', '{"a":["100","0","0.1"],"b":"1.5"}'), ("[1, 2, null, true]", "[1,2,null,true]"),
        ('"\\u0007\\u0041/\\/"', '"\\u0007A//"'), ("[9007199254740991]", "[9007199254740991]"), ("[9007199254740992]", None), ('{"a":1,"a":2}', None), ("[NaN]", None),
        ("[1e5000]", None), ("[1", None), ("", None), (None, None), ('"\\ud800"', None), ("[" * 3000 + "]" * 3000, None), ("0.10000000000000000000000000000000000001", '"0.10000000000000000000000000000000000001"'),
    ],
)
def test_texts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(canonical.canonical_text(F.col("t"))).first()[0] == want


def test_what_has_no_canonical_form_is_null(spark):
    df = spark.createDataFrame([(1 << 53, 1.0, [1.0]), ((1 << 53) - 1, float("nan"), [1.0]), (1, 1.0, [float("inf")]), (1, 1.0, None)], "a bigint, b double, c array<double>")
    found = [r[0] for r in df.select(canonical.canonical_json(F.struct("*"), df.schema)).collect()]
    assert found == [None, None, None, '{"a":1,"b":"1","c":null}']
    with pytest.raises(canonical.CanonicalError):
        canonical.canonical_json(F.lit(b"x"), T.BinaryType())
    with pytest.raises(canonical.CanonicalError):
        canonical.canonical_json(F.lit(None), T.MapType(T.IntegerType(), T.IntegerType()))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_moments_are_utc_in_any_session(spark, zone):
    at = [dt.datetime(2024, 11, 3, 5, 30, tzinfo=dt.timezone.utc), dt.datetime(2024, 3, 10, 7, 15, 1, 250000, tzinfo=dt.timezone.utc), dt.datetime(1969, 12, 31, 23, 59, 59, 1, tzinfo=dt.timezone.utc)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(at)], "k int, t timestamp")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = [r[1] for r in df.select("k", canonical.canonical_json(F.col("t"), T.TimestampType())).orderBy("k").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == ['"2024-11-03T05:30:00Z"', '"2024-03-10T07:15:01.250000Z"', '"1969-12-31T23:59:59.000001Z"']


def snapshot(**changed):
    estimate = {"value": "1.5", "unit": "u", "evidence_tiers": ["measured"], "lower": None, "upper": None}
    member = {"offering": {"offering_id": "a", "provider": "p", "region": None, "billing_mode": None}, "axes": {"cost": dict(estimate), "q": {**estimate, "evidence_tiers": ["proxy"]}}, "metadata": {}, "dominated_by": []}
    base = {
        "snapshot_id": "", "frontier_id": "f", "generated_at": "2026-01-01T00:00:00Z", "workload": {"id": "w", "version": "1", "unit": "u"}, "order_by": "cost", "uncertainty": "point",
        "axes": [{"metric": "cost", "goal": "min"}], "members": [member], "evaluated": [member], "rejected": [], "axis_evidence": None, "public_release_blocked": False, "unknown": {"later": 1},
    }
    return {**base, **changed}


def named(doc, kind="frontier", rule=0):
    own, rules = documents.IDENTITIES[kind]
    return {**doc, own: canonical.value_hash(doc, rules[rule])}


def test_a_snapshot_leaves_out_what_it_does_not_use():
    lean = snapshot()
    del lean["axis_evidence"], lean["public_release_blocked"]
    for m in (*lean["members"], *lean["evaluated"]):
        m["offering"] = {k: v for k, v in m["offering"].items() if k != "billing_mode"}
        m["axes"] = {k: {a: b for a, b in v.items() if a != "evidence_tiers" or b != ["measured"]} for k, v in m["axes"].items()}
    assert named(lean)["snapshot_id"] == named(snapshot())["snapshot_id"]
    assert named(snapshot(public_release_blocked=True))["snapshot_id"] != named(snapshot())["snapshot_id"]
    hashes = {named(snapshot(), rule=k)["snapshot_id"] for k in range(4)}
    assert len(hashes) == 4


def test_changed_documents_are_refused(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    for k in range(4):
        (good / f"{k}.json").write_text(json.dumps(named(snapshot(frontier_id=f"f{k}"), rule=k), indent=k))
    found = documents.read_verified(spark, str(good), "frontier")
    assert sorted(r["frontier_id"] for r in found.collect()) == ["f0", "f1", "f2", "f3"]
    assert documents.frontier_points(found).filter("member").count() == 8
    for name, text in {"changed": json.dumps({**named(snapshot()), "order_by": "q"}), "cut": json.dumps(named(snapshot()))[:-1], "unnamed": json.dumps({k: v for k, v in snapshot().items() if k != "snapshot_id"})}.items():
        bad = tmp_path / name
        bad.mkdir()
        (bad / "x.json").write_text(text)
        with pytest.raises(Exception, match="does not carry its own hash.*x.json"):
            documents.read_verified(spark, str(bad), "frontier").collect()
    lacking = tmp_path / "lacking"
    lacking.mkdir()
    (lacking / "x.json").write_text(json.dumps(named({k: v for k, v in snapshot().items() if k != "axes"})))
    with pytest.raises(Exception, match="lacks a required field"):
        documents.read_verified(spark, str(lacking), "frontier").collect()
    with pytest.raises(documents.DocumentError):
        documents.read_verified(spark, str(good), "history")


def test_selections_views_and_publications(spark):
    choice = lambda mode: {"offering": {"offering_id": "a", "billing_mode": mode}, "axes": {}, "metadata": {}}
    docs = [
        ("selection", {"default": choice(None), "fallbacks": [choice("flat"), choice(None)], "n": 1}), ("publication", {"project_id": "p", "frontiers": []}),
        ("model_view", {"frontier_id": "f", "members": [None, {"x": "1.50"}]}),
    ]
    for kind, doc in docs:
        text = json.dumps(named(doc, kind))
        rows = spark.createDataFrame([(text,), (text.replace('"p"', '"q"').replace('"flat"', '"other"').replace("1.50", "1.5"),)], "t string")
        assert [r[0] for r in rows.select(documents.verified_by(F.col("t"), kind)).collect()] == [0, None]
    lean = {"default": {"offering": {"offering_id": "a"}, "axes": {}, "metadata": {}}, "fallbacks": [], "n": 1}
    assert named(lean, "selection") == {**lean, "snapshot_id": named({**lean, "default": choice(None)}, "selection")["snapshot_id"]}


def test_sealed_columns_carry_the_hash_of_their_text(spark):
    doc = snapshot()
    del doc["unknown"], doc["axis_evidence"]
    df = spark.read.schema(documents.KINDS["frontier"]).json(spark.sparkContext.parallelize([json.dumps(doc)])).drop("axis_evidence", "config_hash")
    row = documents.sealed(df, "frontier").withColumn("rule", documents.verified_by(F.col("text"), "frontier")).first()
    assert row["rule"] == 0 and json.loads(row["text"])["snapshot_id"] == row["snapshot_id"]
    again = documents.sealed(df.withColumn("order_by", F.lit("q")), "frontier").first()
    assert again["snapshot_id"] != row["snapshot_id"]
    members = [{"offering": {k: v for k, v in m["offering"].items() if v is not None}, "cost": m["axes"]["cost"]} for m in doc["members"]]
    assert members[0]["offering"] == {"offering_id": "a", "provider": "p"}


POLICY = """
metrics:
  cost: {unit: usd, signal: cost%s}
  quality: {unit: points, signal: quality}
  other: {unit: points, signal: other}
frontiers:
  f: {axes: [{metric: cost, goal: min}, {metric: quality, goal: max}]%s}
"""


def test_a_policy_is_known_by_what_its_frontier_uses():
    plain = policy.policy_hash(policy.load(POLICY % ("", "")), "f")
    assert plain == policy.policy_hash(policy.load(POLICY % (", requirements: {tiers: [measured]}", ", minimum: {}, regions: []")), "f")
    assert plain == policy.policy_hash(policy.load((POLICY % ("", "")).replace("signal: other", "signal: another")), "f")
    others = {policy.policy_hash(policy.load(POLICY % x), "f") for x in (("", ", minimum: {cost: 1}"), ("", ", uncertainty: robust"), (", requirements: {tiers: [proxy]}", ""), ("", ", minimum_gates: {other: 2}"))}
    assert len(others | {plain}) == 5
    with pytest.raises(policy.PolicyError):
        policy.policy_hash(policy.load(POLICY % ("", "")), "g")
