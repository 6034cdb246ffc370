"""Formulas, exact numbers and texts."""

import hashlib
import hmac
import random
from decimal import Context, Decimal, localcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paretoflow.functions import formula, numeric, text


def value(spark, expression, **paths):
    lookup = lambda p: F.lit(paths.get(p.split(".")[1]))
    found = spark.range(1).select(formula.exact(expression, lookup).alias("v")).first()["v"]
    return None if found is None else float(found)


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("(1500000*0.10 + 200000*1.25)/1000000", 0.40), ("2^3^2", 512), ("-2^2", -4), ("7 % 4", 3), ("-7 % 4", -3), ("1 / 0", None),
        ("min(3, 1, 2)", 1), ("max(3, 1, 2)", 3), ("mean(1, 2, 6)", 3), ("clamp(9, 1, 5)", 5), ("clamp(9, 5, 1)", None),
        ("sqrt(-1)", None), ("sqrt(9)", 3), ("log(exp(2))", 2), ("floor(-1.5)", -2), ("ceil(-1.5)", -1), ("round(2.5)", 2),
        ("round(3.5)", 4), ("round(0.125, 2)", 0.12), ("abs(-3)", 3), ("if(1 < 2, 3, 4)", 3), ("coalesce(signals.gone, 5)", 5),
        ("max(1, signals.gone)", None), ("1 + signals.gone", None), ("if(signals.gone > 1, 1, 2)", None), ("10 - 2 - 3", 5),
        ("0^-1", None), ("0^0", None), ("1e308*10", 1e309), ("1e1000*10", None), ("exp(2301)", None), ("log(0)", None), ("5 / log(0)", None), ("round(signals.gone)", None), ("coalesce(signals.gone + 1, 5)", None), ("coalesce(if(1 < 2, signals.gone, 1), 5)", 5), ("round(1.25, 3 - 2)", 1.2), ("10^34 % 3", 1), ("10^40 % 3", None), ("round(10^33 + 0.5, 2)", None), ("round(1e30)", 1e30), ("2^signals.gone", None), ("2^0.5", None), ("0.1+0.2", 0.3),
        ("if(0.1 + 0.2 == 0.3, 1, 2)", 1), ("1e999 * 10 - 1e999 * 10", 0), ("floor(1e30)", 1e30), ("007 + 1", 8), ("round(1234.5, -2)", 1200), ("round(1e-20, 25)", 1e-20),
    ],
)
def test_formula_values(spark, expression, expected):
    got = value(spark, expression)
    assert got is None if expected is None else got == pytest.approx(expected)
    assert expression != "0.1+0.2" or got == 0.3


@pytest.mark.parametrize("bad", ["", "1 +", "f(1)", "import os", "signals", "other.x", "1 2", "(1", "if(1, 2, 3)", "2 ** 3", "1 if 2 else 3", "signals.x[0]", "1_0", "0x1", "1 < 2", "if(1 < 2 < 3, 1, 2)", "__import__(1)", "a" * 5000, "(" * 200 + "1" + ")" * 200, "round(1, 0.5)", "round(1, 1001)", "min()"])
def test_formulas_that_are_refused(spark, bad):
    with pytest.raises(formula.FormulaError):
        value(spark, bad)


def test_paths(spark):
    text_ = "coalesce(signals.a, signals.b) + if(signals.c > 1, workload.d, metadata.e.f)"
    assert formula.parse(text_).paths() == {"signals.a", "signals.b", "signals.c", "workload.d", "metadata.e.f"}
    rows = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (2, None, 2.0, 0.0), (3, None, None, 5.0)], "k int, a double, b double, c double")
    lookup = {"signals.a": F.col("a"), "signals.b": F.col("b"), "signals.c": F.col("c"), "workload.d": F.lit(1), "metadata.e.f": F.lit("2.50")}
    found = {r["k"]: (r["x"]["value"], r["x"]["used"]) for r in rows.select("k", formula.exact_with_paths(text_, lookup.__getitem__).alias("x")).collect()}
    assert found == {
        1: ("2", ["signals.a", "signals.c", "workload.d"]), 2: ("4.5", ["metadata.e.f", "signals.a", "signals.b", "signals.c"]),
        3: (None, ["signals.a", "signals.b", "signals.c", "workload.d"]),
    }


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.decimals(-(10**9), 10**9, places=4))] * 3), min_size=1, max_size=6))
def test_batches_give_what_single_rows_give(rows):
    """Every node once for a batch, lazy branches for the rows that take them: the same as row by row in plain decimals."""
    names = ["signals.a", "signals.b", "signals.c"]
    text_ = "if(coalesce(signals.a, 1) > signals.b, signals.a / signals.b + signals.c ^ 2, coalesce(signals.c, mean(signals.b, 2, 3)) % 7)"
    found = formula.evaluate(text_, {n: [r[k] for r in rows] for k, n in enumerate(names)}, len(rows))
    for (a, b, c), (got, used) in zip(rows, found):
        with localcontext(Context(prec=34)):
            try:
                want = a / b + c**2 if (Decimal(1) if a is None else a) > b else (c if c is not None else (b + 2 + 3) / 3) % 7
            except (TypeError, ArithmeticError):
                want = None
        assert (got is None) == (want is None) and (want is None or Decimal(got) == want)
        assert names[0] in used and names[1] in used


def test_exact_numbers_stay_exact(spark):
    rows = spark.createDataFrame([(9007199254740993, "0.1", Decimal("0.2")), (None, "x", None), (1, "1e999", Decimal(1))], "n bigint, t string, d decimal(20,10)")
    lookup = {"signals.n": F.col("n"), "signals.t": F.col("t"), "signals.d": F.col("d")}
    f = lambda t: formula.exact(t, lookup.__getitem__)
    found = [tuple(r) for r in rows.select(f("signals.n + 0"), f("signals.t + signals.d"), f("signals.n / 3"), f("1 / 3")).collect()]
    third = "0." + "3" * 34
    assert found[0] == ("9007199254740993", "0.3", "3002399751580331", third)
    assert found[1] == (None, None, None, third) and found[2][:1] == ("1",) and found[2][2:] == (third, third)


def test_doubles_in_catalyst(spark):
    f = lambda t: spark.range(1).select(formula.approximate(t, lambda p: F.lit(2.0))).first()[0]
    assert f("signals.x * 3 + sqrt(9) - 7 % 4") == 6 and f("1 / 0") is None and f("1e308 * 10") is None and f("round(2.5)") == 2
    with pytest.raises(formula.FormulaError):
        f("round(2.5, signals.x)")


def test_complete_sums_and_quantiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("b", 3), ("a", 10), ("a", 4)], "g string, x int")
    sums = {r["g"]: (r["s"], r["m"]) for r in df.groupBy("g").agg(numeric.sum_complete("x").alias("s"), numeric.mean_complete("x").alias("m")).collect()}
    assert sums == {"a": (17, 4.25), "b": (None, None)}
    q = {r["g"]: (float(r["p50"]), float(r["p95"]), r["samples"]) for r in numeric.quantile_type7(df, ["g"], "x", {"p50": "0.5", "p95": "0.95"}).collect()}
    assert q == {"a": (3.0, pytest.approx(9.1), 4), "b": (3.0, 3.0, 1)}


def test_quantiles_of_groups_that_lie_in_many_ranges(spark):
    """One hot group, ties, a null group, negative values, single rows: the same as sorting each group."""
    r = random.Random(9)
    rows = [("hot", Decimal(r.randint(-5000, 5000)) / 8) for _ in range(3000)] + [(None, Decimal(k % 3)) for k in range(50)]
    rows += [(f"g{k % 17}", Decimal(r.randint(0, 20))) for k in range(120)] + [("one", Decimal(7)), ("none", None), ("tied", Decimal(1)), ("tied", Decimal(1))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    names = {"least": "0", "p05": "0.05", "p50": "0.5", "p95": "0.95", "most": "1"}
    try:
        found = numeric.quantile_type7(spark.createDataFrame(rows, "g string, x decimal(18,4)").repartition(5), ["g"], "x", names).collect()
        whole = numeric.quantile_type7(spark.createDataFrame(rows, "g string, x decimal(18,4)"), [], "x", {"p50": "0.5"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def type7(xs, p):
        at = Decimal(p) * (len(xs) - 1)
        low = int(at)
        return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)

    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert {q["g"] for q in found} == set(groups)
    for q in found:
        xs = sorted(groups[q["g"]])
        assert q["samples"] == len(xs)
        for name, p in names.items():
            assert q[name] == pytest.approx(type7(xs, p), abs=Decimal("1e-8")), (q["g"], name)
    every = sorted(x for _, x in rows if x is not None)
    assert [q["p50"] for q in whole] == [type7(every, "0.5")] and whole[0]["samples"] == len(every)


def test_intervals_and_recovery(spark):
    row = spark.range(1).select(*numeric.wilson(F.lit(8), F.lit(10)), *numeric.wilson(F.lit(0), F.lit(10)), *numeric.wilson(F.lit(10), F.lit(10))).first()
    assert row[0] == pytest.approx(49.0162, abs=1e-3) and row[1] == pytest.approx(94.3318, abs=1e-3) and row[2] == 0 and row[5] == 100
    rates = spark.createDataFrame([("0.3333", 3), ("0.5000", 10), ("0.1234", 7)], "r string, n int")
    got = rates.select(numeric.recover_successes(F.col("r").cast("decimal(18,4)"), F.col("n")).alias("k")).collect()
    assert [r["k"] for r in got] == [1, 5, None]


def test_medians_softmax_brier_close(spark):
    row = spark.range(1).select(
        numeric.median_clamped(F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0)))), numeric.softmax(F.array(F.lit(0.0), F.lit(0.0))),
        numeric.brier(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))), numeric.close(F.lit(1.0), F.lit(1.0 + 1e-10)),
        numeric.close(F.lit(1.0), F.lit(1.1)),
        numeric.age_hours(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 01:30:00").cast("timestamp")).cast("double"),
    ).first()
    assert tuple(row) == (2.5, [0.5, 0.5], 0.25, True, False, 1.5)


def test_texts(spark):
    rows = [("=1+1", "'=1+1"), (" @x", "' @x"), ("plain", "plain"), ("-", "'-"), (None, None), ("\t=cmd", "'\t=cmd"), ("\u00a0\n@x", "'\u00a0\n@x")]
    got = spark.createDataFrame(rows, "x string, y string").select(text.spreadsheet_safe(F.col("x")).alias("c"), "y").collect()
    assert all(r["c"] == r["y"] for r in got)
    urls = {"https://a.b/c": True, "http://a.b/": False, "https://u@a.b/": False, "https://a.b/?q": False, "https://a.b/#f": False}
    got = spark.createDataFrame(list(urls.items()), "u string, ok boolean").select(text.is_public_url(F.col("u")).alias("c"), "ok").collect()
    assert all(r["c"] == r["ok"] for r in got)
    paths = {"a/b.json": True, "../a": False, "/a": False, "a/./b": False, "a\\b": False, "a": True, "": False}
    got = spark.createDataFrame(list(paths.items()), "p string, ok boolean").select(text.is_safe_path(F.col("p")).alias("c"), "ok").collect()
    assert all(r["c"] == r["ok"] for r in got)
    one = spark.range(1).select(text.canonical_number(F.lit("1.500").cast("decimal(9,3)")), text.canonical_number(F.lit("100").cast("decimal(9,0)")), text.provider_of(F.lit("a/b")), text.provider_of(F.lit("b")), text.has_forbidden_text(F.lit("a\x07")), text.has_forbidden_text(F.lit("ok"))).first()
    assert tuple(one) == ("1.5", "100", "a", "unknown", True, False)
    marks = spark.createDataFrame([(c,) for c in "\u061c\u200e\u200f\u202e\u2066\ufffe\x7f"], "x string").select(text.has_forbidden_text(F.col("x")).alias("c")).collect()
    assert all(r["c"] for r in marks)
    pair = spark.createDataFrame([("a\x1fvb", "c"), ("a", "b\x1fvc"), ("a,1:b", None), ("a", "1:b")], "x string, y string").select(text.content_hash([F.col("x"), F.col("y")]).alias("h")).collect()
    assert len({r["h"] for r in pair}) == 4
    got = spark.range(1).select(text.opaque_id(F.lit("s"), b"k", "p-", "d")).first()[0]
    assert got == "p-" + hmac.new(b"k", b"d\0s", hashlib.sha256).hexdigest()


def test_decimal_texts_lose_no_digit(spark):
    r = random.Random(6)
    texts = ["1e-19", "1e20", "0." + "1234567890" * 10, "123456789012345678901234567890.5", "-0", "-0.00", "-1", "+1.50", ".5", "5.", "00012.3400", "0e5", "1e1024", "1e1026", "1e-1024", "1e-1025", "1e99999", "1e999999", "x", "", "1_0", "NaN", "Infinity", "true", " 7 ", "1" * 129, None]
    for _ in range(300):
        digits = "".join(r.choice("0123456789") for _ in range(r.randint(1, 40)))
        at = r.randint(0, len(digits))
        texts.append(r.choice(["", "-", "+"]) + digits[:at] + "." + digits[at:] + r.choice(["", f"e{r.randint(-60, 60)}", f"E+{r.randint(0, 9)}"]))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {x["k"]: (x["a"], x["b"]) for x in rows.select("k", text.decimal_text(F.col("t")).alias("a"), text.decimal_input(F.col("t")).alias("b")).collect()}

    def plain(t, most):
        try:
            d = None if t is None or len(t) > most or "_" in t else Decimal(t.strip())
        except ArithmeticError:
            return None
        if d is None or not d.is_finite():
            return None
        if d == 0:
            return "0"
        if abs(d.adjusted()) > 1024:
            return None
        shown = format(d, "f")
        shown = shown.rstrip("0").rstrip(".") if "." in shown else shown
        return None if len(shown.partition(".")[2]) > 1024 else shown

    for k, t in enumerate(texts):
        want = plain(t, 1024)
        assert found[k][1] == want, t
        assert found[k][0] == (plain(t, 128) if want is not None and not want.startswith("-") else None), t
