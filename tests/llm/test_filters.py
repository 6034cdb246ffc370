"""Quality, near duplicates, paragraphs, repeats and mixing against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paretoflow.llm import hyperminhash, mixing, neardup, paragraphs, quality, repeats
from paretoflow.llm.components import components
from tests.llm.conftest import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(sets, percent):
    """Smallest index linked to each set, by comparing all pairs."""
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and label[j] < label[i] and 100 * len(a & b) >= percent * len(a | b):
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    data = sorted([r for r in rows() if r[0] is not None], key=lambda r: r[0])
    label = classes([shingles(r[1]) for r in data], percent)
    expected = Counter((r[0], len(shingles(r[1])), data[k][0], data[k][0] == r[0]) for r, k in zip(data, label))
    found = hyperminhash.duplicates(docs, percent).filter("doc_id IS NOT NULL").collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == expected


def test_near_duplicates_of_nulls_and_nothing(docs, none, clashing):
    found = hyperminhash.duplicates(docs).filter("doc_id IS NULL").collect()
    assert sorted(r["n_shingles"] for r in found) == [0, 46] and all(r["component_id"] is None and r["kept"] for r in found)
    assert hyperminhash.duplicates(none).count() == 0
    kept = hyperminhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r["doc_id"] for r in kept.collect())[4] == 1  # a repeated row is one document
    assert hyperminhash.keep_one(none).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    texts = [(1, prose(31, 50)), (2, prose(32, 50)), (2, prose(31, 50)), (None, prose(31, 50)), (None, prose(33, 50))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row_key", F.lit("own"))
    kept = hyperminhash.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([texts[0], texts[1], texts[4]])


def test_hot_group_of_near_copies(spark):
    """Many variants of one text: links are exact, no pair table is needed."""
    base = prose(20, 120).split()
    texts = []
    for k in range(150):
        w = list(base)
        for j in range(k % 4 * 2):
            w[(k * 37 + j * 11) % len(w)] = f"edit{k}x{j}"
        texts.append(" ".join(w))
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = classes([shingles(t) for t in texts], 85)
    found = {r["doc_id"]: r["component_id"] for r in hyperminhash.duplicates(data).collect()}
    assert [found[k] for k in range(150)] == label


@pytest.mark.parametrize("in_task", [neardup.IN_TASK, 16])
def test_a_node_of_a_hot_group_is_in_one_group(spark, monkeypatch, in_task):
    """Candidates are no more rows than nodes, whole buckets in a task or in blocks, and hold all links."""
    monkeypatch.setattr(neardup, "IN_TASK", in_task)
    monkeypatch.setattr(neardup, "BLOCK", in_task)
    base, texts = prose(21, 90).split(), []
    for k in range(160):
        w = list(base)
        for j in range(k % 5):
            w[(k * 29 + j * 23) % len(w)] = f"edit{k}x{j}"
        texts.append(" ".join(w))
    data = spark.createDataFrame([(k, t, k, k) for k, t in enumerate(texts)], "doc_id long, text string, k1 long, k2 long")
    nodes = paragraphs.sketches(data).select(F.col("doc_id").alias("node"), "n", "regs").localCheckpoint()
    found = neardup.stars(nodes, paragraphs.BANDS, 2 * paragraphs.ROWS, paragraphs.REGISTERS, paragraphs.estimate, "<u2", 80).collect()
    assert max(Counter(r["a"] for r in found).values()) == 1
    group = {r["b"]: r["b"] for r in found} | {r["a"]: r["b"] for r in found}
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(160) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(linked) > 1000 and all(group[i] == group[j] for i, j in linked)
    label = classes(sets, 85)
    kept = {r["doc_id"]: r["component_id"] for r in hyperminhash.duplicates(data.select("doc_id", "text")).collect()}
    assert [kept[k] for k in range(160)] == label


def test_estimate_is_close_and_corrected():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    owner = np.repeat([0, 1], [2000, 2000])
    _, _, _, low = neardup.sketch(np.concatenate([a, b]), owner, 2, hyperminhash.REGISTERS)
    regs = hyperminhash.compressed(low)
    got = hyperminhash.estimate(regs[:1], regs[1:], np.array([2000]), np.array([2000]))[0]
    assert abs(got - 0.6) < 0.15
    assert regs.dtype == np.uint16 and (regs >> 10).max() < 64


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=8), min_size=1, max_size=14), st.sampled_from([50, 80, 85]))
def test_forest_connects_just_the_linked(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    label = list(range(len(sets)))
    for a, b in neardup.forest(arrays, percent):
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    assert label == classes([frozenset(s) for s in sets], percent)


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (102, 101), (7, 7), (100, 101)] + [(200, k) for k in range(201, 240)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(21)} | {100: 100, 101: 100, 102: 100} | {k: 200 for k in range(200, 240)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_paragraphs(docs, none, clashing):
    data = sorted([r for r in rows() if r[0] is not None], key=lambda r: r[0])
    data = list(dict.fromkeys(data))
    items = [(r[0], k, shingles(line)) for r in data for k, line in enumerate((r[1] or "").split("\n")) if len(WORD.findall(line)) >= 30]
    label = classes([s for *_, s in items], 80)
    gone = defaultdict(list)
    for (doc, k, _), first in zip(items, label):
        if items[first][:2] != (doc, k):
            gone[doc].append(k)
    found = {r["row"]["doc_id"]: r for r in paragraphs.cut(docs).collect() if r["row"]["doc_id"] is not None}
    assert {k: list(r["removed"]) for k, r in found.items() if r["removed"]} == dict(gone)
    assert gone[12] == [0] and found[6]["row"]["text"] is None
    for doc, text, *_ in data:
        if text is not None:
            assert found[doc]["row"]["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[doc])
    assert paragraphs.cut(none).count() == 0
    assert paragraphs.cut(clashing).select("row.*").columns == clashing.columns


def test_passages_over_lines_and_inside_lines(spark):
    """A 60-word passage over short lines, in the middle of a long line, and twice in one document."""
    p = prose(50, 60).split()
    wrapped = "\n".join(" ".join(p[k : k + 12]) for k in range(0, 60, 12))
    a, b, c, d = (prose(k, 70) for k in range(51, 55))
    texts = {
        1: f"{a} {' '.join(p)} {b}", 2: f"x y\n{wrapped}\nz", 3: f"{c} {' '.join(p).upper()} {d}", 4: "ab " * 300,
        5: "\n".join([prose(55, 60), "in  between", prose(56, 40) + " " + prose(55, 60)]), 6: f"{prose(57, 200)}\n{' '.join(p[:29])} end",
        7: wrapped,
    }
    df = spark.createDataFrame([*texts.items(), (None, f"{wrapped} of none")], "doc_id long, text string").repartition(2)
    found = {r["row"]["doc_id"]: (r["row"]["text"], list(r["removed"]), r["n_words_cut"]) for r in paragraphs.cut(df).collect()}
    assert found == {
        1: (texts[1], [], 0), 2: ("x y\nz", [], 60), 3: (f"{c} {d}", [], 60), 4: (texts[4], [], 0),
        5: ("\n".join([prose(55, 60), "in  between", prose(56, 40)]), [], 60), 6: (texts[6], [], 0), 7: ("", [0, 1, 2, 3, 4], 0),
        None: ("", [0, 1, 2, 3, 4], 0),
    }


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=40), min_size=1, max_size=4), st.integers(1, 9))
def test_equal_windows_have_equal_marks(texts, width):
    owner, place, whole, mark, grams = paragraphs._windows([" ".join(f"w{x}" for x in t) for t in texts], width)
    assert list(zip(owner, place)) == [(k, j) for k, t in enumerate(texts) for j in range(len(t) - width + 1)]
    shown = {}
    for k, j, w, m in zip(owner, place, whole, mark):
        assert shown.setdefault(tuple(texts[k][j : j + width]), (w, m)) == (w, m)
    assert len({w for w, _ in shown.values()}) == len(shown)


@pytest.mark.parametrize("length", [400, 90])
def test_repeats(docs, none, length):
    raws = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen = Counter(b[i : i + length] for _, b in raws for i in range(len(b) - length + 1))
    expected = Counter()
    for doc, b in raws:
        mark = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i + 1 : i + 1 + length] = True
        kept = bytes(c for c, m in zip(b, mark[1:-1]) if not m)
        expected[(doc, len(b), int(mark.sum()), int((np.diff(mark.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))] += 1
    assert Counter(map(tuple, repeats.repeat_digests(docs, length).collect())) == expected
    assert repeats.repeat_digests(none, length).count() == 0
    whole = {r["doc_id"]: r for r in repeats.cut_repeats(docs, length).collect()}
    assert hashlib.sha256(bytes(whole[14]["kept"])).hexdigest() in {k[4] for k in expected if k[0] == 14}


def test_values_with_equal_leading_bits_stay_apart():
    """What decides on a removal has 96 bits: equal first 64 are not enough."""
    rng = np.random.default_rng(4)
    values = np.empty(400, repeats.WIDE)
    values["a"], values["b"] = rng.integers(0, 20, 400), rng.integers(0, 30, 400)
    pairs = [tuple(v) for v in values.tolist()]
    layout = repeats.Layout(400, 3)
    distinct, twice, bounds = layout.deal([values[:150], values[150:]])
    assert [tuple(v) for v in distinct.tolist()] == sorted(set(pairs)) and bounds[-1] == len(distinct)
    assert twice.tolist() == [pairs.count(p) > 1 for p in sorted(set(pairs))]
    assert (repeats._unpack(repeats._pack(distinct), True) == distinct).all()
    some = distinct[::3]
    assert repeats._within(values, some).tolist() == [p in set(map(tuple, some.tolist())) for p in pairs]


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_difference_cover(q):
    v, d = repeats.difference_cover(q)
    assert v == q * q + q + 1 and len(d) == q + 1
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_repeats_over_many_chunks(docs, monkeypatch):
    whole = Counter(map(tuple, repeats.repeat_digests(docs).collect()))
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 9000)
    assert Counter(map(tuple, repeats.repeat_digests(docs).collect())) == whole


def brute_quality(text):
    w = WORD.findall(text or "")
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside))
    return (*counts, len(w) < 10 or 100 * len(inside) > 20 * len(w))


def test_quality_base_rules(docs, none, clashing):
    model = quality.fit([], [])
    found = quality.judge(docs, model).select("row.doc_id", "row.text", "quality.*").collect()
    for r in found:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_quality(r["text"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(none, model).count() == 0
    assert quality.judge(clashing, model).select("row.*").columns == clashing.columns


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t#|é", max_size=60))
def test_quality_counts(text):
    assert quality.measure(text)[0] == brute_quality(text)[:5]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    weights, moves = rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2))
    docs = [rng.normal(size=(n, len(quality.FEATURES))) for n in (0, 1, 2, 5, 7)]
    for x, states in zip(docs, quality.viterbi(docs, weights, moves)):
        score = lambda y: sum((x[t] @ weights) * y[t] for t in range(len(y))) + sum(moves[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        every = [[k >> t & 1 for t in range(len(x))] for k in range(1 << len(x))]
        assert score(list(states)) == pytest.approx(max(map(score, every)))


def test_quality_learns_labels(spark):
    """Held-out accuracy of the fitted chain on its own kind of documents."""
    good = [prose(100 + k, 60).replace(" ", "\n", k % 5) + "." for k in range(60)]
    poor = [" ".join(w + "$$$ ###" for w in prose(300 + k, 60).split()) for k in range(60)]
    data = [(k, t, int(k < 60)) for k, t in enumerate(good + poor)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in data if k % 2] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_on_labels(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, model).select("row.doc_id", "quality.kept").collect()}
    held = [(kept[k], bool(y)) for k, _, y in data if k % 2 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_mixing_targets_and_budgets(docs, none, clashing):
    found = mixing.counted(rows_ := mixing.measured(docs), mixing.plan(rows_)).collect()
    size = Counter()
    for r in found:
        size[r["source"]] += r["size"]
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(total), set(names)
    while True:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 3 * size[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s in names:
        assert taken[s] <= target[s] + 1e-6
    again = mixing.counted(rows_, mixing.plan(rows_)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0] >= sum(taken.values())
    assert SCHEMA.count(",") == 4
