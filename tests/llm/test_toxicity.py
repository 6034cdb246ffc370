"""The automaton against edit distances, context against quotation, and held-out labels."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paretoflow.llm import toxicity
from tests.llm.conftest import SCHEMA, prose, rows

TERMS = {"idiot$": 5.0, "disgusting$": 4.0, "scum$": 3.0, "lower": 2.0, "low": 1.0, "loser$": 2.5}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(word):
    found = [(0, -TERMS[t], t) for t in TERMS if not t.endswith("$") and word.startswith(t)]
    found = [min(found, key=lambda x: -len(x[2]))] if found else []
    for t in TERMS:
        if t.endswith("$") and (e := distance(word, t[:-1])) <= toxicity.edits(t):
            found.append((e, -TERMS[t], t))
    return (min(found)[2], min(found)[0]) if found else None


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([t.rstrip("$") for t in TERMS]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("idotscumlgernw"), st.integers(0, 2)), max_size=3))
def test_the_automaton_finds_what_edit_distance_finds(word, changes):
    trie = toxicity.Trie(TERMS)
    for at, letter, kind in changes:
        word = word[:at] + letter * (kind > 0) + word[at + (kind < 2) :]
    assert trie.find(word) == nearest(word)


def test_the_automaton_starts_anew_when_it_grows(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 5)
    trie = toxicity.Trie(TERMS)
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choice("idotscumlgernw") for _ in range(r.randint(0, 11)))
        assert trie.find(word) == nearest(word)
    assert len(trie.reached) < 60


def test_context(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 6)  # forgets words in the middle of a text
    read = toxicity.Reader(TERMS)
    direct, quoted, misspelt, window, strongest, terms, addressed = range(7)
    plain = read.features("one two idiot three")
    assert plain[direct] > 0 and not plain[quoted] and not plain[addressed]
    assert read.features("you idiot")[addressed] > 0
    for text in ('she wrote "idiot" there', "the word idiot is old", "« idiot »", "they were called idiot by him"):
        f = read.features(text)
        assert f[quoted] > 0 and not f[direct], text
    assert read.features("IDIOT!!!")[direct] == plain[direct]
    assert read.features("idoit")[direct] == 0  # two edits
    assert read.features("idi0t or idiott")[misspelt] > 0
    far = " ".join(["idiot", *["x"] * 80, "idiot"])
    near = " ".join(["idiot", *["x"] * 10, "idiot"])
    assert read.features(near)[window] > read.features(far)[window] and read.features(near)[direct] == read.features(far)[direct]
    assert read.features("")[direct] == 0 and read.features("scums scu")[direct] == 0


def corpus(n, seed=7):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        w = prose(5000 + seed * n + k, r.randint(20, 120)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["grumbo", "fleeb" + r.choice("abcdefgh") * 2, "grumbo!"])
        docs.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_learnt_words_and_beginnings_hold_on_held_out_rows(spark):
    docs, labels = corpus(600)
    docs += [(1000 + k, docs[1][1] + f" {k}", "en", "s", 0) for k in range(50)]  # near copies count once
    labels += [(1000 + k, 1, 1) for k in range(50)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    model = toxicity.learn(df, spark.createDataFrame(labels + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int"))
    learnt = set(model.lexicon) - {w + "$" for w in toxicity.SEED}
    assert learnt == {"grumbo$", "fleeb"}
    said = dict((i, t) for i, _, t in labels)
    found = toxicity.score(df, model).select("row.doc_id", "score", "predicted", toxicity.held_out("row.doc_id").alias("held")).collect()
    held = [r for r in found if r["held"] and r["doc_id"] < 1000]
    assert len(held) > 80 and all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["predicted"] == said[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_odd_rows(spark, docs, none, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert set(model.lexicon) == {w + "$" for w in toxicity.SEED}
    found = toxicity.score(clashing, model)
    assert found.select("row.*").columns == clashing.columns
    assert found.count() == len(rows()) and found.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0


@pytest.mark.parametrize("size", [1_200_000])
def test_long_texts(size):
    read = toxicity.Reader(TERMS)
    text = " ".join(f"w{k}" for k in range(size // 8)) + " you idiot"
    assert read.features(text)[0] > 0 and len(read.known) <= toxicity.REMEMBERED
