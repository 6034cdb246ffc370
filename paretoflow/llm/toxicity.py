"""Toxicity by a lexicon trie met with Levenshtein automata, and context windows around its hits.

The lexicon is learnt from labels: of a bounded sample of labelled documents (``SAMPLE`` of them,
those whose ids hash lowest, of copies and near copies one), Spark counts in how many toxic and other
documents each word, and each beginning of a word, occurs. Words and beginnings that tell toxic
documents apart by more than chance leaves over among all candidates become terms; of related ones the
most telling stays. A term that is a beginning matches every word that starts so. ``SEED`` words are
terms as well.

Terms stand in a trie. A word is read by the automaton of all (trie node, edits) pairs that it can have
reached, so one pass meets every term within its edits: none below 5 letters, 1 up to 8, 2 from 9
on, none for beginnings. The automaton is built state by state as words ask for it; nearly all words leave it
within a few letters. Each task remembers the words it has met.

A hit's weight is its term's log odds. Words around a hit tell quotation (quotation marks, reporting
verbs, talk about words) from abuse (addressing someone); quoted hits, misspelt hits and direct hits are
added up apart, and the strongest window of ``WINDOW`` words counts of itself. A logistic model over
these sums, fitted on the sample and held near sensible weights, gives the score. Lexicon and weights
are all that reaches the driver; every whole text is scored.

Defined cases: a null, empty or blank text has no hits and the score of such texts; a null doc_id counts as
an empty string and is held out; null labels are not used, of several labels of a document the greatest is;
without labels of both kinds the seed words and the weights before fitting decide; repeated rows get
equal scores; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import materialize, settings, text_or_empty

#: Labelled documents to learn from, terms learnt, and the longest beginning of a word.
SAMPLE, TERMS, LONGEST = 20_000, 300, 16
#: A learnt term: letters, toxic documents that hold it, and times as frequent in them as elsewhere.
LEAST_LETTERS, LEAST_DOCS, LEAST_LIFT = 3, 4, 3.0
#: Words to each side that are a hit's context, and those of a window that sums up hits.
CONTEXT, WINDOW = 6, 50
REMEMBERED, STATES = 400_000, 100_000
END = "$"
# Words of abuse that need no label, with a weight of ``SEED_WEIGHT`` until counts say otherwise.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "imbecile", "cretin", "pathetic", "worthless", "disgusting")
SEED_WEIGHT = 2.0
# Signs of quotation, and of someone addressed.
QUOTES = "\"'“”„«»‹›‘’`"
REPORTING = frozenset(
    "said says say wrote writes called calls quote quoted quotes word words term terms slur insult insults reported reports "
    "dit disait écrit mot mots insulte sagte sagt schrieb wort wörter beleidigung dijo dice escribió palabra palabras insulto".split()
)
ADDRESS = frozenset("you your you're youre u ur yourself du dein deine dich ihr tu toi vous votre tú usted eres es-tu".split())
#: Weights before fitting: bias, then the features of :func:`features`.
PRIOR = np.array([-3.5, 1.0, 0.3, 0.8, 0.5, 1.0, 0.5, 0.5])
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def edits(term: str) -> int:
    """Edits that a term may be away; beginnings of words none."""
    n = len(term) - 1
    return 0 if not term.endswith(END) or n < 5 else 1 if n < 9 else 2


class Trie:
    """Terms by letters, and the automaton that reads words against all of them."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.children: list[dict[str, int]] = [{}]
        self.most: list[int] = [-1]  # edits of the terms below
        self.closed: dict[int, str] = {}
        self.open: dict[int, str] = {}
        for term in sorted(weights):
            closed, allowed = term.endswith(END), edits(term)
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in term.rstrip(END):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(-1)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            (self.closed if closed else self.open)[node] = term
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.reached: list[tuple[tuple[tuple[int, int], ...], tuple[int, str] | None]] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0}, None)

    def _state(self, reached: dict[int, int], beginning: tuple[int, str] | None) -> int:
        """The number of a state, after letters of terms that a word may lack."""
        todo = list(reached)
        for node in todo:
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        key = (tuple(sorted(reached.items())), beginning)
        if key not in self.states:
            self.states[key] = len(self.reached)
            self.reached.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        now, beginning = self.reached[state]
        then: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < then.get(node, 99):
                then[node] = e

        for node, e in now:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        for node, e in then.items():
            term = self.open.get(node)
            if term is not None and e == 0 and (beginning is None or len(term) > len(beginning[1])):
                beginning = (0, term)
        return self._state(then, beginning)

    def find(self, word: str) -> tuple[str, int] | None:
        """The term that a word stands for and its edits: the fewest edits, then the weightiest term."""
        if len(self.reached) > STATES:
            self._reset()
        state = self.start
        for c in word:
            step = self.steps[state]
            after = step.get(c)
            if after is None:
                after = step[c] = self._step(state, c)
            state = after
            if not self.reached[state][0]:
                break
        now, beginning = self.reached[state]
        found = [beginning] if beginning else []
        if now:
            found += [(e, t) for node, e in now if (t := self.closed.get(node)) is not None and e <= edits(t)]
        if not found:
            return None
        e, term = min(found, key=lambda x: (x[0], -self.weights[x[1]], x[1]))
        return term, e


def plain(word: str) -> str:
    """A word's lower-case form without what surrounds its first and last letter."""
    word = word.lower()
    if not word.isalpha():
        a, b = 0, len(word)
        while a < b and not word[a].isalpha():
            a += 1
        while b > a and not word[b - 1].isalpha():
            b -= 1
        word = word[a:b]
    return word


class Reader:
    """Hits of texts; what it has learnt of words stays for the next text."""

    def __init__(self, weights: dict[str, float]):
        self.trie = Trie(weights)
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.hits.clear()
        for word in words:
            hit = self.trie.find(plain(word))
            if hit is not None:
                self.hits[word] = hit
        self.known |= words

    def features(self, text: str) -> list[float]:
        """Sums of direct, quoted and misspelt hits, the strongest window, the strongest term, distinct terms, and addressed hits."""
        words = text.split()
        new = set(words)
        new -= self.known
        if new:
            new = new | set(words) if len(self.known) + len(new) > REMEMBERED else new
            self._learn(new)
        hits = self.hits
        at = [k for k, w in enumerate(words) if w in hits] if hits else []
        if not at:
            return [0.0] * (len(PRIOR) - 1)
        direct = quoted = misspelt = addressed = window = best = strongest = 0.0
        terms, inside = set(), []
        for k in at:
            term, e = hits[words[k]]
            weight = self.trie.weights[term] / (1 + e)
            around = words[max(0, k - CONTEXT) : k] + words[k + 1 : k + 1 + CONTEXT]
            marked = words[k][:1] in QUOTES or words[k].rstrip(".,;:!?")[-1:] in QUOTES
            if not marked:
                marked = any(w[:1] in QUOTES for w in around[:CONTEXT]) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in around[-CONTEXT:])
            bare = [w.strip(".,;:!?").lower() for w in around]
            aimed = any(w in ADDRESS for w in bare)
            if marked or (not aimed and any(w in REPORTING for w in bare)):
                quoted += weight
                continue
            if e:
                misspelt += weight
            else:
                direct += weight
                strongest = max(strongest, weight)
            addressed += aimed
            terms.add(term)
            inside.append((k, weight))
            window += weight
            while inside[0][0] <= k - WINDOW:
                window -= inside.pop(0)[1]
            best = max(best, window)
        sums = [math.log1p(max(x, 0.0)) for x in (direct, quoted, misspelt, best, len(terms), addressed)]
        return [*sums[:4], strongest / 4, *sums[4:]]


_READER: dict[int, tuple[dict[str, float], Reader]] = {}


def reader(weights: dict[str, float]) -> Reader:
    """This process's reader of a lexicon; the tasks it runs one after another share it."""
    key = hash(frozenset(weights.items()))
    kept = _READER.get(key)
    if kept is None or kept[0] != weights:
        _READER.clear()
        _READER[key] = kept = (weights, Reader(weights))
    return kept[1]


def _ratio(a: Column, b: Column, toxic: int, other: int) -> Column:
    """Twice the log-likelihood ratio of a term's documents by label."""

    def part(k: Column, n: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)

    both = (a + b) / (toxic + other)
    return 2 * (part(a, toxic, a / toxic) + part(b, other, b / other) - part(a, toxic, both) - part(b, other, both))


@F.pandas_udf(T.LongType())
def _sketch(texts: pd.Series) -> pd.Series:
    """The least hash of a text's windows of five words: near copies mostly share it."""
    found = (hashing.windows(hashing.words(t.encode("utf-8", "surrogatepass"))) for t in texts)
    return pd.Series([int(x.min().view(np.int64)) if len(x) else 0 for x in found])


def lexicon(sample: DataFrame, toxic: int, other: int) -> dict[str, float]:
    """Terms and their log odds, from the labelled ``sample`` of columns ``text`` and ``toxic``."""
    weights = {w + END: SEED_WEIGHT for w in SEED}
    if not toxic or not other:
        return weights

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for text, label in zip(b["text"], b["toxic"]):
                words = set(_LETTERS.findall(text.lower()))
                keys = {w[:k] for w in words for k in range(LEAST_LETTERS, min(len(w), LONGEST) + 1)}
                keys |= {w + END for w in words if LEAST_LETTERS <= len(w) <= 2 * LONGEST}
                for key in keys:
                    found.setdefault(key, [0, 0])[label] += 1
            yield pd.DataFrame({"term": list(found), "b": [v[0] for v in found.values()], "a": [v[1] for v in found.values()]})

    counts = sample.mapInPandas(counted, "term string, b long, a long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    seen = Observation()
    counts = materialize(counts.observe(seen, F.count("*").alias("n")).filter(f"a >= {LEAST_DOCS}"), "toxicity-terms")
    # Chance leaves about one candidate in all above this ratio.
    least = 2 * math.log(max(2, seen.get["n"]))
    a, b = F.col("a"), F.col("b")
    ratio, lift = _ratio(a, b, toxic, other), (a / toxic) / ((b + 0.5) / other)
    telling = (
        counts.withColumn("ratio", ratio).filter((F.col("ratio") > least) & (lift > LEAST_LIFT))
        .orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(20 * TERMS).collect()
    )
    taken: list[str] = []
    for r in telling:
        bare = r["term"].rstrip(END)
        if len(taken) < TERMS and not any(bare.startswith(t.rstrip(END)) or t.startswith(bare) for t in taken):
            taken.append(r["term"])
            weights[r["term"]] = math.log((r["a"] + 0.5) / (toxic + 1)) - math.log((r["b"] + 0.5) / (other + 1))
    return weights


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps, held near ``PRIOR``; hits never speak against toxicity."""
    w = PRIOR.copy()
    if len(set(y.tolist())) < 2:
        return w
    x = np.hstack([np.ones((len(x), 1)), x])
    hold = np.full(len(w), l2)
    hold[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - hold * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        w = w + move
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out."""
    spark = docs.sparkSession
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    )
    # At most ``sample`` rows: a bound on what is broadcast.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}):
        rows = materialize(texts.select("text", "toxic"), "toxicity-sample")
        once = materialize(rows.groupBy(_sketch("text").alias("sketch")).agg(F.min(F.struct("text", "toxic")).alias("r")).select("r.*"), "toxicity-once")
        said = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
        terms = lexicon(once, said.get(1, 0), said.get(0, 0))

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = reader(terms)
            for b in batches:
                yield pd.DataFrame({"x": [own.features(t) for t in b["text"]], "toxic": b["toxic"]})

        def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = [b for b in batches if len(b)]
            x = np.array([v for b in found for v in b["x"]], float).reshape(-1, len(PRIOR) - 1)
            y = np.array([v for b in found for v in b["toxic"]], float)
            order = np.lexsort([y, *x.T])
            yield pd.DataFrame({"w": [fit(x[order], y[order]).tolist()]})

        # A few numbers for each document of the sample, fitted in one task.
        features = rows.mapInPandas(measured, "x array<double>, toxic int")
        got = features.coalesce(1).mapInPandas(fitted, "w array<double>").collect() if said else []
    return Model(terms, np.array(got[0]["w"]) if got else PRIOR)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the document), ``score`` and ``predicted`` of every document."""
    terms, weights = model.lexicon, model.weights
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = reader(terms)
        x = np.array([own.features(t) for t in texts], float).reshape(-1, len(weights) - 1)
        return pd.Series(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))

    found = rows.select("row", scored("text").alias("score"))
    return found.select("row", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
