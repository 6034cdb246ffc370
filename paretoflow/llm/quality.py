"""Quality rules with line sequence labelling by a linear-chain conditional random field.

Each document is a sequence of lines that hold a word. Viterbi decoding of a two-state chain
marks every line as content or boilerplate; a document stays if no base rule rejects it and
lines marked content hold at least ``share`` of its words. The chain is fitted by maximum
likelihood on a bounded sample of labelled documents (``sample`` of them, those with the
smallest hash): lines of good documents are content, lines of poor ones boilerplate. Counts and
decisions cover all documents and whole texts.

Defined cases: a null, empty or blank text has no words and fails the base rules; a document
without lines has content share 0; null labels and labels of no document are not used; without
labels of both kinds the chain keeps its prior weights; repeated rows get equal verdicts; very
long documents are decoded whole; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty

SAMPLE = 2000
SHARE = 0.5
#: Lines of a training sequence, and of one document in fitting; for fitting only.
SEGMENT, SAMPLE_LINES = 64, 256
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
# Stems of licence and navigation lines.
NOTICES = (b"licens", b"rights reserved", b"copyright", b"cookie", b"subscribe", b"click here", b"terms of")
FEATURES = ("bias", "length", "symbols", "upper", "digits", "marks", "duplicate", "distinct", "word_length", "closed", "notice", "repeats")
#: Weights before fitting, of content less boilerplate.
PRIOR = np.array([1.0, 0.5, -8.0, -3.0, -2.0, -8.0, -2.0, 1.0, 0.0, 0.5, -2.0, -3.0])


def repeated(words: list[bytes], width: int = 5) -> np.ndarray:
    """Which words lie in a window of ``width`` words found twice or more."""
    n = len(words)
    marks = np.zeros(n + 1, np.int64)
    if n > width:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
        # Two independent 64-bit sums of multiplied ids name a window.
        keys = np.zeros((2, n - width + 1), np.uint64)
        for j, (a, b) in enumerate(zip((3, 5, 7, 11, 13), (17, 19, 23, 29, 31))):
            x = ids[j : n - width + 1 + j] + np.uint64(1)
            for row, m in enumerate((a, b)):
                y = (x + np.uint64(m << 40)) * np.uint64(0xBF58476D1CE4E5B9)
                keys[row] += (y ^ (y >> np.uint64(29))) * np.uint64(0x94D049BB133111EB + 2 * m)
        key = keys[0] ^ (keys[1] << np.uint64(21) | keys[1] >> np.uint64(43))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + width, -1)
    return np.cumsum(marks[:-1]) > 0


def measure(text: str) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """Base counts, features of each line with a word, and its number of words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    again = repeated(words)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    rows, sizes, seen, dup, at = [], [], set(), 0, 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        n = len(own)
        is_dup = line in seen
        dup += is_dup
        seen.add(line)
        size = sum(map(len, own))
        upper = size - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) + (len(line) - size)
        lower = line.lower()
        rows.append(
            (
                1.0,
                math.log1p(n) / 5,
                (len(line) - len(line.translate(None, SYMBOLS))) / size,
                upper / size,
                (len(line) - len(line.translate(None, b"0123456789"))) / size,
                line.count(b"!") / size,
                float(is_dup),
                len(set(own)) / n,
                min(size / n, 40) / 10,
                float(own[-1][-1:] in b".?!:;"),
                float(any(x in lower for x in NOTICES)),
                float(again[at : at + n].mean()),
            )
        )
        sizes.append(n)
        at += n
    counts = (len(words), len(text) - spaces, symbols, dup, int(again.sum()))
    return counts, np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


def viterbi(docs: list[np.ndarray], weights: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """The best states (1: content) of each document's lines; documents step together."""
    order = np.argsort([-len(x) for x in docs], kind="stable")
    scores = [docs[k] @ weights for k in order]
    lengths = np.array([len(x) for x in scores])
    longest = lengths.max(initial=0)
    back = [None] * longest
    best = np.zeros((len(docs), 2))
    for t in range(longest):
        live = int((lengths > t).sum())
        emit = np.zeros((live, 2))
        emit[:, 1] = [s[t] for s in scores[:live]]
        if t:
            reach = best[:live, :, None] + moves[None]
            back[t] = reach.argmax(1)
            best[:live] = reach.max(1) + emit
        else:
            best[:live] = emit
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
    for place, k in enumerate(order):
        n = lengths[place]
        states = np.zeros(n, np.int64)
        if n:
            states[-1] = best[place].argmax()
            for t in range(n - 1, 0, -1):
                states[t - 1] = back[t][place, states[t]]
        out[k] = states
    return out


def fit(docs: list[np.ndarray], labels: list[int], steps: int = 300, l2: float = 0.02, still: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores by gradient ascent on the mean log-likelihood, until no weight moves by ``still``."""
    weights, moves = PRIOR.copy(), np.array([[1.0, -1.0], [-1.0, 1.0]])
    if len(set(labels)) < 2:
        return weights, moves
    parts = [(x[s : s + SEGMENT], y) for x, y in zip(docs, labels) for s in range(0, len(x), SEGMENT)]
    parts.sort(key=lambda p: -len(p[0]))
    lengths, y = np.array([len(p) for p, _ in parts]), np.array([v for _, v in parts])
    # Lines are laid out by position: those at position t are one slice, of the longest parts.
    live = [int((lengths > t).sum()) for t in range(lengths[0])]
    at = np.concatenate([[0], np.cumsum(live)])
    x = np.concatenate([np.array([p[t] for p, _ in parts[:m]]) for t, m in enumerate(live)])
    # Kinds weigh alike, however many documents each has.
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / lengths
    line_share = np.concatenate([share[:m] for m in live])
    content = np.concatenate([y[:m] == 1 for m in live])
    seen_moves = np.diag([(share * (lengths - 1))[y == v].sum() for v in (0, 1)])
    theta = np.concatenate([weights, moves.ravel()])
    origin, m1, m2 = theta.copy(), np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        # Forward and backward sums, scaled to 1 at each position.
        step_by = np.exp(np.clip(theta[len(FEATURES) :], -30, 30)).reshape(2, 2)
        emit = np.ones((len(x), 2))
        emit[:, 1] = np.exp(np.clip(x @ theta[: len(FEATURES)], -50, 50))
        alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty(len(x))
        for t, m in enumerate(live):
            now = emit[at[t] : at[t + 1]] * (alpha[at[t - 1] : at[t - 1] + m] @ step_by if t else 1.0)
            scale[at[t] : at[t + 1]] = now.sum(1)
            alpha[at[t] : at[t + 1]] = now / now.sum(1, keepdims=True)
        pair = np.zeros((2, 2))
        for t in range(len(live) - 2, -1, -1):
            m = live[t + 1]
            ahead = emit[at[t + 1] : at[t + 2]] * beta[at[t + 1] : at[t + 2]] / scale[at[t + 1] : at[t + 2], None]
            beta[at[t] : at[t] + m] = ahead @ step_by.T
            pair += step_by * ((alpha[at[t] : at[t] + m] * share[:m, None]).T @ ahead)
        p1 = alpha[:, 1] * beta[:, 1] / (alpha * beta).sum(1)
        g = np.concatenate([((content - p1) * line_share) @ x, (seen_moves - pair).ravel()]) - l2 / 100 * (theta - origin)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        theta = theta + move
        if np.abs(move).max() < still:
            break
    return theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(2, 2)


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the ``sample`` labelled documents whose ids hash lowest, in one task; only the weights reach the driver.

    Of a longer document's lines, runs of ``SEGMENT`` at even distances are used, ``lines`` in all.
    """
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .dropna()
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality")
        .limit(sample)
    )
    # At most ``sample`` rows: a bound on what is broadcast.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    arrow_rows(docs.sparkSession)

    def spread(x: np.ndarray) -> np.ndarray:
        if len(x) <= lines:
            return x
        starts = np.linspace(0, len(x) - SEGMENT, max(1, lines // SEGMENT)).astype(int)
        return np.concatenate([x[s : s + SEGMENT] for s in starts])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [spread(measure(t)[1]) for t in b["text"]]
            yield b[["doc_id", "quality"]].assign(x=[v.astype("<f8").tobytes() for v in x])

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["x"], b["quality"])]
        pairs = [(np.frombuffer(x, "<f8").reshape(-1, len(FEATURES)), y) for x, y in rows if len(x) and y in (0, 1)]
        weights, moves = fit([x for x, _ in pairs], [y for _, y in pairs])
        yield pd.DataFrame({"theta": [np.concatenate([weights, moves.ravel()])]})

    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.mapInPandas(features, f"doc_id {kind}, quality int, x binary").orderBy("doc_id", "x").limit(sample)
    found = rows.coalesce(1).mapInPandas(fitted, "theta array<double>").collect()
    if not found:  # no labelled document at all
        return fit([], [])
    theta = np.array(found[0]["theta"])
    return theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(2, 2)


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = SHARE) -> DataFrame:
    """The documents with a struct ``quality``: base counts, line_labels, content_share, verdicts."""
    weights, moves = model
    arrow_rows(docs.sparkSession)
    # The rows travel as one struct, so no name of theirs can clash with what is added.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))

    @F.pandas_udf(f"struct<{BASE.replace(' long', ':long')},line_labels:binary,content_share:double>")
    def labelled(texts: pd.Series) -> pd.DataFrame:
        found = [measure(t) for t in texts]
        states = viterbi([x for _, x, _ in found], weights, moves)
        out = pd.DataFrame([c for c, _, _ in found], columns=[x.split()[0] for x in BASE.split(", ")])
        out["line_labels"] = [s.astype(np.uint8).tobytes() for s in states]
        out["content_share"] = [float(n[s == 1].sum() / n.sum()) if len(n) else 0.0 for s, (_, _, n) in zip(states, found)]
        return out

    q = rows.select("row", labelled("text").alias("q"))
    failed = (F.col("q.n_words") < 10) | (100 * F.col("q.n_repeat_words") > 20 * F.col("q.n_words"))
    kept = ~failed & (F.col("q.content_share") >= share)
    return q.select("row", F.struct("q.*", failed.alias("base_failed"), kept.alias("kept")).alias("quality"))
