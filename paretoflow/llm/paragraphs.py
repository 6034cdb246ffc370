"""Substring deduplication: paragraph MinHash banding, then repeated passages word by word.

Paragraphs are a document's lines of at least ``min_words`` words, and runs of neighbouring
shorter lines that have as many together. Their sets of 5-word shingles are sketched by MinHash;
bands tuned for high recall (14 of 3 registers: a pair at similarity 0.8 is missed with
probability 5e-5) join colliding paragraphs; exact Jaccard of full sets, 0.8 or more, verifies
them; components cluster them. Of each component the first paragraph, by document id and place,
stays, and all others are cut from their documents.

What stays is searched for passages: every window of ``min_words`` words that stands in another
place as well, across lines and inside longer ones, loses its words everywhere but in the first
place. Each window has a mark, the least hash of its runs of half as many words. Equal windows
have equal marks, so only windows whose mark is repeated are written and grouped; no pairs are
formed and no repeat of ``min_words`` equal words is missed. A copy inside a longer line whose
words are changed more often than that is not found.

Defined cases: a null or empty text has no paragraphs and stays as it is; shorter repeats are
never cut; equal paragraphs and passages in one document are copies as well, but a passage that
runs into itself ('ab ab ab ...') is one place; letters A-Z count as a-z and all white space as
one; null ids come last; rows that repeat both id and text are one document and end alike; a
document may lose all its text and then has the text ''; an empty table gives an empty result;
further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, neardup
from .common import arrow_rows, materialize, release, text_or_empty

BANDS, ROWS = 14, 3
REGISTERS = BANDS * ROWS
WIDTH = 5
PERCENT = 80
MIN_WORDS = 30


def _cut(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all paragraphs of a batch, the paragraph of each, and the paragraphs' text, first and last line."""
    parts, owners, of_text, lines, ends = [], [], [], [], []
    for k, text in enumerate(texts):
        words, line = hashing.words_of_lines(text.encode("utf-8", "surrogatepass"))
        if len(words) < min_words:
            continue
        numbers, which, counts = np.unique(line, return_inverse=True, return_counts=True)
        # A long line is a unit, and so is a run of short lines up to a blank or long one.
        long_ = counts >= min_words
        new = np.ones(len(numbers), bool)
        new[1:] = long_[1:] | long_[:-1] | (np.diff(numbers) > 1)
        unit = np.cumsum(new) - 1
        chosen = np.bincount(unit, counts) >= min_words
        if not chosen.any():
            continue
        x = hashing.windows(words, WIDTH)
        index = np.where(chosen, np.cumsum(chosen) - 1 + len(lines), -1)
        # Windows that stay within one unit, of units that are paragraphs.
        of_word = unit[which]
        own = index[of_word[: len(x)]]
        keep = (of_word[: len(x)] == of_word[WIDTH - 1 :]) & (own >= 0)
        parts.append(x[keep])
        owners.append(own[keep])
        of_text += [k] * int(chosen.sum())
        lines += numbers[new][chosen].tolist()
        ends += numbers[np.append(new[1:], True)][chosen].tolist()
    none = np.zeros(0, np.int64)
    return (
        np.concatenate(parts) if parts else none.astype(np.uint64),
        np.concatenate(owners) if owners else none,
        np.array(of_text, np.int64),
        np.array(lines, np.int64),
        np.array(ends, np.int64),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the keys k1 and k2 that name an (id, text) pair, and text."""
    text = text_or_empty()
    return docs.select("doc_id", *_keys(text), text.alias("text"))


def _keys(text) -> tuple:
    return F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(7), "doc_id").alias("k2")


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return (x == y).mean(1)


def sketches(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, k1, k2, paragraph (its first line), last_line, s1, s2, n and regs (42 registers of 16 bits) of each paragraph."""
    arrow_rows(rows.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, owner, of_text, lines, ends = _cut(list(b["text"]), min_words)
            _, bounds, ids, low = neardup.sketch(x, owner, len(lines), REGISTERS)
            out = b[["doc_id", "k1", "k2"]].iloc[of_text].reset_index(drop=True)
            regs = (low >> np.uint64(48)).astype("<u2")
            yield out.assign(paragraph=lines, last_line=ends, s1=ids[:, 0], s2=ids[:, 1], n=np.diff(bounds), regs=[r.tobytes() for r in regs])

    return rows.mapInPandas(sketch, f"doc_id {kind}, k1 long, k2 long, paragraph int, last_line int, s1 long, s2 long, n int, regs binary")


def paragraph_sets(rows: DataFrame, wanted: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(node, shingles) of the paragraphs ``wanted`` (node, k1, k2, paragraph), cut anew from the documents."""
    # One document's own paragraphs are gathered here: no more than its text holds.
    places = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("paragraph", "node")).alias("places"))
    chosen = rows.join(places, ["k1", "k2"]).select("text", F.map_from_entries("places").alias("places"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, owner, of_text, lines, _ = _cut(list(b["text"]), min_words)
            values, bounds, _, _ = neardup.sketch(x, owner, len(lines), REGISTERS)
            places = [dict(p) for p in b["places"]]
            found = [(places[t][line], values[bounds[k] : bounds[k + 1]].tobytes()) for k, (t, line) in enumerate(zip(of_text, lines)) if line in places[t]]
            yield pd.DataFrame(found, columns=["node", "shingles"]).astype({"node": np.int64})

    # A repeated row gives its sets as often as it stands there.
    return chosen.mapInPandas(sets, "node long, shingles binary").dropDuplicates(["node"])


def removals(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, removed): the lines that each document of ``rows`` (doc_id, k1, k2, text) loses, for those that lose any."""
    found = materialize(sketches(rows, min_words), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("paragraph"), F.col("k1"), F.col("k2")).alias("place")
    nodes = found.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("regs").alias("regs"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "paragraph-nodes")
    same = neardup.clusters(
        nodes.select("node", "n", "regs"),
        lambda wanted: paragraph_sets(rows, nodes.join(wanted, "node").select("node", "first.k1", "first.k2", "first.paragraph"), min_words),
        BANDS, 2 * ROWS, REGISTERS, estimate, "<u2", percent,
    )
    clustered = nodes.select("node", "s1", "s2", "first", "copies").join(same, "node", "left").filter("copies > 1 OR component IS NOT NULL")
    clustered = clustered.withColumn("c", F.coalesce("component", "node"))
    firsts = clustered.groupBy("c").agg(F.min("first").alias("stays"))
    by_set = clustered.join(firsts, "c").select("s1", "s2", F.col("stays.k1").alias("o1"), F.col("stays.k2").alias("o2"), F.col("stays.paragraph").alias("first"))
    others = found.select("k1", "k2", "paragraph", "last_line", "s1", "s2").join(by_set, ["s1", "s2"]).filter(
        (F.col("k1") != F.col("o1")) | (F.col("k2") != F.col("o2")) | (F.col("paragraph") != F.col("first"))
    )
    gone = F.array_distinct(F.flatten(F.collect_list(F.sequence("paragraph", "last_line"))))
    out = materialize(others.groupBy("k1", "k2").agg(F.array_sort(gone).alias("removed")), "paragraph-removals")
    release(found, nodes, same)
    return out


def _windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Text, place, hash and mark of each window of ``width`` words of a batch, and the runs that a window's mark is chosen from."""
    words = [hashing.words(t.encode("utf-8", "surrogatepass")) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    x = np.concatenate(words) if words else np.zeros(0, np.uint64)
    grams = width - (width + 1) // 2 + 1
    if len(x) < width:
        none = np.zeros(0, np.int64)
        return none, none, x[:0], x[:0], grams
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole, mark, have = hashing.runs(x, width), hashing.runs(x, (width + 1) // 2), 1
    while have < grams:
        step = min(have, grams - have)
        mark, have = np.minimum(mark[:-step], mark[step:]), have + step
    inside = owner[: len(whole)] == owner[width - 1 :]
    return owner[: len(whole)][inside], place[: len(whole)][inside], whole[inside], mark[inside], grams


def passages(texts: DataFrame, width: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, places): where windows of ``width`` words begin that stand in an earlier place as well.

    ``texts``, a written table, has doc_id, k1, k2 and text. An earlier place has a lower id, or
    comes first in one text.
    """
    arrow_rows(texts.sparkSession)
    kind = dict(texts.dtypes)["doc_id"]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            owner, place, _, marks, _ = _windows(list(b["text"]), width)
            first = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1]))[: len(marks)])
            length = np.diff(np.append(first, len(marks)))
            yield pd.DataFrame({"k1": b["k1"].to_numpy()[owner[first]], "mark": marks[first].view(np.int64), "place": place[first], "length": length})

    marks = materialize(texts.select("k1", "text").mapInPandas(mark, "k1 long, mark long, place int, length int"), "passage-marks")
    # One run of words gives its hash to so many windows at most; more windows, more places.
    grams = width - (width + 1) // 2 + 1
    repeated = marks.groupBy("mark").agg(F.sum(F.ceil(F.col("length") / grams)).alias("n")).filter("n > 1").select("mark")
    # Half of a text's name will do here: rows of another text cost its windows a look, no more.
    where = materialize(marks.join(repeated, "mark").select("k1", "place", "length"), "passage-places")
    runs = where.groupBy("k1").agg(F.collect_set(F.struct("place", "length")).alias("runs"))
    chosen = texts.join(runs, "k1").dropDuplicates(["k1", "k2"]).select("doc_id", "k1", "k2", "text", F.col("runs.place").alias("place"), F.col("runs.length").alias("length"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            owner, place, whole, marks, _ = _windows(list(b["text"]), width)
            begins = np.searchsorted(owner, np.arange(len(b) + 1))
            keep = np.zeros(len(owner) + 1, np.int64)
            for k, (p, n) in enumerate(zip(b["place"], b["length"])):
                np.add.at(keep, np.minimum(begins[k] + p, begins[k + 1]), 1)
                np.add.at(keep, np.minimum(begins[k] + p + n, begins[k + 1]), -1)
            rows = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
            rows = rows[np.lexsort((place[rows], whole[rows], owner[rows]))]
            o, p, w = owner[rows], place[rows], whole[rows]
            # A window that overlaps the one before it belongs to the same place.
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1]) | (p[1:] - p[:-1] >= width)
            start = p[fresh][np.cumsum(fresh) - 1]
            out = b[["doc_id", "k1", "k2"]].iloc[o].reset_index(drop=True)
            yield out.assign(whole=w.view(np.int64), mark=marks[rows].view(np.int64), place=p, start=start)

    found = materialize(chosen.mapInPandas(expand, f"doc_id {kind}, k1 long, k2 long, whole long, mark long, place int, start int"), "passage-windows")
    release(marks, where)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("start"), F.col("k1"), F.col("k2")))
    firsts = found.groupBy("whole", "mark").agg(first.alias("stays"))
    later = found.join(firsts, ["whole", "mark"]).filter((F.col("k1") != F.col("stays.k1")) | (F.col("k2") != F.col("stays.k2")) | (F.col("start") != F.col("stays.start")))
    # One document's own places: no more than its words.
    out = materialize(later.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("place")).alias("places")), "passages")
    release(found)
    return out


def without(text: str, places: np.ndarray, width: int) -> tuple[str, int]:
    """The text without the windows of ``width`` words that begin at ``places``, and how many words went."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends, line = hashing.word_places(raw)
    gone = np.zeros(len(starts) + 1, np.int64)
    gone[places] += 1
    gone[np.asarray(places) + width] -= 1
    inside = np.concatenate([[0], (np.cumsum(gone)[:-1] > 0).astype(np.int64), [0]])
    edges = np.diff(inside)
    out, at = [], 0
    for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        # White space goes with the passage on one side only, and lines that stay are not joined.
        heads_line = s == 0 or line[s] != line[s - 1]
        if e == len(starts):
            a, b = (ends[s - 1], ends[e - 1]) if s else (0, len(raw))
        elif heads_line:
            a, b = starts[s], starts[e]
        else:
            a, b = ends[s - 1], ends[e - 1]
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass"), int(inside.sum())


def cut(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents as a struct ``row`` with the text that stays, the list ``removed`` of lines cut whole, and ``n_words_cut`` of other words."""
    rows = _keyed(docs)
    lost = removals(rows, percent, min_words)
    lines = F.split("text", "\n")
    stays = F.array_join(F.filter(lines, lambda _, k: ~F.array_contains("removed", k)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(stays).alias("text")
    left = materialize(rows.join(lost, ["k1", "k2"], "left").select("doc_id", "k1", "k2", text), "passage-texts")
    again = passages(left, min_words)
    release(left)

    @F.pandas_udf("text string, n_words_cut long")
    def shorten(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        done = [(None, 0) if p is None else without(t, p, min_words) for t, p in zip(texts, places)]
        return pd.DataFrame(done, columns=["text", "n_words_cut"])

    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(text_or_empty()))
    joined = keyed.join(lost, ["k1", "k2"], "left").join(again, ["k1", "k2"], "left")
    joined = joined.withColumn("text", F.col("row.text")).withColumn("text", text)
    short = shorten(F.when(F.col("places").isNotNull(), F.col("text")), F.col("places"))
    done = joined.select("row", "removed", "text", short.alias("short"))
    return done.select(
        F.col("row").withField("text", F.coalesce("short.text", "text")).alias("row"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("short.n_words_cut", F.lit(0)).cast("long").alias("n_words_cut"),
    )
