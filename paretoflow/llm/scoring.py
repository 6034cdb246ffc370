"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

The network knows a vocabulary of symbols: the end of a text, the most frequent words (those that
make up at least ``LEAST_SHARE`` of all tokens, up to ``TOP_WORDS``), and for each class of words one
symbol for its rarer ones. Classes are neighbours in the order of the words' endings. From the
vectors of the two symbols before a token a log-bilinear network predicts its class, and within the
class its symbol; batched matrix products normalise over all classes, and over all symbols of the
class. A rarer word has its discounted share of its class's rare words, and what discounting frees
is the probability of an unknown word, so token probabilities sum to 1.

Documents are dealt once into chunks of ``CHUNK_BYTES`` by a hash of their id and text, and written by chunk; how
the input is split or how many tasks run changes neither chunks nor scores (where one row is repeated more than
``COPIES`` times, its copies are spread by row number instead). What is learnt comes from all training documents:
words are counted exactly (chunks send their distinct words to blocks, a block adds them up and answers each
chunk). The network is trained in numpy with noise-contrastive estimation, both for classes and for symbols
within them: every chunk is learnt from common parameters, and the chunks' parameters are averaged by how often
they were used, in rounds over a 64th, three 64ths, twelve and the rest of the chunks, so that many chunks begin where
few have led. Training grows with the corpus; small ones are gone over several times. Only the symbols' counts and the
parameters, both bounded by ``TOP_WORDS``, reach the driver.

Defined cases: a null or empty text is the end token alone; a null doc_id hashes as an empty
string; without training tokens every word is unknown; repeated rows count as often as they
occur; very long texts are scored whole; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import arrow_rows, materialize, text_or_empty

#: Symbols: words of their own at most, the least share of all tokens that makes one, and classes of words.
TOP_WORDS, LEAST_SHARE, CLASSES = 3072, 2e-6, 56
START, END = 0, 1
#: The end token: no word holds white space.
END_TOKEN = b"\n"
ENDING = 3
DISCOUNT = 0.75
DIMENSIONS, CLASS_NOISE, NOISE, BATCH, RATE, SEED = 20, 16, 8, 8192, 0.12, 11
#: Tokens that a training pass sees at least, by repeats (16 at most) if the corpus has fewer.
LEAST_TOKENS = 1_500_000
CHUNK_BYTES = 6_000_000
#: Rounds of training, by a chunk's number modulo 64: first and last.
ROUNDS = ((0, 0), (1, 3), (4, 15), (16, 63))
#: Copies of one row that may lie in one chunk.
COPIES = 1000
BLOCK_BYTES = 12_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased words, then the end. ``split`` cuts at the six ASCII white-space bytes."""
    return [*raw.lower().split(), END_TOKEN]


def _runs(b: np.ndarray, inside: np.ndarray) -> pa.Array:
    """The runs of the bytes marked ``inside``; the first and the last byte are not."""
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    offsets = np.zeros(len(edges) // 2 + 1, np.int64)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])])


def _distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the place among them of each word."""
    found = words.dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def encoded(raws: Iterable[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The :func:`tokens` of texts that follow each other: distinct ones, the place among them of each, and each text's number."""
    raws = list(raws)
    b = np.frombuffer(b" ".join([b"", *(x for raw in raws for x in (raw, END_TOKEN)), b""]).lower(), np.uint8)
    inside = ~hashing.SPACE[b]
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 3) - 1
    inside[ends] = True
    # A token begins where a marked byte follows an unmarked one.
    begins = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    distinct, at = _distinct(_runs(b, inside))
    return distinct, at, np.diff(np.searchsorted(begins, ends), prepend=-1)


def _joined(data: Iterable[bytes]) -> pa.Array:
    """The words of texts in which single blanks part them."""
    b = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    return _runs(b, b != 32)


def _endings(words: pa.Array) -> np.ndarray:
    """A number for the last ``ENDING`` bytes of each word, in the order of the reversed endings."""
    out = np.zeros(len(words), np.int64)
    if len(words):
        offsets, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
        for j in range(1, ENDING + 1):
            at = offsets[1:] - j
            out = out * 257 + np.where(at >= offsets[:-1], data[np.maximum(at, 0)].astype(np.int64) + 1, 0)
    return out


@dataclass
class Symbols:
    """The network's vocabulary. Class 0 is the end; the symbols of a class are neighbours, its rare one last."""

    words: dict[bytes, int]
    #: Reversed endings at which the classes from 2 on begin; class 1 begins at the empty one.
    bounds: list[bytes]
    #: First symbol of each class, and one past the last.
    starts: np.ndarray
    #: Training count of each symbol; of rare symbols, their tokens and distinct words.
    counts: np.ndarray
    rare_total: np.ndarray
    rare_distinct: np.ndarray
    train_tokens: int
    train_distinct: int

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def classes(self) -> np.ndarray:
        """Class of each symbol; the start, which is never predicted, counts to the end's."""
        out = np.zeros(self.size, np.int64)
        out[self.starts[1] :] = np.repeat(np.arange(1, len(self.starts) - 1), np.diff(self.starts[1:]))
        return out

    def ids(self, own: pa.Array | list[bytes], seen: dict) -> np.ndarray:
        """Symbol of each word; ``seen`` keeps the tables that words are looked up in between calls."""
        own = own if isinstance(own, pa.Array) else pa.array(own, pa.large_binary())
        if not seen:
            seen["words"], seen["symbols"] = pa.array(list(self.words), pa.large_binary()), np.array(list(self.words.values()), np.int64)
            seen["bounds"] = _endings(pa.array([x[::-1] for x in self.bounds], pa.large_binary()))
        out = self.starts[np.searchsorted(seen["bounds"], _endings(own), side="right") + 2] - 1
        place = pc.index_in(own, value_set=seen["words"]).fill_null(-1).to_numpy()
        named = place >= 0
        out[named] = seen["symbols"][place[named]]
        return out

    def cells(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(symbol two before, symbol before, symbol) of each token as one number; texts of ``sizes`` tokens, one at least, follow each other."""
        begins = np.cumsum(sizes) - sizes
        near, far = np.full(len(ids), START, np.int64), np.full(len(ids), START, np.int64)
        near[1:], far[2:] = ids[:-1], ids[:-2]
        near[begins] = far[begins] = START
        far[begins[sizes > 1] + 1] = START
        return (far * self.size + near) * self.size + ids

    def split(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return cells // self.size**2, cells // self.size % self.size, cells % self.size


class Network:
    """Parameters as rows of one table: context vectors, symbols and classes with a bias last, and the two matrices."""

    def __init__(self, known: Symbols, table: np.ndarray | None = None) -> None:
        self.known, n, c, d = known, known.size, len(known.starts) - 1, DIMENSIONS
        self.at = np.cumsum([0, n, n, c, d, d])
        #: Small numbers are sorted by their digits.
        self.class_of, self.small = known.classes(), np.min_scalar_type(n)
        within = np.maximum(known.counts, 0.1)
        mass = np.bincount(self.class_of, within, minlength=c)
        self.class_share = np.maximum(mass / mass.sum(), 1e-9)
        self.share = within / mass[self.class_of]
        self.class_noise, self.noise = (CLASS_NOISE * self.class_share).astype(np.float32), (NOISE * self.share).astype(np.float32)
        if table is None:
            rng = np.random.default_rng(SEED)
            table = np.zeros((self.at[-1], d + 1), np.float32)
            table[: self.at[3], :d] = rng.normal(0, 0.1, (self.at[3], d))
            table[self.at[1] : self.at[2], d] = np.log(self.share)
            table[self.at[2] : self.at[3], d] = np.log(self.class_share)
            table[self.at[3] : self.at[4], :d] = np.eye(d) * 0.5
            table[self.at[4] : self.at[5], :d] = np.eye(d)
        self.table = table
        self.squares = np.full(len(table), 1e-6, np.float32)
        self.used = np.zeros(len(table), np.float32)

    def part(self, k: int) -> np.ndarray:
        return self.table[self.at[k] : self.at[k + 1]]

    def _add(self, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        """Adagrad with one learning rate for each row of the table."""
        self.squares[rows] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        self.table[rows] += RATE * gradient / np.sqrt(self.squares[rows])[:, None]

    def learn(self, cells: np.ndarray, weights: np.ndarray) -> None:
        """One step of noise-contrastive estimation on a batch of cells that occurred ``weights`` times.

        The expectation over noise, drawn by share of all tokens for classes and by share of the class
        for symbols, is taken exactly: products with all classes, and with all symbols of a class.
        """
        far, near, target = self.known.split(cells)
        order = np.argsort(target.astype(self.small), kind="stable")
        far, near, target = far[order], near[order], target[order]
        w = (weights[order] / weights.mean()).astype(np.float32)[:, None]
        context, symbols, classes = self.part(0), self.part(1), self.part(2)
        f, n, d = self.part(3)[:, :DIMENSIONS], self.part(4)[:, :DIMENSIONS], DIMENSIONS
        r2, r1 = context[far][:, :d], context[near][:, :d]
        one = np.ones((len(cells), d + 1), np.float32)
        one[:, :d] = r2 @ f + r1 @ n
        weighted, own, each = one * w, self.class_of[target], np.arange(len(cells))
        from_noise = _from_noise(classes, self.class_noise)
        g = one @ from_noise.T
        _contrast(g.ravel(), each * len(classes) + own, self.class_noise[own])
        back, of_classes = g @ (classes[:, :d] * -self.class_noise[:, None]), g.T @ weighted * -self.class_noise[:, None]
        of_symbols, scaled, from_noise = np.zeros_like(symbols), symbols[:, :d] * -self.noise[:, None], _from_noise(symbols, self.noise)
        # Targets are in order, so the cells of a class are neighbours; their scores lie one class after the other.
        sizes = np.diff(self.known.starts)
        bounds = np.searchsorted(own, np.arange(len(classes) + 1))
        begins = np.concatenate([[0], np.cumsum(np.diff(bounds) * sizes)])
        scores = np.zeros(begins[-1], np.float32)
        parts = [
            (slice(s, e), slice(first, first + size), scores[at : at + (e - s) * size].reshape(e - s, size))
            for s, e, first, size, at in zip(bounds[:-1].tolist(), bounds[1:].tolist(), self.known.starts[:-1].tolist(), sizes.tolist(), begins.tolist())
            if s < e and size > 1
        ]
        for mine, of, g in parts:
            np.matmul(one[mine], from_noise[of].T, out=g)
        _contrast(scores, begins[own] + (each - bounds[own]) * sizes[own] + target - self.known.starts[own], self.noise[target])
        for mine, of, g in parts:
            back[mine] += g @ scaled[of]
            of_symbols[of] = g.T @ weighted[mine]
        of_symbols *= -self.noise[:, None]
        back *= w
        wide = lambda x: np.concatenate([x, np.zeros((len(x), 1), np.float32)], 1)
        self._add(slice(self.at[1], self.at[5]), np.concatenate([of_symbols, of_classes, wide(r2.T @ back), wide(r1.T @ back)]))
        rows = np.concatenate([far, near])
        order = np.argsort(rows.astype(self.small), kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        self._add(rows[order[first]], wide(np.add.reduceat(np.concatenate([back @ f.T, back @ n.T])[order], first)))
        self.used[: self.at[1]] += np.bincount(rows, np.concatenate([weights, weights]), minlength=self.at[1])
        self.used[self.at[1] : self.at[2]] += np.bincount(target, weights, minlength=self.at[1])
        self.used[self.at[2] :] += float(weights.sum())

    def study(self, cells: np.ndarray, repeats: int, rng: np.random.Generator) -> None:
        """All cells of some texts in random order, ``repeats`` times; equal cells count together."""
        distinct, counts = np.unique(cells, return_counts=True)
        for _ in range(repeats):
            order = rng.permutation(len(distinct))
            for s in range(0, len(order), BATCH):
                self.learn(distinct[order[s : s + BATCH]], counts[order[s : s + BATCH]].astype(np.float64))

    def log10(self, cells: np.ndarray) -> np.ndarray:
        """log10 P(symbol | two symbols before) of each cell, normalised over all classes and all symbols of the class."""
        distinct, inverse = np.unique(cells, return_inverse=True)
        d, symbols, classes = DIMENSIONS, self.part(1), self.part(2)
        a, b = self.part(0)[:, :d] @ self.part(3)[:, :d], self.part(0)[:, :d] @ self.part(4)[:, :d]
        context, target = np.divmod(distinct, self.known.size)
        # Cells are in order, so those of a context are neighbours: classes are normalised once for each.
        begins = np.flatnonzero(np.diff(context, prepend=-1))
        ends = np.append(begins[1:], len(distinct))
        far, near = np.divmod(context[begins], self.known.size)
        out = np.empty(len(distinct), np.float64)
        for s in range(0, len(begins), 16384):
            part = slice(s, s + 16384)
            predicted = a[far[part]] + b[near[part]]
            cells_here = slice(begins[s], ends[min(s + 16384, len(ends)) - 1])
            of = np.repeat(np.arange(len(predicted)), ends[part] - begins[part])
            t = target[cells_here]
            own = self.class_of[t]
            scores = np.clip(predicted @ classes[:, :d].T + classes[:, d], -60, 60)
            score = scores[of, own].astype(np.float64)
            np.exp(scores, out=scores)
            score -= np.log(scores @ np.ones(scores.shape[1], np.float32))[of]
            order = np.argsort(own, kind="stable")
            bounds = np.searchsorted(own[order], np.arange(len(classes) + 1))
            for k in range(len(classes)):
                first, end = self.known.starts[k], self.known.starts[k + 1]
                if end - first > 1 and bounds[k] < bounds[k + 1]:
                    mine = order[bounds[k] : bounds[k + 1]]
                    score[mine] += _log_share(predicted[of[mine]] @ symbols[first:end, :d].T + symbols[first:end, d], t[mine] - first)
            out[cells_here] = score
        return out[inverse.ravel()] / np.log(10)


def _from_noise(vectors: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Vectors whose products are the log odds of ``noise`` against truth."""
    out = -vectors
    out[:, -1] += np.log(noise)
    return out


def _contrast(odds: np.ndarray, chosen: np.ndarray, noise: np.ndarray) -> None:
    """Gradient of the noise-contrastive objective by scores, in place of the log odds of noise against truth.

    It is left divided by minus the noise of each score's symbol; ``chosen`` are the places of the targets, and ``noise`` theirs.
    """
    with np.errstate(over="ignore"):
        np.exp(odds, out=odds)
    odds += 1
    np.reciprocal(odds, out=odds)
    truth = odds[chosen]
    odds[chosen] = truth - (1 - truth) / noise


def _log_share(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    np.clip(scores, -60, 60, out=scores)
    own = scores[np.arange(len(scores)), chosen].astype(np.float64)
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, raw, held_out and chunk, written so that a file holds whole chunks; and the number of blocks of the vocabulary."""
    text = text_or_empty()
    mark = F.xxhash64(F.col("doc_id").cast("string"), text)
    seen = docs.select(mark.alias("mark"), F.octet_length(text).alias("bytes")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    total, most = seen.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    chunks = max(1, -(-total // CHUNK_BYTES))
    rows = docs.select("doc_id", text.cast("binary").alias("raw"), held_out().alias("held_out"), mark.alias("mark"))
    place = F.col("mark")
    if most > COPIES:
        rows = rows.join(seen.filter(F.col("n") > COPIES).select("mark", "n"), "mark", "left")
        place = F.when(F.col("n").isNotNull(), F.xxhash64("mark", F.spark_partition_id(), F.monotonically_increasing_id())).otherwise(place)
    # The mark is used up by the chunk; its other bits order the rows of a chunk.
    placed = rows.withColumn("chunk", F.pmod(F.xxhash64(place), F.lit(chunks)))
    by_chunk = placed.repartition(chunks, "chunk").sortWithinPartitions("chunk", "mark")
    return materialize(by_chunk.select("doc_id", "raw", "held_out", "chunk"), "score-dealt"), max(1, -(-total // BLOCK_BYTES))


def _by_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks of a task; the rows of each are neighbours."""
    held: list[pd.DataFrame] = []
    for b in batches:
        while len(b):
            chunk = b["chunk"].iloc[0]
            own = b[b["chunk"] == chunk]
            if held and held[-1]["chunk"].iloc[0] != chunk:
                yield pd.concat(held)
                held = []
            held.append(own)
            b = b.iloc[len(own) :]
    if held:
        yield pd.concat(held)


def vocabulary(dealt: DataFrame, blocks: int) -> DataFrame:
    """Counts of all training words, by block, in one table of three kinds of rows.

    kind 0: for a chunk, its distinct words (``data``, joined by line ends) and their counts in all
    training documents (``counts``). kind 1: a block's most frequent words, of which there are more than
    its part of the most frequent ones of all. kind 2: a block's endings, with ``n`` tokens and
    ``distinct`` words; the empty ending holds the end token.
    """
    # Words are dealt by hash: a block with so many of the most frequent words does not occur.
    most = min(TOP_WORDS, 8 * TOP_WORDS // blocks + 64)

    def words(b: pd.DataFrame) -> pd.DataFrame:
        distinct, at, sizes = encoded(b["raw"])
        trained = np.bincount(at[np.repeat(~b["held_out"].to_numpy(bool), sizes)], minlength=len(distinct))
        order = pc.array_sort_indices(distinct).to_numpy()
        own = np.array(distinct.take(pa.array(order)).to_pylist(), object)
        block = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % blocks
        of_block = np.argsort(block, kind="stable")
        own, trained, present = own[of_block], trained[order][of_block].astype("<i8"), np.unique(block)
        bounds = np.searchsorted(block[of_block], np.append(present, blocks))
        rows = [
            (k, b["chunk"].iloc[0], b" ".join(own[s:e]), trained[s:e].tobytes())
            for k, s, e in zip(present.tolist(), bounds[:-1], bounds[1:])
        ]
        return pd.DataFrame(rows, columns=["block", "chunk", "data", "counts"])

    def added(b: pd.DataFrame) -> pd.DataFrame:
        distinct, at = _distinct(_joined(b["data"]))
        counts = np.frombuffer(b"".join(b["counts"]), "<i8")
        total = np.zeros(len(distinct), "<i8")
        np.add.at(total, at, counts)
        answers, ends = total[at], np.cumsum([len(n) // 8 for n in b["counts"]])
        rows = [(0, chunk, data, x.tobytes(), 0, 0) for chunk, data, x in zip(b["chunk"], b["data"], np.split(answers, ends[:-1]))]
        # Words at least as frequent as the last of the most frequent ones, which may be the end token; ties go by the word.
        trained = np.flatnonzero(total)
        least = np.partition(total[trained], -most - 1)[-most - 1] if len(trained) > most else 1
        often = np.flatnonzero(total >= least)
        best = sorted(zip((-total[often]).tolist(), distinct.take(pa.array(often)).to_pylist()))
        rows += [(1, 0, w, b"", -c, 1) for c, w in [x for x in best if x[1] != END_TOKEN][:most]]
        _, first, of = np.unique(_endings(distinct)[trained], return_index=True, return_inverse=True)
        n = np.zeros(len(first), "<i8")
        np.add.at(n, of, total[trained])
        named = [b"" if w == END_TOKEN else w[-ENDING:] for w in distinct.take(pa.array(trained[first])).to_pylist()]
        rows += [(2, 0, e, b"", c, d) for e, c, d in zip(named, n.tolist(), np.bincount(of, minlength=len(first)).tolist())]
        return pd.DataFrame(rows, columns=["kind", "chunk", "data", "counts", "n", "distinct"])

    def packed_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _by_chunk(batches):
            yield words(b)

    arrow_rows(dealt.sparkSession)
    packed = dealt.mapInPandas(packed_words, "block int, chunk long, data binary, counts binary")
    return packed.groupBy("block").applyInPandas(
        added, "kind int, chunk long, data binary, counts binary, n long, distinct long"
    )


def symbols(table: DataFrame) -> Symbols:
    """Choose symbols and classes; at most TOP_WORDS words and CLASSES sums reach the driver."""
    endings = materialize(table.filter("kind = 2").groupBy("data").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")), "score-endings")
    n, distinct = endings.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    top = table.filter((F.col("kind") == 1) & (F.col("n") >= LEAST_SHARE * n)).orderBy(F.col("n").desc(), "data").limit(TOP_WORDS).collect()
    named = sorted((bytes(r["data"])[-ENDING:][::-1], bytes(r["data"]), r["n"]) for r in top)
    # As many words to each class; an ending is not divided.
    cuts = sorted({named[k * len(named) // CLASSES][0] for k in range(1, CLASSES)} - {named[0][0]}) if named else []
    groups: list[list[tuple[bytes, int]]] = [[] for _ in range(len(cuts) + 1)]
    for ending, word, count in named:
        groups[bisect.bisect_right(cuts, ending)].append((word, count))
    starts = np.cumsum([END, 1, *(len(g) + 1 for g in groups)])
    words, counts = {END_TOKEN: END}, np.zeros(starts[-1])
    rare_total, rare_distinct = np.zeros(len(groups) + 1), np.zeros(len(groups) + 1)
    for k, g in enumerate(groups, 1):
        for j, (word, count) in enumerate(g):
            words[word] = int(starts[k]) + j
            counts[starts[k] + j] = count
        rare_total[k] -= sum(c for _, c in g)
        rare_distinct[k] -= len(g)
    @F.pandas_udf("int")
    def placed(data: pd.Series) -> pd.Series:
        return data.map(lambda e: bisect.bisect_right(cuts, e[::-1]) + 1 if e else 0)

    sums = endings.groupBy(placed("data").alias("class")).agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"))
    for row in sums.collect():
        if row["class"] == 0:
            counts[END] = row["n"]
        else:
            rare_total[row["class"]] += row["n"]
            rare_distinct[row["class"]] += row["distinct"]
    counts[starts[2:] - 1] = rare_total[1:]
    return Symbols(words, cuts, starts, counts, rare_total, rare_distinct, n, distinct)


def _round(chunks: DataFrame, known: Symbols, network: Network, repeats: int) -> Network:
    """Every chunk is learnt beginning with ``network``; the average of their parameters, and of their steps' scales, by use."""
    begin, squares, slices, groups = network.table, network.squares, 16, 64

    def study(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        total, uses, first = np.zeros((len(begin), begin.shape[1] + 1)), np.zeros(len(begin)), None
        for b in _by_chunk(batches):
            first = int(b["chunk"].iloc[0]) if first is None else first
            own = Network(known, begin.copy())
            own.squares = squares.copy()
            distinct, at, sizes = encoded(b["raw"])
            own.study(known.cells(known.ids(distinct, seen)[at], sizes), repeats, np.random.default_rng(SEED))
            total += np.column_stack([own.table, own.squares]) * own.used[:, None].astype(np.float64)
            uses += own.used
        if first is not None:
            for k in range(slices):
                yield pd.DataFrame({"slice": [k], "part": [first % groups], "used": [uses[k::slices].tobytes()], "data": [total[k::slices].tobytes()]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        used = sum(np.frombuffer(x, "<f8") for x in b["used"])
        data = sum(np.frombuffer(x, "<f8") for x in b["data"])
        return pd.DataFrame({"slice": [b["slice"].iloc[0]], "part": [0], "used": [used.tobytes()], "data": [data.tobytes()]})

    kinds = "slice int, part int, used binary, data binary"
    # Tasks' sums meet in 64 groups of each slice, and these in one.
    sums = chunks.mapInPandas(study, kinds).groupBy("slice", "part").applyInPandas(add, kinds).groupBy("slice").applyInPandas(add, kinds)
    out = Network(known, begin.copy())
    out.squares = squares.copy()
    for row in sums.collect():
        k, used = row["slice"], np.frombuffer(row["used"], "<f8")
        data = np.frombuffer(row["data"], "<f8").reshape(len(used), -1)
        known_rows = used > 0
        average = data[known_rows] / used[known_rows, None]
        at = np.arange(k, len(begin), slices)[known_rows]
        out.table[at], out.squares[at] = average[:, :-1], average[:, -1]
    return out


def trained(dealt: DataFrame, known: Symbols) -> Network:
    """The network after all rounds over the training documents."""
    repeats = int(np.clip(LEAST_TOKENS // max(1, known.train_tokens), 1, 16))
    arrow_rows(dealt.sparkSession)
    network, training = Network(known), dealt.filter("NOT held_out").select("chunk", "raw")
    for first, last in ROUNDS:
        network = _round(training.filter((F.col("chunk") % 64).between(first, last)), known, network, repeats)
    return network


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    dealt, blocks = _dealt(docs)
    table = materialize(vocabulary(dealt, blocks), "score-vocabulary")
    known = symbols(table)
    learnt = trained(dealt, known).table
    kind = dict(docs.dtypes)["doc_id"]
    base_total = known.train_tokens + known.train_distinct + 1

    def scored(b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        network, class_of = Network(known, learnt), known.classes()
        # What hangs on a word alone is computed once for each distinct word of the chunk.
        words, at, sizes = encoded(b["raw"])
        place = pc.index_in(words, value_set=_joined(answers["data"]))
        if place.null_count:
            raise ValueError("a word of the chunk has no count")
        c = np.frombuffer(b"".join(answers["counts"]), "<i8")[place.to_numpy()]
        of_word = known.ids(words, {})
        every, classes = of_word[at], class_of[of_word]
        total, distinct = known.rare_total[classes], known.rare_distinct[classes]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log10(np.maximum(c - DISCOUNT, 1e-9) / total)
            unknown = np.where(total > 0, np.log10(DISCOUNT * distinct / total), 0.0)
        rare = of_word == known.starts[classes + 1] - 1
        inside = np.where(rare & (of_word > END), np.where(c > 0, share, unknown), 0.0)[at]
        model = network.log10(known.cells(every, sizes)) + inside if len(every) else inside
        base = np.log10((c + 1) / base_total)[at]
        ends = np.cumsum(sizes)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        return pd.DataFrame(
            {
                "doc_id": b["doc_id"].to_numpy() if len(b) else [], "n_tokens": sizes, "n_known": sums((c > 0).astype(np.int64)[at]), "base_score": sums(base), "score": sums(model),
                "held_out": b["held_out"].to_numpy() if len(b) else [], "train_tokens": known.train_tokens,
            }
        )

    replies = table.filter("kind = 0").select("chunk", "data", "counts")
    result = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(
        scored, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, held_out boolean, train_tokens long"
    )
    return result.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
