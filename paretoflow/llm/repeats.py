"""Exact removal of repeated byte strings, by blockwise work on a difference-cover sample of suffixes.

Every string of ``length`` bytes that starts at two places, in one document or in two, is found,
and the bytes that any such string covers are removed.

1. Cover sample. The positions of a document whose residue modulo v lies in a difference cover
   are its sample suffixes: for any two positions i, j some k < v makes both i + k and j + k
   sample positions. Their first ``length`` - v + 1 bytes get a name (rank) that is equal just for
   equal strings. Names are dealt to blocks by value, each block is sorted on its own, and names
   that occur twice are marked.
2. Longer ranks. Marked sample suffixes get two longer names, one to each side, dealt and sorted in
   the same way: a suffix within reach (k < v) shares one of them with any repeat of it.
3. Suffix buckets. Only a suffix that reaches a marked longer name can tie with another one for
   ``length`` bytes; all others are settled by the sample. Those few are dealt to buckets by the
   value of their first ``length`` bytes, and one bucket at a time is sorted; equal neighbours are
   repeats.
4. Answers go back as one bit per distinct value and chunk of documents, in sorted order. The
   chunk works out the same values again, reads its bits and cuts the covered bytes.

Copies are one text from the start, however many there are; a copied text of ``length`` bytes or
more is removed as a whole. Within a chunk equal values are combined before any shuffle, so a string
that all texts share costs one value per chunk. Names are 64-bit polynomial hashes of byte strings, which
may let a suffix through for nothing; what decides on a removal are 96 bits of two such hashes. The
documents' texts are dealt to chunks for each of the four steps, whose answers are written.

Defined cases: a null or empty text has 0 bytes and loses none; texts shorter than ``length``
lose none; copies and repeated rows repeat each other and lose everything from ``length`` bytes
on; text that repeats itself with a short period overlaps and is cut; an empty table gives an
empty result; further columns are ignored, null ids are kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import arrow_rows, materialize, text_or_empty

LENGTH = 400
#: Text bytes of a chunk of documents and of the share of a block, on average.
CHUNK_BYTES = 6_000_000
BLOCK_BYTES = 12_000_000
#: A name covers at least so many bytes.
NAME_BYTES = 64


@functools.cache
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """Singer's perfect difference set for a prime q: v = q*q + q + 1 and its q + 1 residues.

    Exponents of a generator of GF(q^3) whose power has no quadratic term; cubics are tried until
    all differences occur.
    """
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        element, found = (1, 0, 0), []
        for exponent in range(v):
            if element[2] == 0:
                found.append(exponent)
            x0, x1, x2 = element
            element = (x2 * c % q, (x0 + x2 * b) % q, (x1 + x2 * a) % q)
        if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
            return v, tuple(found)
    raise ValueError(f"no difference cover for {q}")


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves a name of enough bytes."""
    primes = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if q * q + q + 1 <= length - NAME_BYTES]
    return difference_cover(primes[-1]) if primes else (1, (0,))


class Layout:
    """How strings of ``length`` bytes are sampled, and how values are dealt to blocks."""

    def __init__(self, length: int, blocks: int) -> None:
        self.length, self.blocks = length, blocks
        self.v, residues = cover_for(length)
        self.name = length - self.v + 1
        self.half = (self.v - 1) // 2
        self.residues = np.array(residues)

    def sums(self, raw: bytes) -> np.ndarray:
        return hashing.prefix(np.frombuffer(raw, np.uint8))

    def names(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample positions of a text and their names."""
        n = len(sums) - 1
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = (np.arange(0, n, self.v)[:, None] + self.residues[None]).ravel()
        at = at[at + self.name <= n]
        return at, hashing.spans(sums, at, at + self.name)

    def longer(self, sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longer names of marked sample positions, to the right and to the left.

        Suffixes up to ``half`` bytes before a position share the right name with their repeats,
        those further before it the left name.
        """
        right = at[at + self.length - self.half < len(sums)]
        left = at[at > self.half]
        return (
            right,
            hashing.spans(sums, right, right + self.length - self.half),
            left,
            hashing.spans(sums, left - self.half - 1, left + self.name) ^ np.uint64(self.v),
        )

    def starts(self, sums: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Suffixes that reach a position whose longer name on their side is marked."""
        n = len(sums) - self.length
        change = np.zeros(n + 1, np.int32)
        for first, last in ((right - self.half, right), (left - self.v + 1, left - self.half - 1)):
            np.add.at(change, np.clip(first, 0, n), 1)
            np.add.at(change, np.clip(last + 1, 0, n), -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def windows(self, raw: bytes, sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What tells strings of ``length`` bytes apart: 64 bits and 32 more."""
        out = np.empty(len(starts), WIDE)
        out["a"] = hashing.spans(sums, starts, starts + self.length)
        if len(starts):
            out["b"] = hashing.spans(hashing.prefix(np.frombuffer(raw, np.uint8), True), starts, starts + self.length) >> np.uint64(32)
        return out

    def deal(self, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values in order, whether each occurred twice, and where each block begins."""
        every = np.concatenate(values) if values else np.zeros(0, np.uint64)
        every = every[_order(every)]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        distinct = every[new]
        twice = np.diff(np.append(np.flatnonzero(new), len(every))) > 1
        edges = np.array([(k << 64) // self.blocks for k in range(1, self.blocks)], np.uint64)
        bounds = np.concatenate([[0], np.searchsorted(_first(distinct), edges), [len(distinct)]])
        return distinct, twice, bounds

    def packed(self, chunk: int, values: list[np.ndarray]) -> pd.DataFrame:
        """One row for each block that gets values of this chunk."""
        distinct, twice, bounds = self.deal(values)
        rows = []
        for block in range(self.blocks):
            s, e = bounds[block], bounds[block + 1]
            if s < e:
                rows.append((block, chunk, _pack(distinct[s:e]), np.packbits(twice[s:e]).tobytes()))
        return pd.DataFrame(rows, columns=["block", "chunk", "data", "twice"])

    def marked(self, values: list[np.ndarray], answers: dict[int, bytes]) -> np.ndarray:
        """The distinct values whose bits are set in the blocks' answers."""
        distinct, _, bounds = self.deal(values)
        keep = np.zeros(len(distinct), bool)
        for block in range(self.blocks):
            s, e = bounds[block], bounds[block + 1]
            if s < e:
                keep[s:e] = np.unpackbits(np.frombuffer(answers[block], np.uint8), count=e - s)
        return distinct[keep]


#: A value that decides on a removal.
WIDE = np.dtype([("a", "<u8"), ("b", "<u4")])


def _first(values: np.ndarray) -> np.ndarray:
    """The leading 64 bits, by which values are dealt and sorted."""
    return values["a"] if values.dtype == WIDE else values


def _order(values: np.ndarray) -> np.ndarray:
    order = np.argsort(_first(values), kind="stable")
    if values.dtype == WIDE:
        a, b = values["a"][order], values["b"][order]
        # Strings whose leading bits agree but not the others are rare: then all is sorted by both.
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((values["b"], values["a"]))
    return order


def _pack(ordered: np.ndarray) -> bytes:
    """Differences of sorted values, byte plane by byte plane: high planes are zero and compress. Further bits follow as they are."""
    steps = np.diff(_first(ordered), prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    return planes + (ordered["b"].tobytes() if ordered.dtype == WIDE else b"")


def _unpack(data: bytes, wide: bool) -> np.ndarray:
    n = len(data) // (12 if wide else 8)
    steps = np.frombuffer(data, np.uint8, 8 * n).reshape(8, -1).T.copy().view("<u8")[:, 0]
    values = np.cumsum(steps, dtype=np.uint64)
    if not wide:
        return values
    out = np.empty(n, WIDE)
    out["a"], out["b"] = values, np.frombuffer(data, "<u4", n, 8 * n)
    return out


def _keys(ordered: np.ndarray) -> np.ndarray:
    """The leading 64 bits side by side, as a search wants them."""
    return np.ascontiguousarray(_first(ordered))


def _within(values: np.ndarray, ordered: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Which values are among the ordered distinct ones, whose :func:`_keys` may be given."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    keys, last = _keys(ordered) if keys is None else keys, len(ordered) - 1
    at = np.searchsorted(keys, _first(values))
    found = ordered[np.minimum(at, last)] == values
    # Values whose leading bits agree stand side by side; more than one is rare.
    k = 1
    while len(left := np.flatnonzero(~found & (keys[np.minimum(at + k, last)] == _first(values)) & (at + k <= last))):
        found[left] = ordered[at[left] + k] == values[left]
        k += 1
    return found


def _resolved(packed: DataFrame, kind: int) -> DataFrame:
    """Sort one block at a time; per chunk and block, which of its values occur twice anywhere. Kind 2 has wide values."""

    def block(b: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, kind == 2) for x in b["data"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(b["twice"], parts)]).astype(bool)
        values = np.concatenate(parts)
        order = _order(values)
        same = values[order][1:] == values[order][:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        bits = np.split(twice, np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"kind": kind, "chunk": b["chunk"], "block": b["block"], "bits": [np.packbits(x).tobytes() for x in bits]})

    return packed.groupBy("block").applyInPandas(block, "kind int, chunk long, block int, bits binary")


def _answers(rows: pd.DataFrame, kind: int) -> dict[int, bytes]:
    own = rows[rows["kind"] == kind]
    return dict(zip(own["block"], own["bits"]))


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """[start, end) of the maximal runs of bytes that strings at the sorted ``starts`` cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], np.diff(starts) > length])
    firsts = starts[new]
    lasts = starts[np.concatenate([new[1:], [True]])]
    return np.stack([firsts, lasts + length], 1)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the bytes that stay) and spans (removed [start, end) pairs)."""
    whole = {"kept": F.lit(b""), "spans": F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))}
    columns = ["n_bytes long", "kept binary", "spans array<struct<start:long,end:long>>"]
    return _per_document(docs, length, columns, _whole, whole).drop("n_bytes")


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes as text, cut characters replaced."""
    whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(F.lit(b""), 256), "text": F.lit("")}
    return _per_document(docs, length, ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "text string"], _digest, whole)


def _kept(raw: bytes, runs: np.ndarray) -> bytes:
    at, parts = 0, []
    for s, e in runs.tolist():
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def _whole(raw: bytes, runs: np.ndarray) -> tuple:
    return len(raw), _kept(raw, runs), [{"start": s, "end": e} for s, e in runs.tolist()]


def _digest(raw: bytes, runs: np.ndarray) -> tuple:
    kept = _kept(raw, runs)
    return len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")


def _first_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's texts without repeats: copies meet their like before any shuffle."""
    seen: set[bytes] = set()
    for b in batches:
        new = [k not in seen and not seen.add(k) for k in b["key"]]
        yield b[np.array(new, bool)]


def _per_document(docs: DataFrame, length: int, columns: list[str], output, whole: dict) -> DataFrame:
    """``output`` of each distinct text, or ``whole`` for long enough texts with copies, per document."""
    text = text_or_empty()
    key = F.unhex(F.md5(text.cast("binary"))).alias("key")
    arrow_rows(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks, layout = max(1, -(-total // CHUNK_BYTES)), Layout(length, max(1, -(-total // BLOCK_BYTES)))
    texts = docs.select(key, text.cast("binary").alias("raw")).mapInPandas(_first_seen, "key binary, raw binary")
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk")
    dealt = texts.select("key", "raw", chunk).repartition(chunks, "chunk")
    packed = "block int, chunk long, data binary, twice binary"

    def distinct(b: pd.DataFrame) -> pd.DataFrame:
        return b.drop_duplicates("key")

    def sample(b: pd.DataFrame) -> pd.DataFrame:
        b = distinct(b)
        return layout.packed(b["chunk"].iloc[0], [layout.names(layout.sums(raw))[1] for raw in b["raw"]])

    # Each answer is written, so the values that led to it need no room any more.
    names = materialize(_resolved(dealt.groupBy("chunk").applyInPandas(sample, packed), 0), "repeat-names")

    def reached(b: pd.DataFrame, answers: pd.DataFrame) -> list[tuple | None]:
        """For each text with marked sample positions, its sums and their longer names."""
        own = [layout.names(layout.sums(raw))[1] for raw in b["raw"]]
        marked = layout.marked(own, _answers(answers, 0))
        out = []
        for raw, found in zip(b["raw"], own):
            hit = _within(found, marked)
            if hit.any():
                sums = layout.sums(raw)
                out.append((sums, *layout.longer(sums, layout.names(sums)[0][hit])))
            else:
                out.append(None)
        return out

    def extended(b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame(columns=["block", "chunk", "data", "twice"])
        b = distinct(b)
        return layout.packed(b["chunk"].iloc[0], [x for f in reached(b, answers) if f for x in (f[2], f[4])])

    longer = materialize(_resolved(dealt.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInPandas(extended, packed), 1), "repeat-ranks")

    def candidates(b: pd.DataFrame, answers: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        """Candidate starts and their values, for each text."""
        found = reached(b, answers)
        marked = layout.marked([x for f in found if f for x in (f[2], f[4])], _answers(answers, 1))
        out = []
        for raw, f in zip(b["raw"], found):
            if f:
                sums, right, r, left, lv = f
                starts = layout.starts(sums, right[_within(r, marked)], left[_within(lv, marked)])
                out.append((starts, layout.windows(raw, sums, starts)))
            else:
                out.append((np.zeros(0, np.int64), np.zeros(0, WIDE)))
        return out

    def suffixes(b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame(columns=["block", "chunk", "data", "twice"])
        b = distinct(b)
        return layout.packed(b["chunk"].iloc[0], [w for _, w in candidates(b, answers)])

    both = names.unionAll(longer)
    windows = materialize(_resolved(dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(suffixes, packed), 2), "repeat-suffixes")

    def cut(b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = distinct(b)
        found = candidates(b, answers)
        marked = layout.marked([w for _, w in found], _answers(answers, 2))
        # Once for the chunk: the keys of wide values lie apart, and a search would copy them for each text.
        keys = _keys(marked)
        rows = [output(raw, covered(s[_within(w, marked, keys)], length)) for raw, (s, w) in zip(b["raw"], found)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in columns])
        out.insert(0, "key", b["key"].to_numpy() if len(b) else [])
        return out

    answers = both.unionAll(windows)
    per_text = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(cut, ", ".join(["key binary", *columns]))
    rows = docs.select("doc_id", key)
    copied = rows.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("copied"))
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    shown = [c.split()[0] for c in columns]
    results = per_text.join(copied, "key").select("key", *[F.when(gone, whole[n]).otherwise(F.col(n)).alias(n) if n in whole else n for n in shown])
    return rows.join(results, "key").select("doc_id", *shown)
