"""Packing by first-fit decreasing with a tournament tree of bin capacities.

``pieces`` tokenizes each document and cuts it every ``size`` ids. ``pack`` deals the pieces at
random into even groups and packs each group on its own: longest piece first, each into the
first bin with room, found by descending a tree that holds the largest free capacity below
every node. Even dealing does not look at keys, so equal ids or texts cannot make a large
group; sorting by a hash inside a partition makes a rerun give the same sequences.

Defined cases: a null or empty text is only the end id; a null doc_id keeps its own piece rows;
repeated rows are packed as often as they occur; very long documents give many full pieces,
each a sequence of its own; an empty table gives an empty result; further columns of the
pieces travel along unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty
from .tokens import encoder, vocabulary_path

SIZE = 2048
END_ID = 1
#: Pieces packed together. Memory of a task is bounded by it; padding falls as it grows.
GROUP = 16384


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian unsigned 32 bits) of each piece."""
    arrow_rows(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*encode(text), end_id], "<u4")
                rows += [(doc_id, s, min(size, len(ids) - s), len(ids), ids[s : s + size].tobytes()) for s in range(0, len(ids), size)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
            out["doc_id"] = out["doc_id"].astype(b["doc_id"].dtype)
            yield out

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(
        cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    )


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ``lengths`` is in decreasing order."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [size] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins[k], offsets[k] = node - leaves, size - room[node]
        room[node] -= n
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``size`` ids.

    ``n_pieces``, the number of rows, sets how many partitions they are dealt to.
    """
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "sequence_id long, offset long"])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 33
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            nonlocal first
            b = pd.concat(held, ignore_index=True)
            b = b.iloc[np.argsort(-b["length"].to_numpy(), kind="stable")]
            bins, offsets = first_fit_decreasing(b["length"].to_numpy(), size)
            out = b.assign(sequence_id=first + bins, offset=offsets)
            first += int(bins.max()) + 1
            held.clear()
            return out

        n = 0
        for b in batches:
            while len(b):
                part, b = b.iloc[: group - n], b.iloc[group - n :]
                held.append(part)
                n += len(part)
                if n == group:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    even = pieces.select(*[f"`{n}`" for n in names]).repartition(max(1, -(-n_pieces // group)))
    # Rows that tie in all columns are alike, so their order does not matter.
    order = F.xxhash64(*[f"`{n}`" for n in names])
    return even.sortWithinPartitions(order, "doc_id", "start").mapInPandas(packed, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of :func:`pack`'s pieces (with ids): sequence_id, n_tokens, doc_ids, starts, lengths and token_ids.

    The lists go by offset; token_ids are little-endian unsigned 32-bit ids without padding. A
    sequence's pieces are in one partition already and hold no more than its size, so each is
    put together where it was packed.
    """
    kind = dict(packed.dtypes)["doc_id"]

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for b in batches:
            b = pd.concat([held, b], ignore_index=True) if len(held) else b
            # The last sequence may go on in the next batch.
            held = b[b["sequence_id"] == b["sequence_id"].iloc[-1]]
            done = b[b["sequence_id"] != b["sequence_id"].iloc[-1]]
            if len(done):
                yield whole(done)
        if len(held):
            yield whole(held)

    def whole(b: pd.DataFrame) -> pd.DataFrame:
        groups = b.groupby("sequence_id", sort=False)
        return pd.DataFrame(
            {
                "sequence_id": list(groups.groups),
                "n_tokens": groups["length"].sum().to_numpy(),
                "doc_ids": [list(x) for _, x in groups["doc_id"]],
                "starts": [list(x) for _, x in groups["start"]],
                "lengths": [list(x) for _, x in groups["length"]],
                "token_ids": [b"".join(x) for _, x in groups["ids"]],
            }
        )

    ordered = packed.select("doc_id", "start", "length", "ids", "sequence_id", "offset").sortWithinPartitions("sequence_id", "offset")
    return ordered.mapInPandas(joined, f"sequence_id long, n_tokens long, doc_ids array<{kind}>, starts array<long>, lengths array<long>, token_ids binary")
