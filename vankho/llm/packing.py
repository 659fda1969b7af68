"""Filling fixed-capacity containers (problem 6): token counts, then sum-of-squares packing in shards.

A text longer than the capacity is cut into full containers and one rest; no other text is cut. Shards of bounded size are packed
each in one task, so the work is spread whatever the number of texts, and a shard of many thousands leaves little open.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vankho.runtime import cut

CAPACITY = 8192
SHARD = 40_000
#: Entries of a task's table of counted pieces; it is emptied beyond that.
REMEMBERED = 1_000_000


@cache
def _encoder(path: str | None):
    """The tokenizer at `path` (a .tiktoken file), else byte_bpe_50k of the installed vocabularies, and its pattern for pieces."""
    import public_tokenizers as P
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path or P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(P.PATTERN)


class _Counts(dict):
    """Tokens of a piece, counted once: the encoder merges within a piece only, so counts of pieces add up."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = len(self.encoder.encode_ordinary(piece))
        self[piece] = n
        return n


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens); a null text or doc_id has no row, an empty text 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pattern = _encoder(tokenizer)
        known = _Counts(encoder)
        count, pieces = known.__getitem__, pattern.findall
        for batch in batches:
            sizes = [sum(map(count, pieces(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, in the given order: where the sum of squared counts of open containers per gap becomes least.

    Ties go to the smallest gap; items without size lie in the container opened last.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            out[i] = max(opened - 1, 0)
            opened = max(opened, 1)
            continue
        # moving a container from gap g to g - s changes the sum by 2 (N[g-s] - N[g] + 1); a container that becomes full leaves
        gaps = np.flatnonzero(count[s:]) + s
        new = count[capacity - s] + 0.5 if s < capacity else 0.0
        g = capacity
        if len(gaps):
            change = count[gaps - s] - count[gaps] + 1.0
            if gaps[0] == s:
                change[0] = 0.5 - count[s]
            best = int(change.argmin())
            if change[best] <= new:
                g = int(gaps[best])
        if g == capacity:
            b = opened
            opened += 1
        else:
            b = bins[g].pop()
            count[g] -= 1
        rest = g - s
        if rest:
            bins[rest].append(b)
            count[rest] += 1
        out[i] = b
    return out


def pack(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """(shard, container, doc_id, piece, n_tokens): every document's container, numbered within its shard.

    Documents longer than `capacity` have several pieces (from 1): full ones, each alone in a container, and a packed rest.
    """
    sizes = cut(token_counts(documents, tokenizer))
    shards = max(1, -(-sizes.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        which = table.column("shard")[0].as_py()
        order = np.lexsort((table.column("doc_id").to_numpy(), table.column("mix").to_numpy()))
        doc, size = table.column("doc_id").to_numpy()[order], table.column("n_tokens").to_numpy()[order]
        full = np.where(size > capacity, (size - 1) // capacity, 0)
        rest = size - full * capacity
        place = sum_of_squares(rest, capacity)
        first = int(place.max()) + 1
        whole = np.repeat(np.arange(len(doc)), full)
        part = np.arange(len(whole)) - np.repeat(np.concatenate([[0], np.cumsum(full)[:-1]]), full) + 1
        columns = [
            np.full(len(doc) + len(whole), which, np.int64),
            np.concatenate([place, first + np.arange(len(whole))]),
            np.concatenate([doc, doc[whole]]),
            np.concatenate([full + 1, part]),
            np.concatenate([rest, np.full(len(whole), capacity)]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "container", "doc_id", "piece", "n_tokens"])

    mixed = sizes.withColumn("mix", F.xxhash64("doc_id")).withColumn("shard", F.pmod("mix", F.lit(shards)))
    # by number, so that small shards are not put together in one task
    return mixed.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "shard bigint, container bigint, doc_id bigint, piece bigint, n_tokens bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per shard: containers, tokens, share of the space that is used."""
    each = packed.groupBy("shard", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    return each.groupBy("shard").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count("*") * capacity), 4).alias("used"))
