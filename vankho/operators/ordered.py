"""Ordered operations within a key that stay spread when one key holds a large part of all rows.

A key's rows are cut into blocks of consecutive places. Work within a block is a window over (key, block); what passes from block
to block is one row per block, so the window over a key sees its blocks and never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def forward_fill(df: DataFrame, keys: list[str], place: str, value: str, out: str, block: int = BLOCK, own: bool = True) -> DataFrame:
    """`df` with `out`: the last non-null `value` at or before each row (own=False: before it) in order of the integer column `place`."""
    df = df.withColumn("_block", F.floor(F.col(place) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    filled = df.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    last = df.where(F.col(value).isNotNull()).groupBy(*keys, "_block").agg(F.max_by(value, place).alias("_last"))
    blocks = df.select(*keys, "_block").distinct().join(last, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return filled.join(carried, [*keys, "_block"]).withColumn(out, F.coalesce("_own", "_carried")).drop("_block", "_own", "_carried")


def running_total(df: DataFrame, keys: list[str], place: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """`df` with `out`: the sum of `value` over all earlier rows of the key, this one left out."""
    df = df.withColumn("_block", F.floor(F.col(place) / block)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    own = df.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return own.join(carried, [*keys, "_block"]).withColumn(out, F.col("_own") + F.col("_carried")).drop("_block", "_value", "_own", "_carried")


def following(df: DataFrame, keys: list[str], place: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """`df` with `out`: `value` of the next row of the key; null for its last row. Places are distinct within a key."""
    df = df.withColumn("_block", F.floor(F.col(place) / block))
    own = df.withColumn("_own", F.lead(value).over(Window.partitionBy(*keys, "_block").orderBy(place)))
    first = df.groupBy(*keys, "_block").agg(F.min_by(value, place).alias("_first"), F.max(place).alias("_end"))
    after = first.select(*keys, "_block", "_end", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_next"))
    joined = own.join(after, [*keys, "_block"])
    return joined.withColumn(out, F.when(F.col(place) == F.col("_end"), F.col("_next")).otherwise(F.col("_own"))).drop("_block", "_own", "_end", "_next")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in `order`; a partial aggregation, so a key with many rows is no hot spot."""
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    return df.groupBy(*keys).agg(F.max(packed).alias("_m")).select("_m.row.*")


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in `order`."""
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    return df.groupBy(*keys).agg(F.min(packed).alias("_m")).select("_m.row.*")


def greedy_windows(df: DataFrame, keys: list[str], place: str, size: str, most: int, gap: int) -> DataFrame:
    """`df` with `window` (from 1): consecutive rows of a key packed while their sizes, with `gap` between, stay within `most`.

    A row larger than `most` has a window of its own. Where a row falls depends on all before it, so the rows of a key pass through one
    task in order; only the running size is kept, and no key is collected.
    """
    flow = df.repartition(*keys).sortWithinPartitions(*keys, place)
    at = [df.columns.index(k) for k in keys], df.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window, used = None, 0, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            rows = zip(zip(*[batch.column(i).to_pylist() for i in at[0]]), batch.column(at[1]).to_pylist())
            for i, (key, n) in enumerate(rows):
                if key != last:
                    last, window, used = key, 1, n
                elif used + gap + n <= most:
                    used += gap + n
                else:
                    window, used = window + 1, n
                out[i] = window
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "window"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return flow.mapInArrow(run, f"{fields}, window bigint")
