"""Exact cosine search of a set of query vectors against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, and rows of a corpus block.
QUERY_BLOCK, ROW_BLOCK = 2000, 20_000


def cosine_top(corpus: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of corpus(id, vector) for each of queries(query_id, vector), by 1 - cosine.

    Distances are rounded to six digits, ties go by id. Null vectors and vectors of zeros take no part. Both sides are cut into
    blocks; each pair of blocks is one matrix product in one task that keeps k rows per query, so nothing is broadcast and no task
    holds more than two blocks.
    """
    ok = lambda c: F.coalesce(F.exists(c, lambda x: F.abs(x) > 1e-9), F.lit(False))
    rows = corpus.where(ok("vector")).select("id", "vector")
    asked = queries.where(ok("vector")).select("query_id", F.col("vector").alias("query"))
    counts = rows.agg(F.count("*").alias("n")).collect()[0].n, asked.agg(F.count("*").alias("n")).collect()[0].n
    row_blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(counts, (row_block, query_block)))
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = asked.select("*", spread("query_id", query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    right = rows.select("*", spread("id", row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        return m / np.sqrt((m * m).sum(1, keepdims=True))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
        distance = np.round(1 - matrix(a.column("query")) @ matrix(b.column("vector")).T, 6) + 0.0  # no negative zero
        ids, owner = b.column("id").to_numpy(), a.column("query_id").to_numpy()
        keep = min(k, len(ids))
        # all rows as near as the k-th stay, so that ties go by id and not by place
        limit = np.partition(distance, keep - 1, axis=1)[:, keep - 1 : keep]
        q, r = np.nonzero(distance <= limit)
        return pa.table({"query_id": owner[q], "id": ids[r], "distance": distance[q, r]})

    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(product, "query_id bigint, id bigint, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
