"""BM25 ranking of a batch of queries against a whole corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vankho.functions.text import LEGAL_LETTERS, tokens
from vankho.runtime import cut

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Queries of a block, most rows of a task, rows counted and scored at a time, queries whose best are kept at a time, most terms that are held with all rows.
QUERY_BLOCK, ROW_BLOCK, ROWS, TOGETHER, FULL = 10_000, 200_000, 10_000, 256, 1024
#: Most partial sums that are held, most rows scored exactly at a time, the share of rows (one in so many) from which a term is held with
#: all, and the queries from which a pair of terms is added up once for all.
DEPTH, PENDING, RARE, WORTH = 64, 20_000, 64, 16
#: Fixed value: joints that legal tokens lose at their ends.
JOINTS = "/._-"


def postings(corpus: DataFrame, kind: str = "a") -> DataFrame:
    """(id, length, term, tf) of corpus(id, text); texts without tokens give no row. A text's terms are counted where it lies: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            kinds = lists.flatten().dictionary_encode()
            width = max(1, len(kinds.dictionary))
            pair, tf = np.unique(owner * width + kinds.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, length = pa.array(pair // width), np.bincount(owner, minlength=batch.num_rows)
            columns = [batch.column(0).take(row), pa.array(length[pair // width].astype(np.int32)), kinds.dictionary.take(pa.array(pair % width)), pa.array(tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "length", "term", "tf"])

    return corpus.select("id", tokens(F.col("text"), kind).alias("t")).mapInArrow(run, "id bigint, length int, term string, tf bigint")


def bm25_scores(corpus: DataFrame, queries: DataFrame, kind: str = "a", digits: int = 4) -> DataFrame:
    """(query_id, id, score) of every document of corpus(id, text) that has a term of queries(query_id, text).

    Okapi weights; a negative weight becomes FLOOR times the mean weight of the vocabulary; query terms count as often as they occur.
    Scores are rounded to `digits` and ranked as such, ties go by id. Documents without any query term are not listed, nor queries
    without tokens. The index is written once; queries meet postings by term (a frequent term's partition is split by the engine's
    handling of skewed joins), and scores are added up before ranking.
    """
    index = cut(postings(corpus, kind))
    size = corpus.agg(F.count("*").alias("docs")).crossJoin(index.agg(F.sum("tf").alias("all"))).select("docs", (F.coalesce("all", F.lit(0)) / F.col("docs")).alias("mean"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    raw = cut(df.crossJoin(F.broadcast(size.select("docs"))).select("term", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"), kind)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighted = asked.join(idf, "term").join(index, "term").crossJoin(F.broadcast(size.select("mean")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return weighted.groupBy("query_id", "id").agg(F.round(F.sum(part), digits).alias("score"))


class _Letters:
    """Lower case of the characters that stand in tokens of a kind, as in `tokens`, else 0; for as many code points as texts have had so far."""

    def __init__(self, kind: str):
        self.kind, self.table = kind, np.zeros(0, np.uint32)

    def _lower(self, point: int) -> int:
        c = chr(point).lower()
        if self.kind == "c":
            held = "a" <= c <= "z" or "0" <= c <= "9" or c in LEGAL_LETTERS or c in JOINTS
        else:
            held = unicodedata.category(c[0])[0] in "LN" or (self.kind == "b" and c == "_")
        return ord(c) if held and len(c) == 1 else 0

    def of(self, points: np.ndarray) -> np.ndarray:
        most = int(points.max(initial=0)) + 1
        if most > len(self.table):
            self.table = np.concatenate([self.table, np.array([self._lower(i) for i in range(len(self.table), max(most, 1024))], np.uint32)])
        return self.table[points]


def _cut_out(texts: list[str], letters: _Letters) -> tuple[pa.Array, np.ndarray]:
    """The tokens of some rows, one after the other, and how many each row has."""
    joined = "\0".join(texts)
    if joined.count("\0") >= len(texts):
        joined = "\0".join(t.replace("\0", " ") for t in texts)
    if "\u0130" in joined or "\u03a3" in joined:  # these two are not lowered one by one
        joined = joined.lower()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    low = letters.of(points)
    held = np.concatenate([[False], low > 0, [False]])
    edge = np.flatnonzero(held[1:] != held[:-1])
    start, size = edge[::2], np.diff(edge)[::2]
    counts = np.diff(np.searchsorted(start, np.append(np.flatnonzero(points == 0), len(points))), prepend=0)
    low = low[held[1:-1]]
    width = np.ones(len(low), np.int8)
    for least in (0x80, 0x800, 0x10000):
        width += low >= least
    offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int32)[np.cumsum(size) - 1]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low.tobytes().decode("utf-32-le").encode())), counts


def _tokens(text: pa.Array, letters: _Letters) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens of all rows as codes with their dictionary, and the row of each; the same as `tokens` finds."""
    texts = pc.fill_null(text, "").to_pylist()
    pieces = [_cut_out(texts[i : i + 500], letters) for i in range(0, len(texts), 500)]  # as many as stay in a core's cache
    kinds = pa.concat_arrays([p for p, _ in pieces]).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.concatenate([n for _, n in pieces]))
    terms, code = kinds.dictionary, kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if letters.kind == "c":
        again = pc.utf8_trim(terms, characters=JOINTS).dictionary_encode()
        terms, code = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
        real = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)
        owner, code = owner[real[code]], (np.cumsum(real) - 1)[code[real[code]]]
        terms = terms.filter(pa.array(real))
    return terms, code, owner


#: Rows with their tokens counted. ids (int64) and lengths and kinds (int32) by row; code and tf by row and kind of token, in order of
#: both, in as few bytes each as hold them; terms by code, with the rows and tokens that have it.
_BLOCK = "part int, number int, docs bigint, ids binary, lengths binary, kinds binary, code binary, tf binary, terms array<string>, df array<bigint>, total array<bigint>"


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}" if n else "u1")


def _blocked(size: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of at most `size` rows, from batches of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, letters = 0, _Letters(kind)
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                terms, token, owner = _tokens(batch.column(1), letters)
                width, rows = max(1, len(terms)), batch.num_rows
                key = np.sort(owner * width + token)
                first = np.flatnonzero(np.diff(key, prepend=-1))
                tf, (row, code) = np.diff(first, append=len(key)), np.divmod(key[first], width)
                df, total = (np.bincount(x, minlength=len(terms)).astype(np.int64) for x in (code, token))
                lengths, kinds = (np.bincount(x, minlength=rows).astype(np.int32) for x in (owner, row))
                cells = [batch.column(0).to_numpy().astype(np.int64).tobytes(), lengths.tobytes(), kinds.tobytes(), _narrow(code), _narrow(tf)]
                columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([rows], pa.int64()), *(pa.array([x], pa.binary()) for x in cells)]
                columns += [pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), x) for x in (terms, pa.array(df), pa.array(total))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "docs", "ids", "lengths", "kinds", "code", "tf", "terms", "df", "total"])
                number += 1

    return run


def _asked(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, term) for every token of batches of (query_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters(kind)
        for batch in batches:
            if batch.num_rows:
                terms, code, owner = _tokens(batch.column(1), letters)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), terms.take(pa.array(code))], names=["query_id", "term"])

    return run


class _Best:
    """The k best rows of each query of a block, while blocks of rows come in any order."""

    def __init__(self, words: pa.Array, weights: pa.Array, mean: float, k: int, digits: int):
        lists = pc.split_pattern(words, " ")
        sizes = np.diff(lists.offsets.to_numpy())
        owner, kinds = np.repeat(np.arange(len(words)), sizes), lists.flatten().dictionary_encode()
        self.vocabulary, term = kinds.dictionary, kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        weight = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        # a column is a term with a weight; a query's come in order of how many queries have them, so that beginnings are shared
        values, place = np.unique(weight, return_inverse=True)
        pairs, column, uses = np.unique(term * len(values) + place, return_inverse=True, return_counts=True)
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(-uses, kind="stable")] = np.arange(len(pairs))
        pairs = pairs[np.argsort(-uses, kind="stable")]
        self.term_of, self.weight_of = pairs // max(1, len(values)), values[pairs % max(1, len(values))]
        order = np.lexsort((rank[column], owner))
        self.column = rank[column][order]
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.mean, self.k, self.unit = mean, k, 10.0**digits
        n = len(words)
        self.columns = [x.tolist() for x in np.split(self.column, self.start[1:-1])]
        self.sums, self.pairs = self._shared(n, owner, rank[column], len(pairs))
        self.order = sorted(range(n), key=self.sums.__getitem__)
        self.positive = np.ones(n, bool)
        np.logical_and.at(self.positive, owner, weight > 0)
        # what adding up in single precision and rounding can change, twice
        bound = np.bincount(owner, np.abs(weight), minlength=n) * (K1 + 1)
        self.slack = 2 * ((sizes + 2) * 2.0**-23 * bound + 1 / self.unit)
        self.score, self.id, self.count = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def _shared(self, n: int, owner: np.ndarray, column: np.ndarray, count: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
        """Columns of each query where pairs that many queries have are one column more, and these pairs; columns are numbered by use."""
        most = min(count, FULL // 2)
        held = np.zeros((n, most), bool)
        held[owner[column < most], column[column < most]] = True
        number, pairs = np.arange(most), []
        while held.shape[1] < FULL:
            sample = held[:: max(1, n // 2000)].astype(np.float32)
            both = np.triu(sample.T @ sample, 1).ravel()
            top = np.argpartition(-both, min(400, len(both)) - 1)[:400] if len(both) else []
            used, new = set(), []
            for x in sorted(top, key=lambda x: -both[x]):
                a, b = divmod(int(x), held.shape[1])
                if both[x] * n < WORTH * len(sample) or a in used or b in used:
                    continue
                used |= {a, b}
                new.append(held[:, a] & held[:, b])
                pairs.append((int(number[a]), int(number[b])))
                held[new[-1], a] = held[new[-1], b] = False
            if not new:
                break
            number = np.append(number, np.arange(count + len(pairs) - len(new), count + len(pairs)))
            held = np.column_stack([held, *new])
        uses = held.sum(0)
        order = np.argsort(-uses, kind="stable")
        row, at = np.nonzero(held[:, order])
        rest = column >= most
        row, at = np.concatenate([row, owner[rest]]), np.concatenate([number[order][at], column[rest]])
        rows = np.argsort(row, kind="stable")
        return [x.tolist() for x in np.split(at[rows], np.cumsum(np.bincount(row, minlength=n))[:-1])], pairs

    def add(self, block: dict[str, pa.Scalar]) -> None:
        ids, lengths, kinds = (np.frombuffer(block[n].as_py(), t) for n, t in (("ids", np.int64), ("lengths", np.int32), ("kinds", np.int32)))
        terms, rows, entries = block["terms"].values, len(ids), int(kinds.sum())
        width = max(1, len(terms))
        row, code, tf = np.repeat(np.arange(rows), kinds), _wide(block["code"].as_py(), entries), _wide(block["tf"].as_py(), entries).astype(np.float64)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / self.mean))
        order, place = np.argsort(code, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(code, minlength=width))])
        local = pc.fill_null(pc.index_in(self.vocabulary, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code_of = local[self.term_of]
        uses = np.where(code_of < 0, 0, np.diff(place)[code_of])
        held: list = [None] * len(uses)
        for c in np.flatnonzero(uses):
            own = order[place[code_of[c]] : place[code_of[c] + 1]]
            held[c] = row[own], (self.weight_of[c] * part[own]).astype(np.float32)
        # frequent columns are full rows of a matrix, the others are added posting by posting
        full: list = [None] * len(uses)
        for c in np.flatnonzero(uses * RARE >= rows)[:FULL]:
            full[c] = np.zeros(rows, np.float32)
            full[c][held[c][0]] = held[c][1]
        for a, b in self.pairs:
            if held[a] is None or held[b] is None:
                a = b if held[a] is None else a
                held.append(held[a])
                full.append(full[a])
                continue
            both = np.zeros(rows, np.float32) if full[a] is None else full[a].copy()
            for c in (b,) if full[a] is not None else (a, b):
                if full[c] is not None:
                    both += full[c]
                else:
                    both[held[c][0]] += held[c][1]
            held.append(())
            full.append(both)
        exact = {"key": (row * width + code).astype(np.int32 if rows * width < 1 << 31 else np.int64), "part": part, "code_of": code_of, "width": width, "ids": ids}
        # all rows' scores are added up in single precision, those that may be among the best exactly
        spare = np.zeros((DEPTH + 2, rows), np.float32)
        level, before, some, pending = [spare[0]] * (DEPTH + 2), [], [], 0
        for q in self.order:
            columns, n = self.sums[q], 0
            most = min(len(before), len(columns), DEPTH)
            while n < most and before[n] == columns[n]:
                n += 1
            now = level[n]
            for i in range(n, len(columns)):
                c, at = columns[i], min(i, DEPTH) + 1
                if full[c] is not None:
                    now = np.add(now, full[c], out=spare[at])
                elif held[c] is not None:
                    if now is not spare[at]:
                        np.copyto(spare[at], now)
                    now = spare[at]
                    now[held[c][0]] += held[c][1]
                level[at] = now
            before = columns
            low = 0.0
            if not self.positive[q]:
                asked = np.zeros(rows, bool)
                for c in self.columns[q]:
                    if held[c] is not None:
                        asked[held[c][0]] = True
                now, low = np.where(asked, now, np.float32(-np.inf)), -np.inf
            if self.count[q] == self.k:
                low = max(low, self.score[q, -1] - self.slack[q])
            elif rows > self.k:
                low = max(low, float(np.partition(now, rows - self.k)[rows - self.k]) - 2 * self.slack[q])
            found = (now > np.float32(low)).nonzero()[0]
            if len(found):
                some.append((q, found))
                pending += len(found)
            if len(some) == TOGETHER or pending > PENDING:
                self._keep(some, **exact)
                some, pending = [], 0
        if some:
            self._keep(some, **exact)

    def _keep(self, some: list[tuple[int, np.ndarray]], key: np.ndarray, part: np.ndarray, code_of: np.ndarray, width: int, ids: np.ndarray) -> None:
        asked, sizes = np.array([q for q, _ in some]), np.array([len(r) for _, r in some])
        group, row = np.repeat(np.arange(len(some)), sizes), np.concatenate([r for _, r in some])
        query = asked[group]
        first, terms = self.start[query], self.start[query + 1] - self.start[query]
        begin = np.cumsum(terms) - terms
        column = self.column[np.arange(terms.sum()) + np.repeat(first - begin, terms)]
        code = code_of[column]
        wanted = (np.repeat(row, terms) * width + code).astype(key.dtype)
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        value = np.add.reduceat(np.where((code >= 0) & (key[at] == wanted), self.weight_of[column] * part[at], 0.0), begin) * self.unit
        value = np.copysign(np.floor(np.abs(value) + 0.5), value) / self.unit + 0.0  # no negative zero
        old, place = np.nonzero(np.arange(self.k) < self.count[asked][:, None])
        group, score, found = np.concatenate([old, group]), np.concatenate([self.score[asked[old], place], value]), np.concatenate([self.id[asked[old], place], ids[row]])
        order = np.lexsort((found, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        order, group, place = order[place < self.k], group[place < self.k], place[place < self.k]
        self.score[asked[group], place], self.id[asked[group], place] = score[order], found[order]
        self.count[asked] = np.bincount(group, minlength=len(asked))


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 10, kind: str = "a", digits: int = 4) -> DataFrame:
    """(query_id, id, score, rank): the k best of corpus(id, text) for each of queries(query_id, text), with the scores of `bm25_scores`.

    Tokens are counted once and written in blocks of rows. A task takes some blocks of rows and one of queries, adds up the scores of a
    block as arrays, with partial sums shared by queries that have the same terms, and keeps k rows per query, so that no score is shuffled.
    """
    spark, kind_of = corpus.sparkSession, dict(queries.dtypes)["query_id"]
    blocks = cut(corpus.select("id", "text").mapInArrow(_blocked(ROWS, kind), _BLOCK))
    docs, parts = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    vocabulary = blocks.select(F.inline(F.arrays_zip("terms", "df", "total"))).groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"), F.sum("total").alias("tf"))
    vocabulary = cut(vocabulary)
    raw = vocabulary.select("term", "tf", F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    total, mean_idf = raw.agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.avg("idf"), F.lit(0.0))).first()
    idf = raw.select("term", F.when(F.col("idf") < 0, FLOOR * F.lit(mean_idf)).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("query_id", "text").mapInArrow(_asked(kind), f"query_id {kind_of}, term string").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    known = asked.join(idf, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("weight"))).alias("all"))
    known = cut(known.select("query_id", F.array_join("all.term", " ").alias("words"), F.col("all.weight").alias("weights")))
    # few bytes but much work: tasks take no more rows than lets every core have some
    tasks = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    query_blocks = max(1, -(-known.count() // QUERY_BLOCK))
    row_blocks = max(1, -(-docs // ROW_BLOCK), min(-(-tasks // query_blocks), docs // ROWS))
    spread = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = (F.col("qb") * row_blocks + F.col("rb")).alias("pair")
    left = known.select("*", spread.alias("qb"), every(row_blocks).alias("rb")).select(pair, "query_id", "words", "weights")
    right = blocks.where(F.size("terms") > 0).select("*", ((F.col("number") * parts + F.col("part")) % row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    right = right.select(pair, "ids", "lengths", "kinds", "code", "tf", "terms")
    met = left.unionByName(right, allowMissingColumns=True).repartitionById(row_blocks * query_blocks, "pair").sortWithinPartitions(F.col("weights").isNull()).drop("pair")
    mean = float(total) / max(docs, 1)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, best = [], None
        for batch in batches:
            asks = pc.is_valid(batch.column("weights"))
            if best is None:
                lists.append(batch.select(["query_id", "words", "weights"]).filter(asks))
            rows = batch.filter(pc.invert(asks))
            if rows.num_rows and best is None:
                table = pa.Table.from_batches(lists).combine_chunks()
                if not table.num_rows:
                    return
                lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (table.column(n).combine_chunks() for n in ("query_id", "words", "weights"))]
                best = _Best(lists[1], lists[2], mean, k, digits)
            for i in range(rows.num_rows):
                best.add({n: rows.column(n)[i] for n in ("ids", "lengths", "kinds", "code", "tf", "terms")})
        if best is not None:
            query, place = np.nonzero(np.arange(k) < best.count[:, None])
            yield pa.RecordBatch.from_arrays([lists[0].take(pa.array(query)), pa.array(best.id[query, place]), pa.array(best.score[query, place])], names=["query_id", "id", "score"])

    near = met.mapInArrow(ranked, f"query_id {kind_of}, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def bm25_every(corpus: DataFrame, queries: DataFrame, k: int = 10, kind: str = "a") -> DataFrame:
    """(query_id, id, score, rank): as `bm25`, but ordered by unrounded scores (ten digits), and documents without a query term follow
    with score 0 by id, so that every query with tokens has k results where the corpus has as many."""
    # all the scored ones of a query that has fewer than k
    scored = cut(bm25(corpus, queries, k, kind, 10).drop("rank"))
    # at most k - 1 of the first 2k ids can be among the scored ones of a query that needs more
    first = corpus.select("id").orderBy("id").limit(2 * k)
    asked = queries.where(F.size(tokens(F.col("text"), kind)) > 0).select("query_id")
    few = asked.join(scored.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    rest = few.crossJoin(F.broadcast(first)).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(0.0).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.unionByName(rest).withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.round("score", 4))
