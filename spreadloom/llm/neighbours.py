"""Nearest neighbours by additive quantisation: every vector is the sum of one codeword from each of ``BOOKS`` codebooks.

* ``fit`` learns the full-dimensional residual codebooks by k-means, one after the other, on a bounded sample, the
  ``SAMPLE`` vectors with the smallest hash of their id. The codebooks have a fixed size and go to all tasks.
* A coarse level splits the rows into lists around centres learned from the same sample, one list for every ``BLOCK`` rows,
  ``LISTS`` at most. ``probes`` measures on the sample, by brute force, how many of a query's nearest lists hold the
  ``COVERED`` share of its true neighbours; so many are visited. Where vectors do not cluster that may be all of them.
* ``index`` encodes every vector by beam search over the codebooks (the ``BEAM`` best partial sums go on) and stores the
  codes, the squared norm (for the Euclidean order) and the vector. A list is cut into blocks of about ``BLOCK`` rows by the
  row's number, so that neither copies nor rows of one id meet in one block.
* ``search`` sends each query to each block of its lists once. A task holds one block and streams the queries past it: a
  table of the query's products with all codewords scores the block by lookups, the ``DEPTH`` best are scored anew on the
  original vectors in double precision, and the block's best go on. A vector that many rows share counts once in that
  depth: of its rows only the 2k with the smallest ids can be among the k nearest, and only these are held, so a vector
  that a third of all rows share does no harm. What is ranked at last is ``k`` rows of each block and query.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part, as queries or candidates, and neither do rows with a null id; rows of one id are all candidates of others and
none of its own, and of different vectors of one id the smallest, in the order of arrays, asks; ties go to the smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, materialise

BOOKS, WORDS, BEAM = 16, 256, 4
SAMPLE = 8192
BLOCK = 16_384
DEPTH = 512
QUERIES = 64
#: Lists at most, and the share of true neighbours that the visited ones must hold in the sample.
LISTS, COVERED = 512, 0.98


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.cast(kind).alias("vector")).where(F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """As single or double precision, as the column is."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1)[None, :] - 2 * points @ words.T, axis=1)


def fit(points: np.ndarray, books: int = BOOKS, words: int = WORDS, turns: int = 6, seed: int = 9) -> np.ndarray:
    """(books, words, dimensions): each book by k-means on what the books before leave over."""
    rng, rest, out = np.random.default_rng(seed), points.astype(np.float32), []
    words = max(1, min(words, len(points) // 4))
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)]
        for _ in range(turns):
            at = nearest(rest, centres)
            counts = np.bincount(at, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, rest)
            fresh = rest[rng.choice(len(rest), words)]
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], fresh).astype(np.float32)
        rest = rest - centres[nearest(rest, centres)]
        out.append(centres)
    return np.stack(out)


def encode(points: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search."""
    n, (m, k, d) = len(points), books.shape
    rest, codes = points.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for words in books:
        b = rest.shape[1]
        errors = (rest**2).sum(2)[:, :, None] + (words**2).sum(1) - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, b, k)
        flat, keep = errors.reshape(n, b * k), min(beam, b * k)
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        # the order of a beam does not matter until the end, where its first is taken
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        source, word = best // k, best % k
        rest = np.take_along_axis(rest, source[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0]


def reach(points: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """The lists of each query, nearest first."""
    near = points.astype(np.float32) @ centres.T
    if metric == "l2":
        near = 2 * near - (centres**2).sum(1)
    return np.argsort(-near, axis=1, kind="stable")


def probes(points: np.ndarray, centres: np.ndarray, k: int, metric: str, asked: int = 512) -> int:
    """The least number of lists that hold the share ``COVERED`` of the ``k`` nearest of queries drawn from the sample."""
    some = points[:: max(1, len(points) // asked)].astype(np.float32)
    scores = some @ points.astype(np.float32).T
    if metric == "l2":
        scores = 2 * scores - (points.astype(np.float32) ** 2).sum(1)
    top = np.argpartition(-scores, min(k, len(points) - 1), axis=1)[:, : k + 1]
    order = reach(some, centres, metric)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), 1)
    found = np.sort(np.take_along_axis(place, nearest(points.astype(np.float32), centres)[top], 1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(COVERED * len(found))))]) + 1


def index(rows: DataFrame, books: np.ndarray, centres: np.ndarray) -> DataFrame:
    """(list, vec_id, vector, codes, norm) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                points = matrix(batch.column("vector"))
                codes, norms = encode(points, books), (points.astype(float) ** 2).sum(1)
                lists = nearest(points.astype(np.float32), centres).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column("vec_id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], ["list", "vec_id", "vector", "codes", "norm"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"list int, vec_id long, vector {kind}, codes binary, norm double")


class Block:
    """One block of the index in memory: its different vectors, and of each the rows that can be among the ``k`` nearest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, metric: str, k: int):
        same = np.unique(vectors, axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        ids, same = ids[order], same[order]
        # a query's own id may take k of a vector's 2k rows
        fresh = np.concatenate([[True], (same[1:] != same[:-1]) | (ids[1:] != ids[:-1])])
        copy = np.arange(len(ids)) - np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        ids, same, order = ids[copy < k], same[copy < k], order[copy < k]
        heads = np.concatenate([[True], same[1:] != same[:-1]])
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(heads, np.arange(len(ids)), 0))
        ids, same, order = ids[place < 2 * k], same[place < 2 * k], order[place < 2 * k]
        heads = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        self.ids, self.starts, self.counts = ids, heads, np.diff(np.append(heads, len(ids)))
        first = order[heads]
        self.vectors, self.norms = vectors[first], norms[first]
        self.codes, self.books, self.metric = np.ascontiguousarray(codes[first].T), books, metric

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids, scores): up to ``k`` of each query."""
        scores = np.zeros((len(ids), len(self.starts)), np.float32)
        for words, codes in zip(self.books, self.codes, strict=True):
            scores += (queries.astype(np.float32) @ words.T)[:, codes]
        if self.metric == "l2":
            scores = 2 * scores - self.norms[None, :].astype(np.float32)
        found = []
        for q, row in enumerate(scores):
            if len(row) > depth:
                least = np.partition(row, len(row) - depth)[len(row) - depth]
                above = np.flatnonzero(row > least)
                at = np.concatenate([above, np.flatnonzero(row == least)[: depth - len(above)]])
            else:
                at = np.arange(len(row))
            # sums from left to right, as a plain loop adds them
            exact = np.cumsum(self.vectors[at].astype(float) * queries[q].astype(float), axis=1)[:, -1]
            if self.metric == "l2":
                exact = 2 * exact - self.norms[at]
            counts = self.counts[at]
            rows = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            near, names = np.repeat(exact, counts), self.ids[rows]
            other = names != ids[q]
            near, names = near[other], names[other]
            order = np.lexsort((names, -near))[:k]
            found.append((np.full(len(order), ids[q]), names[order], near[order]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(indexed: DataFrame, queries: DataFrame, books: np.ndarray, centres: np.ndarray, visited: int, k: int, depth: int = DEPTH, block_rows: int = BLOCK, metric: str = "ip") -> DataFrame:
    """(query_id, rank, vec_id, score), nearest first. ``indexed`` is a written table."""
    # one row for each list, LISTS at most
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    counts = np.array([-(-sizes.get(c, 0) // block_rows) for c in range(len(centres))], np.int64)
    starts, blocks = np.cumsum(counts) - counts, max(1, int(counts.sum()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = reach(matrix(batch.column("vector")), centres, metric)[:, :visited]
            n = counts[lists].sum(1)
            to = np.concatenate([np.concatenate([np.arange(starts[c], starts[c] + counts[c]) for c in row]) for row in lists])
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column("vec_id").take(at), batch.column("vector").take(at)], ["block", "vec_id", "vector"])

    kind = queries.schema["vector"].dataType.simpleString()
    sent = queries.select("vec_id", "vector").mapInArrow(send, f"block int, vec_id long, vector {kind}")
    sent = sent.select("block", F.lit(1).alias("kind"), "vec_id", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"))
    table = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(max(1, int(n))).alias("n")) for a, n in zip(starts, counts, strict=True)])
    own = F.get(table, F.col("list"))
    numbered = indexed.withColumn("block", (own["a"] + F.pmod(F.monotonically_increasing_id(), own["n"])).cast("int"))
    both = numbered.select("block", F.lit(0).alias("kind"), "vec_id", "vector", "codes", "norm").unionByName(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None
        for whole in batches:
            kinds = whole.column("kind").to_numpy()
            split = int(np.searchsorted(kinds, 1))
            if split:
                held.append(whole.slice(0, split))
            if not held:
                continue
            for lo in range(split, whole.num_rows, QUERIES):
                if block is None:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                    block = Block(rows.column("vec_id").to_numpy(), matrix(rows.column("vector")), codes, rows.column("norm").to_numpy(), books, metric, k)
                some = whole.slice(lo, QUERIES)
                q, ids, scores = block.best(some.column("vec_id").to_numpy(), matrix(some.column("vector")), k, depth)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    dealt = both.repartitionById(blocks, "block").sortWithinPartitions("kind", "vec_id")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", depth: int = DEPTH, block_rows: int = BLOCK, metric: str = "ip", all_lists: bool = False) -> DataFrame:
    """The ``k`` nearest rows of each row for which ``is_query``, an expression over ``vec_id``, holds.

    ``all_lists`` visits every list, and with a ``depth`` of ``block_rows`` every score is exact.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = matrix(sample)
    books = fit(points)
    centres = fit(points, 1, min(LISTS, -(-rows.count() // block_rows)))[0]
    visited = len(centres) if all_lists else probes(points, centres, k, metric)
    indexed = materialise(index(rows, books, centres), "codes")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return search(indexed, queries, books, centres, visited, k, depth, block_rows, metric)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP9_SQL = """
WITH v AS (SELECT vec_id, embedding AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i]::DOUBLE * c.x[i]::DOUBLE), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
