"""Nearest neighbours by largest inner product with a hash-prefix forest.

Rows are packed into shards. In a shard every tree is a sorted array of long hash strings: the signs of
random projections of the vectors, which are lengthened by one component so that a large inner product
becomes a small angle. A query descends each tree to its longest prefix match and then ascends all trees
together, one bit at a time, until the ranges hold enough candidates; those are scored exactly. A row of
the query set meets every shard, in blocks, and only its nearest of each shard are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockaudit.llm import arrowtext
from stockaudit.llm.tables import landed

TREES = 64
BITS = 32
# Rows of a shard, queries of a block, and how many rows the ranges of all trees hold together before the
# ascent ends: a share of the shard and a fixed number (a row counts once a tree).
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
ASCENT = 0.6
LEAST_REACHED = 2048
SEED = 7

PACK_SCHEMA = "pack long, dim int, ids binary, vectors binary"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def usable(vec_id: Column, vector: Column) -> Column:
    """Rows that take part: an id, and a vector with a non-zero component and none null or non-finite."""
    values = vector.cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec_id.isNotNull() & F.coalesce(finite & F.exists(values, lambda x: x != 0), F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: dict[int, tuple[list, list]] = {}

    def pack(dim: int) -> pa.RecordBatch:
        nonlocal number
        ids, vectors = held.pop(dim)
        number += 1
        values = [[(part << 32) + number], [dim], [np.concatenate(ids).tobytes()], [np.concatenate(vectors).tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["pack", "dim", "ids", "vectors"])

    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("vector")
        offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
        dims = np.diff(offsets)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            while len(rows):
                own = held.setdefault(dim, ([], []))
                take = rows[: size - sum(map(len, own[0]))]
                rows = rows[len(take) :]
                own[0].append(ids[take])
                own[1].append(flat[arrowtext.ragged(offsets[take], np.full(len(take), dim))])
                if sum(map(len, own[0])) >= size:
                    yield pack(dim)
    for dim in sorted(held):
        yield pack(dim)


def _packs(rows: DataFrame, size: int) -> DataFrame:
    return rows.mapInArrow(lambda b: _packed(b, size), PACK_SCHEMA)


class Forest:
    """The trees of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        norms = (vectors**2).sum(axis=1)
        rest = np.sqrt(np.maximum(0.0, norms.max(initial=0.0) - norms))
        draws = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, TREES * BITS))
        self.planes = draws[:-1]
        keys = self._strings(vectors @ draws[:-1] + rest[:, None] * draws[-1])
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(keys, self.order, axis=0).T)

    @staticmethod
    def _strings(projected: np.ndarray) -> np.ndarray:
        """Sign bits as one integer a tree, the first bit the highest."""
        bits = (projected >= 0).reshape(len(projected), TREES, BITS)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))

    def candidates(self, queries: np.ndarray, ascent: float = ASCENT) -> np.ndarray:
        """Which rows (columns) each query (row) reaches."""
        keys = self._strings(queries @ self.planes)
        wanted = min(ascent * len(self.ids) + LEAST_REACHED, TREES * len(self.ids))
        low = np.zeros((len(queries), TREES), np.int64)
        high = np.zeros((len(queries), TREES), np.int64)
        # Descent: the longest prefix that a query shares with either neighbour of its place in a tree.
        longest = np.zeros((len(queries), TREES), np.int64)
        for tree in range(TREES):
            own, column = keys[:, tree], self.sorted[tree]
            place = np.searchsorted(column, own)
            nearest = np.minimum(own ^ column[np.maximum(place - 1, 0)], own ^ column[np.minimum(place, len(column) - 1)])
            longest[:, tree] = BITS - np.ceil(np.log2(nearest.astype(np.float64) + 1)).astype(np.int64)
        # Ascent: all trees of a query drop a bit together; trees without a match that long stay empty.
        rising = np.arange(len(queries))
        for depth in range(int(longest.max(initial=0)), -1, -1):
            free = np.uint64((1 << (BITS - depth)) - 1)
            for tree in range(TREES):
                matched = rising[longest[rising, tree] >= depth]
                own = keys[matched, tree]
                low[matched, tree] = np.searchsorted(self.sorted[tree], own & ~free, "left")
                high[matched, tree] = np.searchsorted(self.sorted[tree], own | free, "right")
            rising = rising[(high[rising] - low[rising]).sum(axis=1) < wanted]
            if not len(rising):
                break
        reached = np.zeros((len(queries), len(self.ids)), bool)
        for tree in range(TREES):
            counts = high[:, tree] - low[:, tree]
            at = arrowtext.ragged(low[:, tree], counts)
            reached[np.repeat(np.arange(len(queries)), counts), self.order[at, tree]] = True
        return reached

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, row ids and scores of up to ``k`` nearest reached rows of each query."""
        out = []
        for query_id, query, reached in zip(query_ids, queries, self.candidates(queries)):
            rows = np.flatnonzero(reached & (self.ids != query_id))
            rough = self.vectors[rows] @ query
            n = k
            while n < len(rows):
                # Down to the k-th best of distinct ids, with room for rounding; repeated ids take more rows.
                n = min(len(rows), 2 * n)
                bar = np.partition(rough, len(rows) - n)[len(rows) - n]
                top = rough >= bar - 1e-9 * (1 + abs(bar))
                if len(np.unique(self.ids[rows[top]])) >= k:
                    rows = rows[top]
                    break
            # Products are summed row by row, so equal vectors have equal scores wherever they lie.
            scores = (self.vectors[rows] * query).sum(axis=1)
            ids = self.ids[rows]
            order = np.lexsort((ids, -scores))
            _, first = np.unique(ids[order], return_index=True)
            order = order[np.sort(first)[:k]]
            out.append((np.full(len(order), query_id), ids[order], scores[order]))
        return out


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    last, forest = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            at = {name: batch.column(name)[row].as_py() for name in ("pack", "dim", "ids", "vectors", "query_ids", "query_vectors")}
            if at["pack"] != last:  # rows come sorted by shard from the join, so a forest serves many blocks
                ids = np.frombuffer(at["ids"], np.int64)
                last, forest = at["pack"], Forest(ids, np.frombuffer(at["vectors"]).reshape(len(ids), at["dim"]))
            query_ids = np.frombuffer(at["query_ids"], np.int64)
            found = forest.nearest(query_ids, np.frombuffer(at["query_vectors"]).reshape(len(query_ids), at["dim"]), k)
            columns = [pa.array(np.concatenate(x)) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest found rows, other rows than its own.

    ``rows`` and ``queries`` have ``vec_id`` and ``vector``; unusable ones take no part, vectors only meet
    those of their own length, and a query has no row where nothing can be found. Ties go to the smaller
    id. Of a repeated id, a query is its smallest vector and a found row its best.
    """
    ready = [
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(
            usable(F.col("vec_id"), F.col("vector"))
        )
        for df in (rows, queries)
    ]
    shards = landed(_packs(ready[0], SHARD_ROWS), "shards")
    distinct = ready[1].groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = landed(_packs(distinct, BLOCK_QUERIES), "blocks")
    # One short row a shard of thousands of rows: the list of shards that every block visits.
    listed = shards.groupBy("dim").agg(F.collect_list("pack").alias("packs"))
    visits = blocks.join(listed, "dim").select(
        F.explode("packs").alias("pack"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")
    )
    found = shards.join(visits, "pack").sortWithinPartitions("pack").mapInArrow(lambda b: _searched(b, k), FOUND_SCHEMA)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
