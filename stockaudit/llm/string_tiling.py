"""Benchmark decontamination by greedy string tiling.

Runs of ``MIN_TILE`` words are hashed by a rolling hash in documents and benchmark items and joined: shared
runs are seeds. Seeds that follow each other in both texts make longer matches, put together by windows over
(document, item, distance of both places) before anything is listed. For each document and item the longest match that is still free is marked as a tile, what a tile cuts off of other matches goes on as
a shorter match, and so on until none of ``MIN_TILE`` words is left. A document is contaminated by an item
if its tiles cover enough of the item's words, in whatever order they stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stockaudit.llm import arrowtext, words
from stockaudit.llm.tables import free_name, landed
from stockaudit.operators.joins import size_checked, stored

MIN_TILE = 5
COVERAGE = 0.5
# A document's seeds pass a bit table of the benchmark's before the join; its size does not grow.
FILTER_BITS = 22

SEEDS = "owner long, tag long, at int, hash long, words int"


def _seeds(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Hash and place of every run of a text, or of those that the bit table lets pass; ``words`` is the text's length."""
    for batch in arrowtext.slices(batches, "text"):
        values, starts = words.hashed_words(arrowtext.text_of(batch, "text"))
        runs = words.run_hashes(values, MIN_TILE)
        counts = np.diff(starts)
        text = np.repeat(np.arange(batch.num_rows), counts)
        at = np.arange(len(values)) - starts[text]
        keep = at <= counts[text] - MIN_TILE
        if bits is not None:
            keep &= bits[(runs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        held = np.flatnonzero(keep)
        rows = pa.array(text[held])
        columns = [batch.column("owner").take(rows), batch.column("tag").take(rows), pa.array(at[held].astype(np.int32))]
        columns += [pa.array(runs[held].view(np.int64)), pa.array(counts[text[held]].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["owner", "tag", "at", "hash", "words"])


def matches_of(seeds: DataFrame) -> DataFrame:
    """``owner, item_row, at, item_at, words``: seeds that follow each other in both texts as one match."""
    diagonal = Window.partitionBy("owner", "item_row", "shift").orderBy("at")
    placed = seeds.withColumn("shift", F.col("at") - F.col("item_at")).distinct()
    runs = placed.withColumn("run", F.col("at") - F.row_number().over(diagonal))
    found = runs.groupBy("owner", "item_row", "shift", "run").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("seeds"))
    length = (F.col("seeds") + (MIN_TILE - 1)).cast("int").alias("words")
    return found.select("owner", "item_row", "at", (F.col("at") - F.col("shift")).alias("item_at"), length)


def tiles(places: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, words) from maximal matches given likewise, longest first.

    Of equally long matches the one first in the document, then in the item, is marked first.
    """
    matches = [(-length, d, i) for d, i, length in places]
    heapq.heapify(matches)
    marked_d: set[int] = set()
    marked_i: set[int] = set()
    found = []
    while matches:
        negative, d, i = heapq.heappop(matches)
        free = [k for k in range(-negative) if d + k not in marked_d and i + k not in marked_i]
        if len(free) == -negative:
            found.append((d, i, -negative))
            marked_d.update(range(d, d - negative))
            marked_i.update(range(i, i - negative))
            continue
        # What other tiles left of this match goes on as shorter matches.
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= MIN_TILE:
                    heapq.heappush(matches, (start - k, d + free[start], i + free[start]))
                start = k
    return found


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.column("places"):
            places = row.values
            found.append(tiles(zip(*[places.field(name).to_pylist() for name in ("at", "item_at", "words")])))
        covered = [sum(t[2] for t in f) for f in found]
        columns = [batch.column("owner"), batch.column("item_id"), pa.array(list(map(len, found)), pa.int32()), pa.array(covered, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["owner", "item_id", "tiles", "covered"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_key, item_id, item_row, tiles, covered, item_words, coverage`` of every row and item that share a seed.

    ``text_key`` is a hash of the text; null text is empty and shares nothing, like items and documents
    with fewer than ``MIN_TILE`` words. Repeated rows and items are each compared.
    """
    items = benchmark.select(F.monotonically_increasing_id().alias("owner"), F.col("item_id").cast("long").alias("tag"), "text")
    item_seeds = landed(items.mapInArrow(lambda b: _seeds(b, None), SEEDS), "item_seeds")
    bucket = F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("bucket")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[item_seeds.select(bucket).distinct().toArrow()["bucket"].to_numpy()] = True  # at most as many as there are bits
    packed = np.packbits(bits)

    numbered = docs.select(
        F.monotonically_increasing_id().alias("owner"), F.xxhash64("text").alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _seeds(batches, np.unpackbits(packed).astype(bool))

    doc_seeds = landed(_with_id(numbered, seeds_of), "doc_seeds")
    listed = size_checked(item_seeds.select("hash", F.col("owner").alias("item_row"), F.col("at").alias("item_at")))
    shared = doc_seeds.select("owner", "hash", "at").join(listed, "hash").select("owner", "item_row", "at", "item_at")
    grouped = matches_of(shared).groupBy("owner", F.col("item_row").alias("item_id")).agg(F.collect_list(F.struct("at", "item_at", "words")).alias("places"))
    tiled = grouped.mapInArrow(_tiled, "owner long, item_id long, tiles int, covered int").withColumnRenamed("item_id", "item_row")
    names = size_checked(item_seeds.select(F.col("owner").alias("item_row"), F.col("tag").alias("item_id"), F.col("words").alias("item_words")).distinct())
    owners = doc_seeds.select("owner", "doc_id", F.col("tag").alias("text_key")).distinct()
    found = tiled.join(names, "item_row").join(owners, "owner")
    return found.select(
        "doc_id", "text_key", "item_id", "item_row", "tiles", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage")
    )


def _with_id(numbered: DataFrame, seeds_of) -> DataFrame:
    """Seeds with the ``doc_id`` of their row beside its number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = dict(zip(batch.column("owner").to_pylist(), batch.column("doc_id").to_pylist()))
            for out in seeds_of(iter([batch])):
                own = pa.array([ids[o] for o in out.column("owner").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*out.columns, own], names=[*out.schema.names, "doc_id"])

    return numbered.mapInArrow(work, f"{SEEDS}, doc_id long")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``overlaps`` whose tiles cover at least ``coverage`` of the item."""
    return overlaps(docs, benchmark).where(F.col("coverage") >= coverage)


def without(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows whose text any item contaminates, with their own columns."""
    keys = stored(contaminated(docs, benchmark, coverage).select("text_key").distinct())
    name = free_name(docs.columns, "text_key")
    hashed = docs.withColumn(name, F.xxhash64("text"))
    return hashed.join(keys.toDF(name), name, "left_anti").select(*docs.columns)
