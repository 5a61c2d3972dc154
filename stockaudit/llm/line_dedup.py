"""Lines that several documents hold stay only in the first of them.

Texts are exploded into normalised lines, lines into 128-bit hashes. One aggregation with partial results tells for
each hash whether it occurs in enough documents and which of them comes first. The places of repeated lines are
then found by a join and taken out of each text by position. Lines become keys and hashes in Arrow batches, once; the
table of places that is stored has a few bytes a line.

Nothing depends on how often a line occurs: the aggregation meets a hot line with one partial row per task, and the
join sends the few lines that hold a large part of all places to the places, not the places to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stockaudit.llm import arrowtext
from stockaudit.llm.tables import free_name, landed

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCUMENTS = 2
# A line is hot if it holds more than this part of all places of repeated lines: there are at most as many such lines.
HOT_PARTS = 4096
# Stands for an unknown document id, which is a document of its own and comes first.
NO_ID = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(docs: DataFrame) -> list[Column]:
    # Rows of one id and one text have the same answer, so they need not be told apart.
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("version")]


def line_keys(lines: pa.Array) -> pa.Array:
    """Lines without white space at both ends, A to Z in lower case and all other letters as they are."""
    return pc.ascii_lower(pc.ascii_trim(lines, characters=WHITE))


def _placed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in arrowtext.slices(batches, "text"):
        lists = pc.split_pattern(arrowtext.text_of(batch, "text"), "\n")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        position = np.arange(offsets[-1] - offsets[0]) - (offsets - offsets[0])[row]
        keys = line_keys(lists.flatten())
        long_enough = np.flatnonzero(pc.utf8_length(keys).to_numpy() >= min_chars)
        hashes = [xxhash.xxh3_128_digest(key) for key in keys.take(pa.array(long_enough)).cast(pa.large_binary()).to_pylist()]
        row = pa.array(row[long_enough])
        columns = [batch.column("id").take(row), batch.column("version").take(row), pa.array(position[long_enough], pa.int32()), pa.array(hashes, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "position", "line"])


def line_places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, version, position, line``: the hash of every line whose key has at least ``min_chars`` code points."""
    return docs.select(*_identity(docs), "text").mapInArrow(
        lambda b: _placed(b, min_chars), "id long, version long, position int, line binary"
    )


def repeated_lines(places: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``line, first, places``: lines that at least ``min_documents`` documents hold, the smallest id and all places.

    That there are two documents follows from the smallest and the largest id. A higher threshold counts distinct
    (line, id) pairs, of the lines that can reach it only.
    """
    found = places.groupBy("line").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("places")
    )
    found = found.where((F.col("last") > F.col("first")) & (F.col("places") >= min_documents)).drop("last")
    if min_documents <= 2:
        return found
    holders = places.join(found.select("line"), "line", "left_semi").select("line", "id").distinct()
    enough = holders.groupBy("line").agg(F.count(F.lit(1)).alias("documents"))
    return found.join(enough.where(F.col("documents") >= min_documents).select("line"), "line", "left_semi")


def repeated_places(places: DataFrame, repeated: DataFrame) -> DataFrame:
    """``id, version, position`` of the repeated lines outside the first document that holds them.

    Both are stored tables. The hot lines, at most ``HOT_PARTS``, are broadcast. Every other line has less
    than that part of the places, so the shuffled join of the rest has no large key.
    """
    total = repeated.agg(F.sum("places")).first()[0] or 0
    is_hot = F.col("places") > total // HOT_PARTS
    hot = repeated.where(is_hot).select("line", F.col("first").alias("hot_first"))
    told = places.join(F.broadcast(hot), "line", "left")
    known = told.where(F.col("hot_first").isNotNull()).withColumnRenamed("hot_first", "first")
    rest = told.where(F.col("hot_first").isNull()).drop("hot_first")
    joined = rest.join(repeated.where(~is_hot).select("line", "first"), "line")
    later = known.unionByName(joined).where(F.col("id") != F.col("first"))
    return later.select("id", "version", "position")


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and two columns, ``n_lines`` before dropping and ``n_dropped``.

    A text is split at line feeds; a null or empty one is one empty line and stays, as empty text. Rows are documents
    by their ``doc_id``: rows that share it are one document, and rows that share its text too have equal results.
    A null ``doc_id`` is one document before all others. Other columns are kept; if ``docs`` has one of the names
    of the two counts, the count has an underscore in front. An empty table gives an empty one.
    """
    places = landed(line_places(docs, min_chars), "places")
    repeated = landed(repeated_lines(places, min_documents), "lines")
    dropped = repeated_places(places, repeated).groupBy("id", "version").agg(F.collect_set("position").alias("gone"))
    names = {name: free_name(docs.columns, name) for name in ("id", "version", "gone", "lines", "n_lines", "n_dropped")}
    identity = [column.alias(names[name]) for name, column in zip(("id", "version"), _identity(docs))]
    told = docs.select("*", *identity).join(
        dropped.toDF(names["id"], names["version"], names["gone"]), [names["id"], names["version"]], "left"
    )
    lines, gone = F.col(names["lines"]), F.coalesce(F.col(names["gone"]), F.array().cast("array<int>"))
    told = told.withColumn(names["lines"], _lines(F.col("text")))
    # The places that stay, in order; both steps are linear in the number of lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n")
    rest = [kept.alias("text") if name == "text" else F.col(name) for name in docs.columns]
    return told.select(*rest, F.size(lines).cast("long").alias(names["n_lines"]), F.size(gone).cast("long").alias(names["n_dropped"]))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
    WITH lines AS (
      SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS position
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    keyed AS (
      SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    repeated AS (
      SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    told AS (
      SELECT k.doc_id, k.position, k.line, r.first IS NOT NULL AND k.doc_id <> r.first AS gone
      FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
    FROM told GROUP BY doc_id"""
