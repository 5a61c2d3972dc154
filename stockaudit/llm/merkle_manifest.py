"""Merkle manifest of a data set: one tree per source, a tree over the sources, and proofs of every row.

Nodes have up to three children, and a digest is the lower-case hex SHA-256 of what it covers, written one after the
other. Only the nodes of every ``STORED_EVERY``-th level are kept, as one row per aligned subtree with the (at most
3 to that power) digests of its lowest level. Whatever lies between is computed again when it is needed: on the way up to get
the subtree's top, and for proofs to give each of its nodes the siblings on the way to that top, after which the
interior nodes are forgotten.

A row's place in its source comes from one range sort over all sources and a count per sorted partition, so a source
with most of the rows is spread over the tasks like any other. A subtree is bounded, and so is every group here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockaudit.llm.tables import landed
from stockaudit.operators.joins import size_checked

CHILDREN = 3
STORED_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The low bits of Spark's row ids count the rows of a partition; the others are its number.
ROW_BITS = 33


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(text: Column | None = None) -> Column:
    """Digest of a row: each field ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    values = [F.col(name) if name != "text" or text is None else text for name in FIELDS]
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` in its tree (from 0) and the tree's ``size``; ``order`` breaks ties of position.

    Sorted partitions follow each other, so a row's position is its place among the rows of its tree in its own
    partition and the count of those in partitions before. There is one such count for each tree and partition
    that meet, at most as many as trees and partitions together.
    """
    key = [F.asc_nulls_first(tree), *[F.asc_nulls_first(name) for name in order]]
    in_order = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    stored = landed(in_order.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", ROW_BITS)
    runs = stored.groupBy(F.col(tree).alias("run_tree"), part.alias("part")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    all_parts = Window.partitionBy("run_tree")
    earlier = all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "run_tree", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(all_parts).alias("size"),
    )
    same = F.col(tree).eqNullSafe(F.col("run_tree")) & (part == F.col("part"))
    placed = stored.join(size_checked(runs), same).withColumn("position", F.col("at") + F.col("shift"))
    return placed.drop("at", "run_tree", "part", "shift")


def levels_in(size: int, every: int) -> int:
    """Levels between the nodes of a stored level and the next one, or the tree's top if that comes first."""
    levels = 0
    while size > 1 and levels < every:
        size, levels = -(-size // CHILDREN), levels + 1
    return levels


def regrown(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a subtree level by level, from its stored ones up to its top."""
    rows = [nodes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([digest("".join(below[i : i + CHILDREN])) for i in range(0, len(below), CHILDREN)])
    return rows


def _hex(column: pa.ListArray, row: int) -> list[str]:
    return [node.hex() for node in column[row].as_py()]


def _tops(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_pylist()
        tops, above = [], []
        for row, size in enumerate(sizes):
            levels = levels_in(size, every)
            tops.append(bytes.fromhex(regrown(_hex(batch.column("nodes"), row), levels)[-1][0]))
            above.append(-(-size // CHILDREN**levels))
        columns = [batch.column("tree"), batch.column("subtree"), pa.array(above, pa.int64()), pa.array(tops, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "position", "size", "node"])


def _stored_level(nodes: DataFrame, width: int, carried: list[str]) -> DataFrame:
    """One row per aligned subtree: its digests in order, and as lists what is carried with them."""
    slot = (F.col("position") % width).cast("int").alias("slot")
    members = F.sort_array(F.collect_list(F.struct(slot, "node", *carried)))
    grouped = nodes.groupBy("tree", "size", F.expr(f"position div {width}").alias("subtree")).agg(members.alias("members"))
    lists = [F.col(f"members.{name}").alias(f"all_{name}") for name in carried]
    return landed(grouped.select("tree", "size", "subtree", F.col("members.node").alias("nodes"), *lists), "level")


@dataclass
class Forest:
    """The stored levels of like trees, lowest first, and the top of each tree (``tree, node``)."""

    levels: list[DataFrame]
    tops: DataFrame
    carried: list[str]
    every: int


def grow(nodes: DataFrame, carried: list[str], every: int) -> Forest:
    """Trees over ``tree, position, size, node`` (binary); ``carried`` columns stay with the lowest nodes."""
    largest = nodes.agg(F.max("size")).first()[0] or 1
    width = CHILDREN**every
    levels, done = [], []
    while True:
        levels.append(_stored_level(nodes, width, carried if not levels else []))
        above = levels[-1].select("tree", "subtree", "size", "nodes").mapInArrow(
            lambda b: _tops(b, every), nodes.select("tree", "position", "size", "node").schema
        )
        done.append(above.where("size = 1").select("tree", "node"))
        if largest <= width:
            break
        nodes, largest = above.where("size > 1"), -(-largest // width)
    tops = done[0]
    for more in done[1:]:
        tops = tops.unionByName(more)
    return Forest(levels, landed(tops, "tops"), carried, every)


UPPER = ["top", "left", "right"]


def _with_paths(batches: Iterator[pa.RecordBatch], carried: list[str], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            nodes, levels = _hex(batch.column("nodes"), row), levels_in(batch.column("size")[row].as_py(), every)
            rows = regrown(nodes, levels)
            upper_left, upper_right = batch.column("left")[row].as_py(), batch.column("right")[row].as_py()
            left, right = [], []
            for place in range(len(nodes)):
                before, after = [], []
                for level in range(levels):
                    run = place - place % CHILDREN
                    before.append("".join(rows[level][run:place]))
                    after.append("".join(rows[level][place + 1 : run + CHILDREN]))
                    place //= CHILDREN
                left.append(before + upper_left)
                right.append(after + upper_right)
            first = batch.column("subtree")[row].as_py() * CHILDREN**every
            columns = [
                pa.array([batch.column("tree")[row].as_py()] * len(nodes), batch.column("tree").type),
                pa.array(range(first, first + len(nodes)), pa.int64()),
                pa.array(nodes, pa.string()),
                *[batch.column(f"all_{name}")[row].values for name in carried],
                pa.array([batch.column("top")[row].as_py()] * len(nodes), pa.string()),
                pa.array(left, pa.list_(pa.string())),
                pa.array(right, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "position", "node", *carried, *UPPER])


def paths(forest: Forest, upper: DataFrame) -> DataFrame:
    """``tree, position, node, <carried>, top, left, right`` of every lowest node.

    ``left`` and ``right`` hold, level by level up to the root, the siblings' digests on either side. ``upper``
    (``tree, top, left, right``) has each tree's top and what lies above it. Stored levels are taken from the highest down: what a
    subtree's top has above it is joined to the subtree's row, one row to one row.
    """
    above, every, width = None, forest.every, CHILDREN**forest.every
    for level in reversed(range(len(forest.levels))):
        table, carried = forest.levels[level], forest.carried if level == 0 else []
        last = F.col("size") <= width
        known = table.where(last).join(upper.withColumnRenamed("tree", "up"), F.col("tree").eqNullSafe(F.col("up"))).drop("up")
        if above is not None:
            up = above.select(F.col("tree").alias("up"), F.col("position").alias("subtree_up"), *UPPER)
            same = F.col("tree").eqNullSafe(F.col("up")) & (F.col("subtree") == F.col("subtree_up"))
            known = known.unionByName(table.where(~last).join(up, same).drop("up", "subtree_up"))
        kinds = {f.name: f.dataType.elementType.simpleString() for f in table.schema if f.name.startswith("all_")}
        schema = ", ".join([
            f"tree {table.schema['tree'].dataType.simpleString()}", "position long", "node string",
            *[f"{name} {kinds[f'all_{name}']}" for name in carried], "top string", "left array<string>", "right array<string>",
        ])
        above = known.mapInArrow(lambda b, carried=carried: _with_paths(b, carried, every), schema)
        if level:
            above = landed(above, "paths")
    return above


def folded(node: Column) -> Column:
    """The root that ``node`` leads to with the siblings in ``left`` and ``right``."""
    pairs = F.arrays_zip("left", "right")
    return F.aggregate(pairs, node, lambda below, pair: F.sha2(F.concat(pair["left"], below, pair["right"]), 256))


def proof_digest() -> Column:
    """Digest of all siblings in ``left`` and ``right``, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(F.arrays_zip("left", "right"), lambda p: F.concat(p["left"], p["right"])), ""), 256)


@dataclass
class Manifest:
    """Stored levels of the sources' trees and of the tree over them, and the root (None without rows)."""

    sources: Forest
    top: Forest
    root: str | None


def build(docs: DataFrame, every: int = STORED_EVERY, **carried: Column) -> Manifest:
    """The manifest of ``docs`` with every ``every``-th level stored; columns of ``carried`` (expressions over ``docs``) stay with each row's leaf.

    Within a source rows ascend by ``doc_id``, null first, and rows of one ``doc_id`` by their leaf, so repeated rows
    have leaves of their own. Rows without a source are a source, which comes first. Null fields are told from empty
    ones. Columns other than the five fields have no part, whatever their names.
    """
    names = list(carried)
    leaves = docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf()).alias("node"), *[column.alias(name) for name, column in carried.items()],
    )
    sources = grow(ranked(leaves, "tree", ["doc_id", "node"]), ["doc_id", *names], every)
    subroots = sources.tops.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "node")
    top = grow(ranked(subroots, "tree", ["source"]), ["source"], every)
    root = top.tops.first()
    return Manifest(sources, top, root and bytes(root["node"]).hex())


def prove(manifest: Manifest) -> DataFrame:
    """``source, position, leaf, doc_id, <carried>, subroot, left, right`` of every row, siblings as in ``paths``."""
    spark = manifest.top.tops.sparkSession
    nothing = spark.createDataFrame([(0, manifest.root, [], [])], "tree int, top string, left array<string>, right array<string>")
    upper = paths(manifest.top, nothing).select(F.col("source").alias("tree"), F.col("node").alias("top"), "left", "right")
    rows = paths(manifest.sources, landed(upper, "upper"))
    return rows.withColumnsRenamed({"tree": "source", "node": "leaf", "top": "subroot"})


def digests(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether a version without line feeds still leads to the root.

    Rows are changed where 2 divides the CRC of the decimal ``doc_id``; a null id counts as ``-``.
    """
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary")) % 2 == 0
    seen = F.when(even, F.unhex(leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    manifest = build(docs, seen=seen)
    root = F.lit(manifest.root).cast("string")
    rows = prove(manifest).withColumn("folded_root", folded(F.coalesce(F.lower(F.hex("seen")), F.col("leaf"))))
    return rows.select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


SQL = """
    WITH RECURSIVE crc_table AS (
      SELECT list(v ORDER BY n) AS crcs FROM (
        SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v
        FROM range(256) t(n))),
    told AS (
      SELECT *, CAST(doc_id AS VARCHAR) AS id, xor(4294967295, list_reduce(
          list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
            lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
          lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) % 2 = 0 AS changed
      FROM documents, crc_table),
    written AS (
      SELECT doc_id, source, text, changed,
        coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
      FROM told),
    leaves AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN changed THEN sha256(head || coalesce(
          strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS seen,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS n
      FROM written),
    nodes(source, level, i, n, node) AS (
      SELECT source, 0, i, n, leaf FROM leaves
      UNION ALL
      SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i))
      FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n),
    subroots AS (
      SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
      FROM nodes WHERE n = 1),
    tops(level, i, n, node) AS (
      SELECT 0, i, n, subroot FROM subroots
      UNION ALL
      SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i))
      FROM tops WHERE n > 1 GROUP BY level, i // 3, n),
    steps AS (
      SELECT d.doc_id, s.level AS step,
        coalesce(string_agg(s.node, '' ORDER BY s.i) FILTER (s.i < d.i // CAST(3 ** s.level AS BIGINT)), '') AS l,
        coalesce(string_agg(s.node, '' ORDER BY s.i) FILTER (s.i > d.i // CAST(3 ** s.level AS BIGINT)), '') AS r
      FROM leaves d JOIN nodes s
        ON s.source IS NOT DISTINCT FROM d.source AND s.n > 1 AND s.i // 3 = d.i // CAST(3 ** (s.level + 1) AS BIGINT)
      GROUP BY d.doc_id, s.level
      UNION ALL
      SELECT d.doc_id, 1000 + s.level,
        coalesce(string_agg(s.node, '' ORDER BY s.i) FILTER (s.i < u.i // CAST(3 ** s.level AS BIGINT)), ''),
        coalesce(string_agg(s.node, '' ORDER BY s.i) FILTER (s.i > u.i // CAST(3 ** s.level AS BIGINT)), '')
      FROM leaves d JOIN subroots u ON u.source IS NOT DISTINCT FROM d.source
        JOIN tops s ON s.n > 1 AND s.i // 3 = u.i // CAST(3 ** (s.level + 1) AS BIGINT)
      GROUP BY d.doc_id, s.level),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM steps),
    climbs(doc_id, k, node) AS (
      SELECT doc_id, 0, coalesce(seen, leaf) FROM leaves
      UNION ALL
      SELECT c.doc_id, c.k + 1, sha256(p.l || c.node || p.r)
      FROM climbs c JOIN numbered p ON p.doc_id = c.doc_id AND p.k = c.k + 1),
    proofs AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM numbered GROUP BY doc_id),
    ends AS (SELECT doc_id, arg_max(node, k) AS folded_root FROM climbs GROUP BY doc_id)
    SELECT d.doc_id, d.leaf, u.subroot, t.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root,
      e.folded_root = t.node AS verified
    FROM leaves d JOIN subroots u ON u.source IS NOT DISTINCT FROM d.source JOIN tops t ON t.n = 1
      JOIN ends e ON e.doc_id = d.doc_id LEFT JOIN proofs p ON p.doc_id = d.doc_id"""
