"""Merkle manifest and proofs against SQL and a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stockaudit.llm import merkle_manifest as merkle, queries
from tests.compare import connect, differences

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top of ``nodes``, and for each its siblings (left, right) level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, (i, place) in zip(paths, enumerate(places)):
            run = place // 3 * 3
            path.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
            places[i] = place // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([member[2] for member in sorted(by_source[s], key=lambda m: m[:3])]) for s in sources}
    root, tops = climb([trees[s][0] for s in sources])
    out = []
    for source, top in zip(sources, tops):
        for (_, _, leaf, row), path in zip(sorted(by_source[source], key=lambda m: m[:3]), trees[source][1]):
            seen, siblings = leaf, path + top
            if zlib.crc32(("-" if row[0] is None else str(row[0])).encode()) % 2 == 0 and row[4] is not None:
                seen = plain_leaf((*row[:4], row[4].replace("\n", "")))
            node = seen
            for left, right in siblings:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in siblings))
            out.append((row[0], leaf, trees[source][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def test_query_matches_its_sql(spark, sf_dir):
    query = queries.queries()["op12_merkle_manifest"](spark, sf_dir)
    assert differences(query, connect(sf_dir), queries.oracle_sql()["op12_merkle_manifest"]) is None


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (3, 1), (4, 2), (40, 13), (260, 2), (800, 1)])
def test_random_tables(spark, n, sources):
    draw = random.Random(n)
    names = [None, "", "ä", "z", "𝄞", "￰", *[f"s{i}" for i in range(20)]][:sources]
    rows = [
        (draw.choice([None, i, i, i, i // 2]), draw.choice(names), draw.choice([None, "", "de"]),
         draw.choice([None, 0, -5]), draw.choice([None, "", "a\nb", "é\n\n", "plain"]))
        for i in range(n)
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.digests(docs).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_levels_stored_differently_give_the_same(spark, every):
    rows = [(i, "hot" if i % 3 else f"s{i % 30}", None, i, f"text {i}") for i in range(400)]
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA), every)
    assert len(manifest.sources.levels) == {1: 6, 2: 3, 3: 2}[every]
    largest = [level.agg(F.max(F.size("nodes"))).first()[0] for level in manifest.sources.levels]
    assert max(largest) <= 3**every
    proofs = merkle.prove(manifest).withColumn("end", merkle.folded(F.col("leaf"))).withColumn("proof", merkle.proof_digest())
    got = sorted(((r.doc_id, r.leaf, r.subroot, manifest.root, r.proof) for r in proofs.collect()), key=repr)
    assert got == [row[:5] for row in plain(rows)]
    assert {r.end for r in proofs.collect()} == {manifest.root}
    assert {r.end for r in proofs.withColumn("end", merkle.folded(F.sha2("leaf", 256))).collect()} != {manifest.root}


def test_names_empty_tables_and_long_texts(spark):
    rows = [(1, "s", "de", 3, "x\n" * 300_000, "a", "b"), (2, "s", None, None, None, "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA + ", node string, tree string")
    got = sorted(map(tuple, merkle.digests(docs).collect()), key=repr)
    assert got == plain([row[:5] for row in rows])
    assert merkle.digests(docs.limit(0)).collect() == [] and merkle.build(docs.limit(0)).root is None
