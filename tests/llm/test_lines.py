"""Line dedup against its SQL and a plain version."""

import hashlib
import random
from collections import defaultdict

import pytest

from stockaudit.llm import line_dedup, queries
from tests.compare import connect, differences


def plain(rows, least=10, documents=2):
    """Kept text, lines and dropped lines of every (doc_id, text), row by row."""
    def key(line):
        line = line.strip(line_dedup.WHITE)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    order = lambda doc: (doc is not None, doc)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if len(key(line)) < least or len(holders[key(line)]) < documents or doc == min(holders[key(line)], key=order)
        ]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(docs, **how):
    rows = line_dedup.drop_repeated_lines(docs, **how).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows), key=repr)


def test_query_matches_its_sql(spark, sf_dir):
    query = queries.queries()["op11_line_dedup"](spark, sf_dir)
    assert differences(query, connect(sf_dir), queries.oracle_sql()["op11_line_dedup"]) is None


@pytest.mark.parametrize("documents", [2, 3, 5])
def test_random_texts(spark, documents):
    draw = random.Random(documents)
    line = lambda: draw.choice(["", " ", "a", "\x0b\tLong enough É\r", "long Enough É", "long enough é", "nine char", "ten  chars", "ten\x1cchars", "×××××××××A", "×××××××××a"])
    rows = [(draw.choice([None, *range(12)]), draw.choice([None, "", "\n".join(line() for _ in range(draw.randint(0, 8)))])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs, min_documents=documents) == plain(rows, documents=documents)


def test_hot_line_and_long_text(spark):
    long_text = "\n".join(f"line number {i % 5000} of a long text" for i in range(40_000))
    rows = [(i, f"The line that everybody has\nown line number {i} here\nanother line of all documents") for i in range(3000)]
    rows += [(5000, long_text), (5001, long_text), (4000, "line number 17 of a long text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs) == plain(rows)


def test_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 12, 7, "a", 0), (2, "X" * 12 + "\n", 8, "b", 0)], "doc_id int, text string, n_lines int, id string, gone int")
    rows = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert rows[2].asDict() == {"doc_id": 2, "text": "", "n_lines": 8, "id": "b", "gone": 0, "_n_lines": 2, "n_dropped": 1}
    assert rows[1].text == "x" * 12
    assert line_dedup.digests(docs.limit(0)).collect() == []
    alone = spark.createDataFrame([(3, None)], "doc_id long, text string")
    assert line_dedup.digests(alone).collect()[0].asDict() == {
        "doc_id": 3, "n_lines": 1, "n_dropped": 0, "kept_sha256": hashlib.sha256(b"").hexdigest()
    }
