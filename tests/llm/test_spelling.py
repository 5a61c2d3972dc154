"""Spelling variants against SQL and a plain version, and the filters on their own."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stockaudit.llm import queries, spelling_bloom as spelling
from tests.compare import connect, differences


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'-' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(out)


def got(docs, **how):
    return sorted(map(tuple, spelling.variants(docs, **how).collect()))


def test_query_matches_its_sql(spark, sf_dir):
    query = queries.queries()["op13_spelling_bloom"](spark, sf_dir)
    assert differences(query, connect(sf_dir), queries.oracle_sql()["op13_spelling_bloom"]) is None


@pytest.mark.parametrize("round_words", [spelling.ROUND_WORDS, 40])
def test_random_words(spark, round_words):
    draw = random.Random(round_words)
    stems = ["aaaaaa", "abcabc", "ÿÀ×÷zzzz", "b" * 70, "b" * 71, "Letter", "lÉtter", "zzzzzzz"]

    def word():
        w = draw.choice(stems)
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            at = draw.randrange(len(w))
            w = w[:at] + draw.choice(["", "a", "z", "ÿ", w[at] + "q"]) + w[at + draw.choice([0, 1]) :]
        return w

    common = [word() for _ in range(150)]
    rows = [
        (draw.choice([None, i, i]), draw.choice([None, "", *[" 1,".join(draw.choice(common[: draw.choice([3, 20, 150])]) for _ in range(60))] * 9]))
        for i in range(150)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert any(row[1] for row in want)
    assert got(docs, round_words=round_words) == want


def test_chain_of_forms(spark):
    text = " ".join(["nature"] * 5 + ["natures"] * 30 + ["naturesx"] * 200 + ["naturesxy"] * 1200 + ["naturesxyz"] * 7000)
    rows = [(1, text)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert {row[2] for row in plain(rows)} == {"naturesxyz"}


def test_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "wording " * 5, 3), (1, None, 4)], "doc_id int, text string, n int")
    assert got(docs) == [("wording", None, "wording", 5, 0, None)]
    assert got(docs.limit(0)) == [] and got(docs.where("n = 4")) == []


def test_edits_hash_like_the_words_they_make():
    words = ["abcabcd", "ÿÀzzzzq", "letters"]
    filters = spelling.rounds_of({6: 1, 7: 1}, 1 << 20)[0]
    every = np.full((filters[-1].first_block + filters[-1].blocks) * spelling.LANES, ~np.uint64(0))
    edits = Counter(spelling.known_edits(words, filters, every))
    want = Counter()
    letters = [chr(int(c)) for c in spelling.LETTERS]
    for at, w in enumerate(words):
        want.update({(at, w[:i] + c + w[i + 1 :]) for i in range(7) for c in letters if c > w[i]})
        want.update({(at, w[:i] + w[i + 1 :]) for i in range(7)})
    assert edits == want
    for filters in spelling.rounds_of({6: 3, 7: 100}, 30):
        lanes = np.zeros((filters[-1].first_block + filters[-1].blocks) * spelling.LANES, np.uint64)
        assert not list(spelling.known_edits(words, filters, lanes))
    assert sum(f.parts == 4 for r in spelling.rounds_of({6: 3, 7: 100}, 30) for f in r) == 4
