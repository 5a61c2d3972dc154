"""Words grouped with the frequent words they look like a slip of.

Words are counted over all texts. Two words are near if one insertion, deletion or replacement of a code point makes
one of the other. Near words are found from generated edits: each word's edits are hashed and looked up in blocked Bloom
filters of the vocabulary, one per word length, and only edits that a filter knows are shuffled, to a join with
the vocabulary that keeps those that are words. A pair is generated from one side only, replacements by the smaller
letter and insertions as deletions of the longer word, and then told to both words.

The filters of one round hold at most ``ROUND_WORDS`` words at 16 bits each, which bounds the broadcast. A larger
vocabulary takes more rounds over the same edits; a length with more words than that is parted by hash. An edit costs
a few machine operations, as the hash of a word is a polynomial in its letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockaudit.llm import arrowtext
from stockaudit.llm.tables import landed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {capital: capital + 32 for capital in range(ord("A"), ord("Z") + 1)}
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
MIN_CHARS, MIN_COUNT, FORM_RATIO, SLIP_STEP = 6, 5, 5, 199
# Distinct words that a task counts before it sends partial counts.
HELD_WORDS = 300_000
# Words longer than this share a filter.
LONGEST_SHARD = 64
ROUND_WORDS = 1 << 23
WORDS_A_BLOCK, LANES, PROBES = 32, 8, 6
# Vocabulary words per task when their edits are looked up.
TASK_WORDS = 20_000
CHUNK = 4096
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def slip(run: str, doc_hash: int, step: int = SLIP_STEP) -> str:
    """The run, without one of its letters where ``step`` divides the CRC of ``<doc_id>:<run>``."""
    h = zlib.crc32(run.encode(), doc_hash)
    if h % step:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in arrowtext.slices(batches, "text"):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            doc_hash = zlib.crc32(b"-:" if doc is None else f"{doc}:".encode())
            runs: Counter[str] = Counter()
            for run, n in Counter(RUN.findall(text or "")).items():
                if len(run) >= MIN_CHARS:
                    runs[run.lower() if run.isascii() else run.translate(SMALL)] += n
            for run, n in runs.items():
                word = slip(run, doc_hash)
                if len(word) >= MIN_CHARS:
                    counts[word] += n
            if len(counts) >= HELD_WORDS:
                yield flushed()
    if counts:
        yield flushed()


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: every word of at least ``MIN_CHARS`` code points and ``min_count`` occurrences."""
    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(length, BASE, np.uint64))))[:length]


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letters; all letters are single Latin-1 signs."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1).astype(np.uint64)


def _hashes(letters: np.ndarray) -> np.ndarray:
    return (letters * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def shard_of(length: int) -> int:
    return min(length, LONGEST_SHARD)


@dataclass(frozen=True)
class Filter:
    """The blocks of one part of a shard within the filters of its round."""

    shard: int
    part: int
    parts: int
    first_block: int
    blocks: int

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes belong to this part, and for those the block and the source of their bits."""
        mixed = _mix(hashes)
        mine = np.arange(len(hashes))
        if self.parts > 1:
            mine = np.flatnonzero((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(self.parts) == self.part)
            mixed = mixed[mine]
        block = (mixed >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)
        return mine, block.astype(np.int64) + self.first_block, _mix(mixed + np.uint64(BASE))


def rounds_of(sizes: dict[int, int], round_words: int = ROUND_WORDS) -> list[list[Filter]]:
    """Filters for shards of given sizes, parted and dealt so that a round holds about ``round_words`` words."""
    rounds: list[list[Filter]] = []
    held = round_words
    for shard, words in sorted(sizes.items()):
        parts = -(-words // round_words)
        share = -(-words // parts)
        for part in range(parts):
            if held + share > round_words:
                rounds.append([])
                held = 0
            before = rounds[-1][-1] if rounds[-1] else None
            first = before.first_block + before.blocks if before else 0
            rounds[-1].append(Filter(shard, part, parts, first, share // WORDS_A_BLOCK + 1))
            held += share
    return rounds


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Places of words of one length, at most ``CHUNK`` at once."""
    groups = defaultdict(list)
    for at, word in enumerate(words):
        groups[len(word)].append(at)
    for length, places in groups.items():
        for i in range(0, len(places), CHUNK):
            yield length, places[i : i + CHUNK]


def _bits(source: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane and bit of one probe."""
    place = (source >> np.uint64(9 * probe)) & np.uint64(511)
    return (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


def _marked(batches: Iterator[pa.RecordBatch], filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        lanes, bits = [], []
        for length, places in _by_length(words):
            hashes = _hashes(_letters([words[p] for p in places]))
            for f in (f for f in filters if f.shard == shard_of(length)):
                _, block, source = f.places(hashes)
                for probe in range(PROBES):
                    lane, bit = _bits(source, probe)
                    lanes.append(block * LANES + lane)
                    bits.append(bit)
        if lanes:
            distinct, code = np.unique(np.concatenate(lanes), return_inverse=True)
            merged = np.zeros(len(distinct), np.uint64)
            np.bitwise_or.at(merged, code, np.concatenate(bits))
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(merged.view(np.int64))], names=["lane", "bits"])


def filter_lanes(words: DataFrame, filters: list[Filter]) -> np.ndarray:
    """All filters of a round as one array, merged by Spark; its size follows from ``filters``, so it fits the driver."""
    marked = words.select("word").mapInArrow(lambda b: _marked(b, filters), "lane long, bits long")
    merged = marked.groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
    lanes = np.zeros((filters[-1].first_block + filters[-1].blocks) * LANES, np.uint64)
    lanes[merged.column("lane").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    return lanes


def _known(hashes: np.ndarray, filters: list[Filter], lanes: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter knows; each probe is made for those that passed the one before."""
    found = []
    for f in filters:
        mine, block, source = f.places(hashes)
        for probe in range(PROBES):
            lane, bit = _bits(source, probe)
            passed = lanes[block * LANES + lane] & bit != 0
            mine, block, source = mine[passed], block[passed], source[passed]
        found.append(mine)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def known_edits(words: list[str], filters: list[Filter], lanes: np.ndarray) -> Iterator[tuple[int, str]]:
    """(place of a word, edit) for replacements by larger letters and for deletions that the filters know."""
    for length, places in _by_length(words):
        same = [f for f in filters if f.shard == shard_of(length)]
        shorter = [f for f in filters if f.shard == shard_of(length - 1)] if length > MIN_CHARS else []
        if not same and not shorter:
            continue
        letters, powers = _letters([words[p] for p in places]), _powers(length)
        terms = letters * powers
        ends = np.cumsum(terms, axis=1, dtype=np.uint64)
        whole = ends[:, -1]
        for at in range(length):
            old = letters[:, at]
            if same:
                row, column = np.nonzero(LETTERS[None, :] > old[:, None])
                edits = whole[row] + (LETTERS[column] - old[row]) * powers[at]
                for hit in _known(edits, same, lanes).tolist():
                    word = words[places[row[hit]]]
                    yield places[row[hit]], word[:at] + chr(int(LETTERS[column[hit]])) + word[at + 1 :]
            if shorter:
                # Of equal letters in a row, any one taken out leaves the same word.
                rows = np.flatnonzero(old != letters[:, at - 1]) if at else np.arange(len(places))
                head = ends[rows, at] - terms[rows, at]
                edits = head + (whole[rows] - ends[rows, at]) * np.uint64(BASE_INVERSE)
                for hit in _known(edits, shorter, lanes).tolist():
                    word = words[places[rows[hit]]]
                    yield places[rows[hit]], word[:at] + word[at + 1 :]


def _probed(batches: Iterator[pa.RecordBatch], filters: list[Filter], shared) -> Iterator[pa.RecordBatch]:
    lanes = shared.value
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        hits = list(known_edits(words, filters, lanes))
        own = [at for at, _ in hits]
        columns = [pa.array([words[at] for at in own], pa.string()), pa.array(counts[own], pa.int64()), pa.array([e for _, e in hits], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "edit"])


def near_pairs(words: DataFrame, round_words: int = ROUND_WORDS) -> DataFrame:
    """``word, n, near, near_n`` in both directions, over a stored vocabulary ``word, n``."""
    spark = words.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LONGEST_SHARD))
    sizes = {r.shard: r["n_words"] for r in words.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n_words")).collect()}
    tasks = max(spark.sparkContext.defaultParallelism, sum(sizes.values()) // TASK_WORDS)
    dealt = words.repartition(tasks, "word")
    known = None
    for number, filters in enumerate(rounds_of(sizes, round_words)):
        shared = spark.sparkContext.broadcast(filter_lanes(words, filters))
        found = dealt.mapInArrow(lambda b, f=filters, s=shared: _probed(b, f, s), "word string, n long, edit string")
        found = landed(found, f"edits{number}")
        shared.unpersist()
        known = found if known is None else known.unionByName(found)
    if known is None:
        known = words.withColumn("edit", F.col("word")).where(F.lit(False))
    pairs = known.join(words.toDF("edit", "edit_n"), "edit")
    there = pairs.select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    back = pairs.select(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return there.unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (``word, form``), by jumping over twice as many forms each time.

    A form is at least ``FORM_RATIO`` times as frequent as its word, so chains end, after a few jumps.
    """
    found = landed(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while found.where("open").limit(1).count():
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = found.join(further, "root", "left")
        found = landed(
            jumped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")), "roots"
        )
    return found.select("word", "root")


def variants(docs: DataFrame, round_words: int = ROUND_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id, text``).

    A word's form is its most frequent near word (of equals the first in code-point order) if that is at least
    ``FORM_RATIO`` times as frequent, its root the last word along the forms. A null text holds no words, a null
    ``doc_id`` is written ``-``, repeated rows count each time, other columns play no part. Without words the
    result is empty.
    """
    words = landed(vocabulary(docs), "vocabulary")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(words, round_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    told = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= FORM_RATIO * F.col("n")
    told = told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    told = landed(told, "forms")
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


SQL = """
    WITH RECURSIVE crc_table AS (
      SELECT list(v ORDER BY n) AS crcs FROM (
        SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v
        FROM range(256) t(n))),
    found AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\\x{00C0}-\\x{00FF}]+')) AS run
      FROM documents),
    runs AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY doc_id, run),
    coded AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS code FROM runs),
    hashed AS (
      SELECT run, n, xor(4294967295, list_reduce(
          list_prepend(4294967295, list_transform(range(length(code) // 2),
            lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT))),
          lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS h
      FROM coded, crc_table),
    slips AS (
      SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
          || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
      FROM hashed),
    words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    cuts AS (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut
      FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    near AS (
      SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, w.word, w.n FROM cuts a JOIN words w ON a.cut = w.word
      UNION SELECT w.word, a.word, a.n FROM cuts a JOIN words w ON a.cut = w.word),
    best AS (
      SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
    told AS (
      SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form,
        CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
      FROM words w LEFT JOIN best b ON w.word = b.word),
    climbs(word, here, k) AS (
      SELECT word, word, 0 FROM told
      UNION ALL
      SELECT c.word, t.form, c.k + 1 FROM climbs c JOIN told t ON t.word = c.here WHERE t.form IS NOT NULL),
    ends AS (SELECT word, arg_max(here, k) AS root FROM climbs GROUP BY word)
    SELECT t.word, t.form, e.root, t.n, t.n_near, t.form_n FROM told t JOIN ends e ON t.word = e.word"""
