"""Masked pseudo-likelihood: every word is predicted from the words on both sides of it.

A small network in numpy: the embeddings of the words in a window, weighted by their place, make a hidden
vector; it predicts the class of the masked word in two steps, first the high and then the low part of its
number. The ``OWN_CLASSES`` most frequent words are classes of their own; the others belong to classes by a hash of
their last letters, which tell language and form. Within its class a word has the probability of its share in all
words of the class, counted over the whole corpus; these counts are a Spark table with a row per distinct word. A
document's score is the sum of the log-probabilities of its words: of the class given the words around it, and
of the word given its class.

Training sees every document once. In each round the tasks start from the same network, train on their own
rows of that round, and send what they reached; Spark averages it, weighted by words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stockaudit.llm import arrowtext, words
from stockaudit.llm.tables import landed

PARTS = 32
VOCABULARY = PARTS * PARTS
# Words with a class of their own, and letters at a word's end that tell the class of any other.
OWN_CLASSES = VOCABULARY // 2
LAST_LETTERS = 2
REACH = 2
WIDTH = 16
ROUNDS = 2
BATCH = 4096
RATE = 0.1
SEED = 11
# Words that make up at least this share of all are at most so many that every task can hold their counts.
FREQUENT_SHARE = 1 / 65_536

_OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
SHAPES = {
    "words": (VOCABULARY + 1, WIDTH),  # the last one stands beyond a document's ends
    "places": (len(_OFFSETS), WIDTH),
    "hidden": (WIDTH,),
    "high": (WIDTH, PARTS),
    "high_bias": (PARTS,),
    "given": (PARTS, WIDTH),
    "low": (WIDTH, PARTS),
    "low_bias": (PARTS, PARTS),
}
SIZE = sum(map(math.prod, SHAPES.values()))


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters of a network as named parts of one array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def fresh() -> np.ndarray:
    flat = (np.random.default_rng(SEED).standard_normal(SIZE) * 0.1).astype(np.float32)
    named = views(flat)
    named["places"][:] = 1.0
    for bias in ("hidden", "high_bias", "low_bias"):
        named[bias][:] = 0.0
    return flat


def identity(word: str) -> int:
    """The number by which a word is counted: its hash, with the class of its last letters in the low bits."""
    ending = OWN_CLASSES + xxhash.xxh3_64_intdigest(word[-LAST_LETTERS:]) % (VOCABULARY - OWN_CLASSES)
    return xxhash.xxh3_64_intdigest(word) // VOCABULARY * VOCABULARY + ending


def identities(pieces: list[str]) -> np.ndarray:
    """``identity`` of each word; what last letters stand for is worked out once for all words that share them."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
    endings = [piece[-LAST_LETTERS:] for piece in pieces]
    classes = {ending: identity(ending) % VOCABULARY for ending in set(endings)}
    low = np.fromiter(map(classes.__getitem__, endings), np.uint64, len(pieces))
    return hashes // np.uint64(VOCABULARY) * np.uint64(VOCABULARY) + low


def _classed(own: np.ndarray) -> arrowtext.UnkeptPieces:
    """Numbers of words whose low bits are their class: their place in ``own`` (identities), or that of their last letters."""
    order = np.argsort(own).astype(np.uint64)
    ordered = own[order]

    def work(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = identities([piece for piece in pieces if piece])
        if len(own):
            at = np.minimum(np.searchsorted(ordered, found), len(own) - 1)
            classed = found // np.uint64(VOCABULARY) * np.uint64(VOCABULARY) + order[at]
            found = np.where(ordered[at] == found, classed, found)
        return found, np.fromiter(map(bool, pieces), np.int64, len(pieces))

    return arrowtext.UnkeptPieces(work, np.uint64)


_tables: dict[bytes, arrowtext.UnkeptPieces] = {}
NO_OWN = np.zeros(0, np.uint64)


def table_of(own: np.ndarray) -> arrowtext.UnkeptPieces:
    """The table of a task's process; only the last one is kept."""
    key = own.tobytes()
    if key not in _tables:
        _tables.clear()
        _tables[key] = _classed(own)
    return _tables[key]


def class_of(values: np.ndarray) -> np.ndarray:
    return (values % np.uint64(VOCABULARY)).astype(np.int64)


def numbered(texts: pa.Array, own: np.ndarray = NO_OWN) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of all texts, and where each text begins."""
    values, starts = words.hashed_words(texts, table_of(own))
    return class_of(values), starts


def windows(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word the numbers in its window, its own left out; places beyond the text hold the border."""
    counts = np.diff(starts)
    gap = REACH * np.arange(1, len(counts) + 1)
    place = np.arange(len(ids)) + np.repeat(gap, counts)
    padded = np.full(len(ids) + REACH * (len(counts) + 1), VOCABULARY, np.int64)
    padded[place] = ids
    return np.stack([padded[place + o] for o in _OFFSETS])


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place, and their sums. Hidden values lie between -1 and 1 and weights stay small, so no maximum is taken off first."""
    np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
    return logits, logits @ np.ones((logits.shape[1], 1), logits.dtype)


def forward(p: dict[str, np.ndarray], near: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Hidden vectors, and of both parts of each masked word the probabilities times their sums, with these sums."""
    high, low = ids // PARTS, ids % PARTS
    # A row for each word of the vocabulary, times the weights of each place, is less than one for each word of a window.
    h = np.take(p["words"] * p["places"][0], near[0], axis=0)
    for n, weights in zip(near[1:], p["places"][1:]):
        h += np.take(p["words"] * weights, n, axis=0)
    h += p["hidden"]
    np.tanh(h, out=h)
    logits = h @ p["high"]
    logits += p["high_bias"]
    first, first_sum = _exponentials(logits)
    g = np.take(p["given"], high, axis=0)
    g += h
    np.tanh(g, out=g)
    logits = g @ p["low"]
    logits += np.take(p["low_bias"], high, axis=0)
    second, second_sum = _exponentials(logits)
    return {"high": high, "low": low, "h": h, "first": first, "first_sum": first_sum, "g": g, "second": second, "second_sum": second_sum}


def log_probabilities(p: dict[str, np.ndarray], near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    f, row = forward(p, near, ids), np.arange(len(ids))
    first = f["first"][row, f["high"]] / f["first_sum"][:, 0]
    second = f["second"][row, f["low"]] / f["second_sum"][:, 0]
    return np.log(np.maximum(first, 1e-30)) + np.log(np.maximum(second, 1e-30))


def gradient(p: dict[str, np.ndarray], near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability, in the layout of ``views``."""
    f, row, n = forward(p, near, ids), np.arange(len(ids)), np.float32(len(ids))
    flat = np.zeros(SIZE, np.float32)
    out = views(flat)
    high, low, first, second = f["high"], f["low"], f["first"], f["second"]
    first /= f["first_sum"]
    second /= f["second_sum"]
    # Sums over the words with the same high part, as a product with a table of zeros and ones.
    same = np.zeros((len(ids), PARTS), np.float32)
    same[row, high] = 1 / n
    second[row, low] -= 1
    out["low"][:] = f["g"].T @ second / n
    out["low_bias"][:] = same.T @ second
    to_g = (second @ p["low"].T) * (1 - f["g"] * f["g"])
    out["given"][:] = same.T @ to_g
    first[row, high] -= 1
    out["high"][:] = f["h"].T @ first / n
    out["high_bias"][:] = first.sum(axis=0) / n
    to_h = (first @ p["high"].T + to_g) * (1 - f["h"] * f["h"]) / n
    out["hidden"][:] = to_h.sum(axis=0)
    # The same word's gradients lie together after a sort, and are summed where they begin.
    flat_near = near.astype(np.int16).ravel()
    order = np.argsort(flat_near, kind="stable")
    sorted_near = flat_near[order]
    begins = np.flatnonzero(np.concatenate(([True], sorted_near[1:] != sorted_near[:-1])))
    to_words = (to_h[None] * p["places"][:, None]).reshape(-1, WIDTH)
    out["words"][sorted_near[begins]] = np.add.reduceat(np.take(to_words, order, axis=0), begins, axis=0)
    for k, n_th in enumerate(near):
        out["places"][k] = np.einsum("nd,nd->d", np.take(p["words"], n_th, axis=0), to_h)
    return flat


def train(flat: np.ndarray, slices: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """Parameters after one pass by adaptive gradient steps, and the number of words seen."""
    flat, seen = flat.copy(), 0
    squares = np.full(SIZE, 1e-6, np.float32)
    p = views(flat)
    for near, ids in slices:
        for at in range(0, len(ids), BATCH):
            g = gradient(p, near[:, at : at + BATCH], ids[at : at + BATCH])
            squares += g * g
            flat -= RATE * g / np.sqrt(squares)
        seen += len(ids)
    return flat, seen


def _sliced(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in arrowtext.slices(batches, "text"):
        ids, starts = numbered(arrowtext.text_of(batch, "text"), own)
        yield windows(ids, starts), ids


def _trained(batches: Iterator[pa.RecordBatch], flat: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    new, seen = train(flat, _sliced(batches, own))
    if seen:
        values = [pa.array(np.arange(SIZE + 1)), pa.array(np.append(new.astype(np.float64) * seen, float(seen)))]
        yield pa.RecordBatch.from_arrays(values, names=["place", "total"])


@dataclass(frozen=True)
class Model:
    """A network, the identities of the words with a class of their own, and the landed counts of all words."""

    flat: np.ndarray
    own: np.ndarray
    counts: DataFrame


def own_classes(counts: DataFrame) -> np.ndarray:
    """Identities of the most frequent words, of equally frequent ones those with the smaller identity."""
    rows = counts.orderBy(F.desc("n"), "word").limit(OWN_CLASSES).collect()
    return np.array([r.word for r in rows], np.int64).view(np.uint64)


def learn(docs: DataFrame) -> Model:
    """A network trained on all words of all documents. Its fixed size bounds what reaches the driver."""
    counts = word_counts(docs)
    own, flat = own_classes(counts), fresh()
    for number in range(ROUNDS):
        rows = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == number)
        sums = rows.mapInArrow(lambda b, start=flat: _trained(b, start, own), "place long, total double").groupBy("place").agg(F.sum("total").alias("total"))
        total = np.zeros(SIZE + 1)
        for r in sums.collect():
            total[r.place] = r.total
        if total[SIZE]:
            flat = (total[:SIZE] / total[SIZE]).astype(np.float32)
    return Model(flat, own, counts)


# Distinct words of slices that a task holds before it adds up their counts.
HELD_WORDS = 1 << 19


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added_up() -> pa.RecordBatch:
        values, code = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        n = np.bincount(code, np.concatenate([n for _, n in held]), len(values)).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in arrowtext.slices(batches, "text"):
        held.append(words.counted_words(arrowtext.text_of(batch, "text"), table_of(NO_OWN)))
        if sum(len(v) for v, _ in held) >= HELD_WORDS:
            yield added_up()
    if held:
        yield added_up()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each word, by its identity, occurs in the corpus; landed."""
    each = docs.select("text").mapInArrow(_words_counted, "word long, n long")
    return landed(each.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")


def class_totals(counts: DataFrame, own: np.ndarray) -> np.ndarray:
    """Words in each class; as many numbers as classes reach the driver."""
    # The classes are a power of two, so the last bits of an identity tell the class of the last letters.
    rows = counts.groupBy(F.col("word").bitwiseAND(F.lit(VOCABULARY - 1)).alias("class")).agg(F.sum("n").alias("n")).collect()
    out = np.zeros(VOCABULARY)
    for r in rows:
        out[r["class"]] = r.n
    signed = own.view(np.int64).tolist()
    places = {word: place for place, word in enumerate(signed)}
    for r in counts.where(F.col("word").isin(signed)).collect() if signed else []:
        out[places[r.word]] = r.n
        out[r.word & (VOCABULARY - 1)] -= r.n
    return out


def _scored_words(batches: Iterator[pa.RecordBatch], flat: np.ndarray, own: np.ndarray, totals: np.ndarray, known: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums without the counts of rare words, whose identities and -log of their class's words go along."""
    p, table = views(flat), table_of(own)
    log_totals = np.log(np.maximum(totals, 1))
    # A word with a class of its own is all of its class.
    log_totals[:OWN_CLASSES] = 0
    for batch in arrowtext.slices(batches, "text"):
        values, starts = words.hashed_words(arrowtext.text_of(batch, "text"), table)
        ids = class_of(values)
        near = windows(ids, starts)
        each = [log_probabilities(p, near[:, at : at + BATCH], ids[at : at + BATCH]) for at in range(0, len(ids), BATCH)]
        each = np.concatenate(each, dtype=np.float64) if each else np.zeros(0)
        each -= log_totals[ids]
        others = np.flatnonzero(ids >= OWN_CLASSES)
        signed = values.view(np.int64)[others]
        at = np.minimum(np.searchsorted(known, signed), max(0, len(known) - 1))
        frequent = known[at] == signed if len(known) else np.zeros(len(signed), bool)
        each[others[frequent]] += shares[at[frequent]]
        rare = np.zeros(len(ids), bool)
        rare[others[~frequent]] = True
        running = np.concatenate(([0.0], np.cumsum(each)))
        cuts = np.concatenate(([0], np.cumsum(rare)))[starts]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(signed[~frequent]))
        columns = [batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)), pa.array(running[starts[1:]] - running[starts[:-1]]), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "sum", "rare"])


def score_words(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of each row; ``model`` has learned from the same ``docs``.

    Frequent words, a bounded number, are counted where they are met; the rare ones are joined to the table
    of counts, in which none of them has many rows. Null text is empty; without a word the sum is 0 and the mean
    null. Equal texts score alike; repeated rows and null ids stay, other columns have no part.
    """
    flat, own, counts = model.flat, model.own, model.counts
    totals = class_totals(counts, own)
    bound = totals.sum() * FREQUENT_SHARE
    held = counts.where(F.col("n") >= bound).toArrow().sort_by("word")
    known, shares = held["word"].to_numpy(), np.log(held["n"].to_numpy().astype(np.float64))
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    fields = "row long, doc_id long, n_tokens long, sum double, rare array<long>"
    found = landed(rows.mapInArrow(lambda b: _scored_words(b, flat, own, totals, known, shares), fields), "scored")
    rare = found.select("row", F.explode("rare").alias("word"))
    rare = rare.join(counts.where(F.col("n") < bound), "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    out = found.drop("rare").join(rare, "row", "left")
    total = F.col("sum") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", total.alias("log_prob"), mean.alias("mean_log_prob"))
