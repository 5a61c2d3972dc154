"""Near duplicates by consistent weighted sampling over TF-IDF word shingles.

Texts with the same words are one text. Of each other text an improved consistent weighted sample of its
shingles is drawn, banded, and texts that share a band are compared with leaders of their bucket by
weighted Jaccard similarity over their whole texts. Links make classes.

Weights are (1 + ln tf) times an inverse document frequency between ``LEAST_WEIGHT`` and 1. Frequencies are
counted over all documents in hash buckets; a bucket shows what share of the documents holds its most
frequent shingle once the even load of rare ones is taken off, at every size of the corpus. The bound below
keeps copies linked whose shared shingles are frequent just because there are so many copies.

Leaders avoid comparing most pairs of a bucket. In the first round every member is compared with a random
one of its bucket; buckets that still span several classes are led by the member with most links in the
second. Of what then still spans several classes, every pair of different classes is compared: members outside
a bucket's largest class with each other and with that class, in blocks of two parts of bounded size. A block's
pairs are one list, and its texts are sent and hashed once a block and not once a pair; the leaders' pairs are
dealt to blocks likewise. Only pairs whose size and sampled agreement allow 0.8 are compared. So classes are
those of all pairs that share a band; in this last step a row is sent once for each part outside its bucket's
largest class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stockaudit.llm import arrowtext, words
from stockaudit.llm.tables import forget, landed, split_by_membership
from stockaudit.operators.joins import BROADCAST_ROWS, filter_words, may_be_in, membership_filter, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
SAMPLES = BANDS * ROWS
FREQUENCY_BITS = 16
FREQUENCY_BUCKETS = 1 << FREQUENCY_BITS
# Share of documents from which a shingle counts as frequent, and the least weight.
FREQUENT_SHARE = 1e-3
LEAST_WEIGHT = 0.9
# Of 24 samples kept to two bits each, two texts of similarity 0.8 agree in 20.4 on average, deviation 1.75.
LEAST_AGREEMENT = 13
LEADER_ROUNDS = 2
# Texts in a part of a bucket on average, and the weight (about the number of shingles) of all its texts.
PART_ROWS = 256
PART_WEIGHT = 1 << 19
# Which half of a block's two parts a row is in, or that the block is one part, compared with itself.
LEFT, RIGHT, WITHIN = 0, 1, 2
_PAIRS_AT_ONCE = 1 << 16

SIGNED = "key_high long, key_low long, weight double, agreement long, bands array<long>"
CARRIED = "c_"
PAIR_LISTS = "block long, pairs array<struct<lead: long, row: long>>"


def shingles(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text's words and their counts; a text of fewer words is one shingle."""
    if not len(values):
        return values, values.astype(np.int64)
    runs = np.sort(words.run_hashes(values, min(SHINGLE, len(values)))[: max(1, len(values) - SHINGLE + 1)])
    begins = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    return runs[begins], np.diff(np.append(begins, len(runs)))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def weights(hashes: np.ndarray, counts: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return inverse[bucket_of(hashes)] * (1 + np.log(counts))


def inverse_frequencies(buckets: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of a shingle of each bucket, from the number of documents in it."""
    share = np.maximum(buckets - buckets.mean(), 0) / max(1, n_docs)
    with np.errstate(divide="ignore"):
        return np.clip(np.log(share) / np.log(FREQUENT_SHARE), LEAST_WEIGHT, 1.0)


_SEEDS = words.mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_QUANTILES = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Of the gamma distribution with shape 2, at the middles of equal shares, by bisection."""
    share = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    low, high = np.zeros(_QUANTILES), np.full(_QUANTILES, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


_R = _gamma_quantiles()
_LOG_C, _INVERSE_R, _R = np.log(_R).astype(np.float32), (1 / _R).astype(np.float32), _R.astype(np.float32)


def sample(hashes: np.ndarray, weight: np.ndarray, rows_at_once: int = 2048) -> np.ndarray:
    """The improved consistent weighted sample: a hash of (shingle, level) for each of ``SAMPLES`` draws.

    A shingle and a draw give 64 bits: 16 each for two gamma variables, r and c, by their quantiles, and 32
    for a shift. The shingle whose quantised weight makes the smallest value wins. Texts agree in a draw
    with the probability of their weighted similarity.
    """
    best = np.full(SAMPLES, np.inf, np.float32)
    found = np.zeros(SAMPLES, np.uint64)
    log_weight = np.log(weight).astype(np.float32)[:, None]
    draw = np.arange(SAMPLES)
    for at in range(0, len(hashes), rows_at_once):
        own = hashes[at : at + rows_at_once]
        bits = words.mixed(own[:, None] ^ _SEEDS)
        by_r = (bits >> np.uint64(48)).astype(np.int32)
        by_c = (bits >> np.uint64(32)).astype(np.uint16)
        shift = bits.astype(np.uint32).astype(np.float32) * np.float32(2.0**-32)
        level = np.floor(log_weight[at : at + rows_at_once] * np.take(_INVERSE_R, by_r) + shift)
        value = np.take(_LOG_C, by_c) - np.take(_R, by_r) * (level - shift + 1)
        place = value.argmin(axis=0)
        least = value[place, draw]
        wins = least < best
        best = np.where(wins, least, best)
        levels = level[place, draw].astype(np.int64).astype(np.uint64)
        found = np.where(wins, words.mixed(own[place] + levels * np.uint64(0x9E3779B97F4A7C15)), found)
    return found


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts given as sorted distinct shingles and their weights."""
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][in_a], b[1][in_b]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FREQUENCY_BUCKETS, np.int64), 0
    for batch in arrowtext.slices(batches, "text"):
        values, starts = words.hashed_words(arrowtext.text_of(batch, "text"))
        kept = []
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            if b > a:
                kept.append(bucket_of(shingles(values[a:b])[0]))
        n += len(kept)
        if kept:
            total += np.bincount(np.concatenate(kept), minlength=FREQUENCY_BUCKETS)
    held = np.flatnonzero(total)
    # The number of documents goes along as one more bucket.
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, FREQUENCY_BUCKETS)), pa.array(np.append(total[held], n))], names=["bucket", "n"])


def learn_weights(docs: DataFrame) -> np.ndarray:
    """Bucket weights counted over all documents; the number of buckets bounds what reaches the driver."""
    rows = docs.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(FREQUENCY_BUCKETS + 1)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return inverse_frequencies(counts[:-1], int(counts[-1])).astype(np.float32)


def _signed(batches: Iterator[pa.RecordBatch], inverse: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in arrowtext.slices(batches, f"{CARRIED}text"):
        texts = arrowtext.text_of(batch, f"{CARRIED}text")
        values, starts = words.hashed_words(texts)
        keys, sums, agreements, bands = [], [], [], []
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            own = values[a:b]
            # Texts without a word are equal if they are the same text; null is the empty one.
            raw = own.tobytes() if b > a else b"\0" + texts[i].as_py().encode()
            keys.append(np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64))
            if b == a:
                sums.append(0.0)
                agreements.append(0)
                bands.append([])
                continue
            hashes, counts = shingles(own)
            weight = weights(hashes, counts, inverse)
            found = sample(hashes, weight)
            sums.append(float(weight.sum()))
            agreements.append(int((found >> np.uint64(62)) @ (np.uint64(1) << np.arange(0, 2 * SAMPLES, 2, dtype=np.uint64))))
            grouped = found.reshape(BANDS, ROWS)
            bands.append(words.run_hashes(grouped.ravel(), ROWS)[::ROWS].view(np.int64).tolist())
        high, low = np.array(keys).reshape(-1, 2).T
        columns = [pa.array(high), pa.array(low), pa.array(sums, pa.float64()), pa.array(agreements, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *columns], names=[*batch.schema.names, "key_high", "key_low", "weight", "agreement", "bands"]
        )


def _agree(a: Column, b: Column) -> Column:
    """Samples whose two bits are the same."""
    odd = a.bitwiseXOR(b)
    return SAMPLES - F.bit_count((odd.bitwiseOR(F.shiftright(odd, 1))).bitwiseAND(F.lit(0x5555555555555555)))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after the other; they lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy()
        if held and held[0].column("block")[0].as_py() != blocks[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the list of its pairs of different classes that size and samples allow, in the first band they share."""
    for table in _grouped(batches):
        row, label, side, weight = (table.column(c).to_numpy() for c in ("row", "label", "side", "weight"))
        agreement = table.column("agreement").to_numpy().view(np.uint64)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        if side[0] == WITHIN:
            a, b = np.triu_indices(len(row), 1)
        else:
            left, right = np.flatnonzero(side == LEFT), np.flatnonzero(side == RIGHT)
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        keep = (label[a] != label[b]) & (np.minimum(weight[a], weight[b]) >= SIMILARITY * np.maximum(weight[a], weight[b]) - 1e-6)
        a, b = a[keep], b[keep]
        odd = agreement[a] ^ agreement[b]
        keep = SAMPLES - np.bitwise_count((odd | odd >> np.uint64(1)) & np.uint64(0x5555555555555555)) >= LEAST_AGREEMENT
        a, b = a[keep], b[keep]
        if len(a):
            keep = (bands[a] == bands[b]).argmax(axis=1) == table.column("band")[0].as_py()
            a, b = row[a[keep]], row[b[keep]]
        if len(a):
            pairs = pa.StructArray.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["lead", "row"])
            lists = pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([table.column("block").combine_chunks().slice(0, 1), lists], names=["block", "pairs"])


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``similarity`` of one text with each of the others, none of them empty."""
    hashes, weight = np.concatenate([o[0] for o in others]), np.concatenate([o[1] for o in others])
    at = np.minimum(np.searchsorted(one[0], hashes), len(one[0]) - 1)
    shared = np.where(one[0][at] == hashes, np.minimum(one[1][at], weight), 0.0)
    begins = np.cumsum([0, *[len(o[0]) for o in others[:-1]]])
    both = np.add.reduceat(shared, begins)
    return both / (one[1].sum() + np.add.reduceat(weight, begins) - both)


def _checked(batches: Iterator[pa.RecordBatch], inverse: np.ndarray) -> Iterator[pa.RecordBatch]:
    for table in _grouped(batches):
        texts = table.filter(pc.is_valid(table.column("row"))).combine_chunks()
        values, starts = words.hashed_words(pc.cast(texts.column("text").combine_chunks(), pa.large_string()))
        known = {}
        for row, a, b in zip(texts.column("row").to_pylist(), starts.tolist(), starts[1:].tolist()):
            hashes, counts = shingles(values[a:b])
            known[row] = (hashes, weights(hashes, counts, inverse))
        listed = pc.list_flatten(table.column("pairs").combine_chunks())
        pairs = np.stack([pc.struct_field(listed, name).to_numpy() for name in ("lead", "row")], axis=1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        found = []
        for own in np.split(pairs, np.flatnonzero(pairs[1:, 0] != pairs[:-1, 0]) + 1):
            found.append(own[similarities(known[int(own[0, 0])], [known[r] for r in own[:, 1].tolist()]) >= SIMILARITY])
        lead, row = np.concatenate(found).T
        yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(row)], names=["lead", "row"])


def open_pairs(state: DataFrame, texts: DataFrame) -> DataFrame:
    """``block, pairs``: each pair of texts of one bucket and different classes that may be similar, once.

    A bucket's members in and outside its largest class are dealt into parts by a hash. Every part outside
    meets every part, itself among them; a block holds the rows of two parts, or of one.
    """
    parts = lambda n, w: F.ceil(F.greatest(n / PART_ROWS, w / PART_WEIGHT)).cast("int")
    sizes = state.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    most = F.max(F.struct("n", "label", "w"))
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), most.alias("most")).where(F.col("n") > F.col("most.n"))
    sizes = sizes.select(
        "bucket", F.col("most.label").alias("largest"), parts(F.col("most.n"), F.col("most.w")).alias("inner"),
        F.greatest(F.lit(1), parts(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w"))).alias("outer"),
    )
    dealt = state.join(stored(sizes), "bucket").join(texts.select("row", "bands"), "row").withColumn("inside", F.col("label") == F.col("largest"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row", "bucket"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    part = F.col("part")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda inside, a, b, side: F.struct(F.lit(inside).alias("inside"), a.alias("a"), b.alias("b"), side.alias("side"))
    among = F.transform(
        up_to("outer"),
        lambda q: block(False, F.least(part, q), F.greatest(part, q), F.when(part < q, LEFT).when(part > q, RIGHT).otherwise(WITHIN)),
    )
    across = F.transform(up_to("inner"), lambda q: block(True, part, q, F.lit(LEFT)))
    inside = F.transform(up_to("outer"), lambda q: block(True, q, part, F.lit(RIGHT)))
    dealt = dealt.withColumn("b", F.explode(F.when(F.col("inside"), inside).otherwise(F.concat(among, across))))
    dealt = dealt.select(
        F.xxhash64("bucket", "b.inside", "b.a", "b.b").alias("block"), "b.side", "band", "row", "label", "weight", "agreement", "bands"
    )
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_candidates, PAIR_LISTS)


def linked(lists: DataFrame, signed: DataFrame, inverse: np.ndarray) -> DataFrame:
    """The pairs ``lead, row`` of each block's list whose whole texts are similar enough; a block gets each of its texts once.

    Texts that no block needs stay where they are: few needed rows are sent to all texts, many pass a filter over them.
    """
    listed = F.array_distinct(F.concat(F.transform("pairs", lambda p: p["lead"]), F.transform("pairs", lambda p: p["row"])))
    needed = landed(lists.select("block", F.explode(listed).alias("row")), "needed")
    texts = signed.select("row", F.col(f"{CARRIED}text").alias("text"))
    size = needed.count()
    if size <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(needed), "row")
    else:
        bits = filter_words(size)
        texts = texts.where(may_be_in(F.col("row"), membership_filter(needed.select("row"), bits), bits)).join(needed, "row")
    both = texts.select("block", "row", "text").unionByName(lists, allowMissingColumns=True)
    sent = both.repartition("block").sortWithinPartitions("block")
    found = landed(sent.mapInArrow(lambda b: _checked(b, inverse), "lead long, row long"), "links")
    forget(needed)
    return found


def components(links: DataFrame) -> DataFrame:
    """``row, label``: the smallest row of each linked row's component, by passing on minima until none changes."""
    both = stored(links.select("lead", "row").union(links.select("row", "lead")).toDF("a", "b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        around = both.join(labels, both["b"] == labels["row"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, F.col("row") == F.col("a")).select("row", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A label's own label is as small or smaller: jumping to it shortens long chains.
        jump = labels.select(F.col("row").alias("label"), F.col("label").alias("further"))
        new = stored(nearer.join(jump, "label", "left").select("row", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("row", "label")
        labels = new.select("row", "label")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the landed documents with number and text key, the class of each text key).

    The first has ``row``, ``key_high``, ``key_low`` and every column of ``docs`` under a prefix; the second
    ``key_high, key_low, class_row``, where ``class_row`` is the number of one row of the class.
    """
    inverse = learn_weights(docs)
    numbered = docs.select(*[F.col(c).alias(f"{CARRIED}{c}") for c in docs.columns], F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([*numbered.schema.fields, *T.StructType.fromDDL(SIGNED).fields])
    signed = landed(numbered.mapInArrow(lambda b: _signed(b, inverse), schema), "signed")
    key = ["key_high", "key_low"]
    firsts = signed.groupBy(*key).agg(F.min("row").alias("row"))
    # One row for each distinct text that has words.
    texts = landed(
        signed.select("row", "weight", "agreement", "bands").where(F.size("bands") > 0).join(firsts.select("row"), "row", "left_semi"), "texts"
    )
    exploded = texts.select("row", "weight", "agreement", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "band", "row", "weight", "agreement"
    )
    crowded = stored(exploded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket"))
    members = landed(exploded.join(crowded, "bucket"), "members")

    links: DataFrame | None = None
    tested: DataFrame | None = None
    labels = degrees = None

    def placed() -> DataFrame:
        if links is None:
            return members.withColumns({"label": F.col("row"), "degree": F.lit(0)})
        state = members.join(labels, "row", "left").join(degrees, "row", "left")
        return state.withColumns({"label": F.coalesce("label", "row"), "degree": F.coalesce("degree", F.lit(0))})

    for _ in range(LEADER_ROUNDS):
        # Before there are links the draw alone decides.
        order = F.struct(F.col("degree"), F.xxhash64("row", "bucket").alias("draw"), "row", "label", "weight", "agreement")
        state = landed(placed(), "state")
        spread = state.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where(F.col("a") != F.col("b"))
        leads = state.groupBy("bucket").agg(F.max(order).alias("lead"), F.count("*").alias("n"), F.sum("weight").alias("w")).join(spread.select("bucket"), "bucket", "left_semi")
        mine = stored(leads.select("bucket", F.ceil(F.greatest(F.col("n") / PART_ROWS, F.col("w") / PART_WEIGHT)).alias("parts"), *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("row", "label", "weight", "agreement")]))
        near = (
            (F.col("label") != F.col("lead_label"))
            & (F.least("weight", "lead_weight") >= SIMILARITY * F.greatest("weight", "lead_weight") - 1e-6)
            & (_agree(F.col("agreement"), F.col("lead_agreement")) >= LEAST_AGREEMENT)
        )
        # A bucket's members meet their leader in parts.
        part = F.pmod(F.xxhash64("row"), F.col("parts"))
        pairs = state.join(mine, "bucket").where(near).select(
            F.least("lead_row", "row").alias("lead"), F.greatest("lead_row", "row").alias("row"), F.xxhash64("lead_row", part).alias("block")
        )
        pairs = pairs.groupBy("lead", "row").agg(F.min("block").alias("block"))
        if tested is not None:
            pairs = pairs.join(tested, ["lead", "row"], "left_anti")
        pairs = landed(pairs, "pairs")
        tested = pairs.select("lead", "row")
        fresh = linked(pairs.groupBy("block").agg(F.collect_list(F.struct("lead", "row")).alias("pairs")), signed, inverse)
        links = fresh if links is None else links.union(fresh)
        labels = components(links)
        degrees = stored(links.select("lead").union(links.select("row")).groupBy(F.col("lead").alias("row")).agg(F.count("*").alias("degree")))
        forget(state)
    state = landed(placed(), "state")
    rest = landed(open_pairs(state, texts), "rest")
    links = links.union(linked(rest, signed, inverse))
    labels = components(links)
    forget(state, rest, members)
    owners = firsts.join(labels, "row", "left")
    return signed, owners.select(*key, F.coalesce("label", "row").alias("class_row"))


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(landed documents, class of each row, best row of each class): the smallest ``doc_id``, null last."""
    signed, owners = classes(docs)
    key = ["key_high", "key_low"]
    rows = signed.select("row", F.col(f"{CARRIED}doc_id").cast("long").alias("doc_id"), *key)
    named = stored(rows.join(stored(owners), key).select("row", "doc_id", "class_row"))
    best = stored(named.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")))
    return signed, named, best


def assigned(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, keep`` of each input row.

    ``class_id`` is the smallest ``doc_id`` of the row's class (null if all are null), and the first row
    with it is kept. Null and empty texts are the same text; texts without a word are equal only to
    themselves; a document without a copy is its own class.
    """
    _, named, best = _named(docs.select("doc_id", "text"))
    out = named.join(best, "class_row")
    return out.select("doc_id", F.col("best.doc_id").alias("class_id"), (F.col("row") == F.col("best.row")).alias("keep"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The kept row of each class, with the columns of ``docs``. Rows that no other replaces stay where they are."""
    signed, named, best = _named(docs)
    gone = named.join(best, "class_row").where(F.col("row") != F.col("best.row")).select("row")
    gone = landed(gone, "gone")
    likely, sure = split_by_membership(signed, "row", gone)
    kept = likely.join(F.broadcast(gone) if sure is None else gone, "row", "left_anti")
    kept = kept if sure is None else kept.unionByName(sure)
    return kept.select(*[F.col(f"{CARRIED}{c}").alias(c) for c in docs.columns])
