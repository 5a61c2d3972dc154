"""Token ids in files of independent rANS blocks, read back in parallel.

A static range asymmetric numeral system with one frequency table for the whole data set. The ids of a
block are dealt to interleaved lanes, one numpy vector of coder states; a step codes one id per lane.
Every ``CHECKPOINT_STEPS`` steps the states and the place in the word stream are kept, so that parts of a
block can be decoded alone. Blocks carry checksums of their words, their ids and their table.

A data set is two Parquet folders written by Spark: ``table`` (id, frequency) and ``blocks`` (range
partition, number, documents and sizes, ``payload`` in the layout of ``pack``).
"""

from __future__ import annotations

import os
import string
import struct
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stockaudit.llm import arrowtext
from stockaudit.llm.tables import fresh_folder, landed

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
SCALE_BITS = 20
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_IDS = 1 << 18
MAGIC = b"RNSB"
HEADER = struct.Struct("<4sHHIIIIIII")


class Table:
    """Frequencies scaled to a power of two; every symbol that occurs keeps at least one slot."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.symbols, self.frequencies = symbols.astype(np.uint32), frequencies.astype(np.uint64)
        self.starts = np.cumsum(self.frequencies) - self.frequencies
        self.bits = int(self.frequencies.sum()).bit_length() - 1
        self.checksum = zlib.crc32(self.symbols.astype("<u4").tobytes() + self.frequencies.astype("<u8").tobytes())
        self.places = np.zeros(int(self.symbols.max(initial=0)) + 1, np.int64)
        self.places[self.symbols] = np.arange(len(self.symbols))
        self.slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.frequencies.astype(np.int64))

    @classmethod
    def from_counts(cls, symbols: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> Table:
        """Scale counts; ``symbols`` ascend and each has a count of at least one."""
        while len(symbols) > 1 << (bits - 1):
            bits += 1
        total = 1 << bits
        scaled = np.maximum(1, np.floor(counts / max(1, counts.sum()) * total)).astype(np.int64)
        # What rounding left over or took goes to the most frequent, largest first.
        gap = total - int(scaled.sum())
        for i in np.argsort(-scaled, kind="stable"):
            if gap == 0:
                break
            change = gap if gap > 0 else max(gap, 1 - int(scaled[i]))
            scaled[i] += change
            gap -= change
        return cls(symbols, scaled)


def pack(ids: np.ndarray, table: Table) -> bytes:
    """One block. The coder runs backwards, so the decoder reads ids and words forwards."""
    n, bits = len(ids), np.uint64(table.bits)
    steps = -(-n // LANES)
    place = table.places[ids]
    frequency, start = table.frequencies[place], table.starts[place]
    limit = ((LOW >> bits) << WORD) * frequency
    states = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    kept: list[tuple[int, bytes]] = []
    emitted = 0
    for step in range(steps - 1, -1, -1):
        a, b = step * LANES, min(n, (step + 1) * LANES)
        x, f = states[: b - a], frequency[a:b]
        full = x >= limit[a:b]
        if full.any():
            out = x[full].astype(np.uint32)
            words.append(out)
            emitted += len(out)
            x = np.where(full, x >> WORD, x)
        whole, rest = np.divmod(x, f)
        states[: b - a] = (whole << bits) + rest + start[a:b]
        if step % CHECKPOINT_STEPS == 0:
            kept.append((emitted, states.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    marks = b"".join(struct.pack("<I", emitted - at) + state for at, state in reversed(kept))
    header = HEADER.pack(
        MAGIC, 1, LANES, n, emitted, CHECKPOINT_STEPS, len(kept), table.checksum,
        zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(marks + stream),
    )
    return header + marks + stream


def unpack(block: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """Ids of a block, or of the part after checkpoint ``part`` alone; raises on a wrong checksum."""
    magic, version, lanes, n, n_words, every, n_kept, table_sum, ids_sum, body_sum = HEADER.unpack_from(block)
    if magic != MAGIC or version != 1 or table_sum != table.checksum or zlib.crc32(block[HEADER.size :]) != body_sum:
        raise ValueError("damaged block, or a block of another table")
    mark = 4 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, HEADER.size + n_kept * mark)
    steps = -(-n // lanes)
    first, last = (0, steps) if part is None else (part * every, min(steps, (part + 1) * every))
    out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
    if not len(out):
        return out
    at_mark = HEADER.size + (first // every) * mark
    at = struct.unpack_from("<I", block, at_mark)[0]
    states = np.frombuffer(block, "<u8", lanes, at_mark + 4).astype(np.uint64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for step in range(first, last):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = states[: b - a]
        slot = x & mask
        place = table.slots[slot]
        out[a - first * lanes : b - first * lanes] = table.symbols[place]
        x = table.frequencies[place] * (x >> bits) + slot - table.starts[place]
        short = np.flatnonzero(x < LOW)
        if len(short):
            x[short] = x[short] << WORD | words[at : at + len(short)]
            at += len(short)
        states[: b - a] = x
    if part is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("ids do not match their checksum")
    return out


# How tokens that end a word end, and words in one call of the library.
WORD_END = "</w>"
CALL_WORDS = 256


def _taken_apart() -> list[int]:
    """Code points that are no marks but have one when normalised."""
    points = (n for n in range(sys.maxunicode + 1) if not 0xD800 <= n < 0xE000)
    forms = ((n, unicodedata.normalize("NFC", chr(n))) for n in points)
    return [n for n, form in forms if form != chr(n) and any(unicodedata.category(c)[0] == "M" for c in form)]


class WordTokenizer:
    """A tokenizers file whose pre-tokenizer keeps words, runs of other signs and white space apart.

    So a text may be cut at spaces, and between letters and other signs unless it has apostrophes (which
    begin short forms), marks that join a letter, or special tokens. In a text that has none of these, A to Z may be
    lower-cased and white space made a space before, as the normaliser would. Equal pieces are encoded once.
    """

    # Apostrophe, marks, letters that normalising takes apart into letter and mark, the capital whose small form has a
    # mark, code points that Arrow's patterns do not know yet and the library may, and how special tokens begin.
    JOINED = "['\\pM\u0130" + "".join(map(chr, _taken_apart())) + r"]|[^\pL\pM\pN\pP\pS\pZ\pC]|<\|"
    FOLDED = bytes.maketrans(string.ascii_uppercase.encode() + b"\t\n\f\r", string.ascii_lowercase.encode() + b"    ")

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.table = arrowtext.RecentPieceTable(self._encode, np.uint32)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, by the library; it holds much for each one, so a few at a time."""
        found: list[list[int]] = []
        for at in range(0, len(pieces), 4096):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + 4096], add_special_tokens=False)]
        return found

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A word's last id tells that the word ends, so many words can be one call and be told apart afterwards. Every
        # piece has at least one such id: if there are as many ids as pieces, each has one.
        words = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        alone, words = [np.flatnonzero(~words)], np.flatnonzero(words)
        told: list[np.ndarray] = []
        told_ids: list[np.ndarray] = []
        told_lengths: list[np.ndarray] = []
        for at in range(0, len(words), 16 * CALL_WORDS):
            places = words[at : at + 16 * CALL_WORDS]
            some = [pieces[p] for p in places.tolist()]
            calls = [some[i : i + CALL_WORDS] for i in range(0, len(some), CALL_WORDS)]
            ids, n_ids = arrowtext.flattened(self._ids([" ".join(call) for call in calls]), np.uint32)
            n_words, ends, stops = np.fromiter(map(len, calls), np.int64, len(calls)), self.ends[ids], np.cumsum(n_ids)
            n_ends = np.diff(np.concatenate(([0], np.cumsum(ends)))[stops], prepend=0)
            clear = n_ends == n_words
            clear[clear] = ends[stops[clear] - 1]
            kept = np.repeat(clear, n_ids)
            told.append(places[np.repeat(clear, n_words)])
            told_ids.append(ids[kept])
            told_lengths.append(np.diff(np.flatnonzero(ends[kept]) + 1, prepend=0))
            alone.append(places[~np.repeat(clear, n_words)])
        rest = np.concatenate(alone)
        rest_ids, rest_lengths = arrowtext.flattened(self._ids([pieces[p] for p in rest.tolist()]), np.uint32)
        order, ordered = np.concatenate([*told, rest]), np.concatenate([*told_lengths, rest_lengths])
        starts, lengths = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        starts[order], lengths[order] = np.cumsum(ordered) - ordered, ordered
        return np.concatenate([*told_ids, rest_ids])[arrowtext.ragged(starts, lengths)], lengths

    def _folded(self, texts: pa.Array) -> pa.Array:
        """The texts with A to Z in lower case and spaces for tabs and line breaks."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = pa.py_buffer(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(self.FOLDED))
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), data)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text begins."""
        apart = pc.replace_substring_regex(self._folded(texts), r" ?([^\s\pL]+) ?", r" \1 ")
        codes, offsets, pieces = arrowtext.pieces_of(pc.if_else(pc.match_substring_regex(texts, self.JOINED), texts, apart))
        values, lengths = self.table.gather(codes, pieces)
        return values, arrowtext.bounds(offsets, lengths)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(file: str) -> WordTokenizer:
    if file not in _tokenizers:
        _tokenizers[file] = WordTokenizer(file)
    return _tokenizers[file]


def _tokenized(batches: Iterator[pa.RecordBatch], file: str, end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(file)
    for batch in arrowtext.slices(batches, "text"):
        values, starts = t.encode_batch(arrowtext.text_of(batch, "text"))
        out = np.full(len(values) + batch.num_rows, end_id, kind)
        keep = np.ones(len(out), bool)
        keep[starts[1:] + np.arange(batch.num_rows)] = False
        out[keep] = values
        ends = out.itemsize * (starts + np.arange(batch.num_rows + 1))
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids.cast(pa.binary())], names=["doc_id", "ids"])


def id_kind(file: str, end_id: int) -> str:
    """Little-endian unsigned integers of 16 bits if all ids fit, else of 32."""
    return "<u2" if max(tokenizer(file).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, file: str, end_id: int, kind: str = "<u4") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text and ``end_id``, as integers of ``kind``."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _tokenized(b, file, end_id, kind), "doc_id long, ids binary")


def _counted(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for slice_ in arrowtext.slices([batch], "ids"):
            ids = np.frombuffer(b"".join(slice_.column("ids").to_pylist()), kind)
            counts = np.bincount(ids)
            if len(counts) > len(total):
                total = np.concatenate((total, np.zeros(len(counts) - len(total), np.int64)))
            total[: len(counts)] += counts
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


def frequencies(tokens: DataFrame, kind: str) -> Table:
    """The shared table, counted over all ids; as large as the vocabulary, so it fits the driver and a closure."""
    rows = tokens.select("ids").mapInArrow(lambda b: _counted(b, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return Table.from_counts(np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.float64))


def _packed(batches: Iterator[pa.RecordBatch], symbols: np.ndarray, scaled: np.ndarray, kind: str, block_ids: int) -> Iterator[pa.RecordBatch]:
    table = Table(symbols, scaled)
    part = TaskContext.get().partitionId()
    number = before = held = 0
    docs: list[int | None] = []
    sizes: list[int] = []
    parts: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        values = [[part], [number], [before], [held], [docs], [sizes], [pack(np.concatenate(parts), table)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=BLOCK_NAMES)

    for batch in batches:
        for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(ids.as_buffer(), kind)
            docs.append(doc)
            sizes.append(len(ids))
            parts.append(ids)
            held += len(ids)
            if held >= block_ids:
                yield block()
                before, number, held, docs, sizes, parts = before + held, number + 1, 0, [], [], []
    if docs:
        yield block()


BLOCK_NAMES = ["part", "number", "before_in_part", "n_ids", "doc_ids", "sizes", "payload"]
BLOCK_SCHEMA = "part int, number int, before_in_part long, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"
TABLE_SCHEMA = "id long, frequency long"


def write(tokens: DataFrame, folder: str, kind: str = "<u4", block_ids: int = BLOCK_IDS) -> None:
    """Write tokenised documents in ascending ``doc_id`` order (null first, equal ids by a hash of their tokens).

    Range partitions follow each other; within one, blocks are numbered. Repeated ids are split over
    partitions by the hash, so no key grows a task. A block ends with the document that fills it.
    """
    spark = tokens.sparkSession
    table = frequencies(tokens, kind)
    rows = list(zip(table.symbols.tolist(), table.frequencies.astype(int).tolist()))
    spark.createDataFrame(rows, TABLE_SCHEMA).coalesce(1).write.parquet(f"{folder}/table")
    symbols, scaled = table.symbols, table.frequencies
    order = ["doc_id", "tie"]
    (
        tokens.select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "ids")
        .mapInArrow(lambda b: _packed(b, symbols, scaled, kind, block_ids), BLOCK_SCHEMA)
        .write.parquet(f"{folder}/blocks")
    )


def _unpacked(batches: Iterator[pa.RecordBatch], symbols: np.ndarray, scaled: np.ndarray, digest: bool) -> Iterator[pa.RecordBatch]:
    table = Table(symbols, scaled)
    for batch in batches:
        for row in range(batch.num_rows):
            raw = memoryview(unpack(batch.column("payload")[row].as_py(), table).astype("<u4").tobytes())
            docs, sizes = batch.column("doc_ids")[row].as_py(), np.array(batch.column("sizes")[row].as_py(), np.int64)
            ends = np.cumsum(sizes)
            cuts = zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist())
            columns = [pa.array(docs, pa.int64()), pa.array(batch.column("before")[row].as_py() + ends - sizes)]
            if digest:
                columns += [pa.array(sizes), pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64())]
            else:
                columns.append(pa.array([bytes(raw[a:b]) for a, b in cuts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])])


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, ids`` from written files, or ``n_tokens, ids_crc32`` in place of the ids.

    Every block is decoded on its own. ``start`` counts the ids of all documents before. Only one total per
    range partition is summed up in order; there are at most ``spark.sql.shuffle.partitions`` of them, so
    that table is broadcast. Ids and checksums are of little-endian unsigned 32-bit integers.
    """
    rows = spark.read.schema(TABLE_SCHEMA).parquet(f"{folder}/table").orderBy("id").collect()
    symbols, scaled = np.array([r.id for r in rows], np.int64), np.array([r.frequency for r in rows], np.int64)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "part").select(
        "doc_ids", "sizes", "payload", (F.col("base") + F.col("before_in_part")).alias("before")
    )
    kept = "n_tokens long, ids_crc32 long" if digest else "ids binary"
    return placed.mapInArrow(lambda b: _unpacked(b, symbols, scaled, digest), f"doc_id long, start long, {kept}")


def round_trip(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """Tokenise, write, and read back: ``doc_id, start, n_tokens, ids_crc32`` of each row.

    Null text is empty and holds the end id alone; a null ``doc_id`` comes first; repeated rows stay.
    """
    folder, kind = fresh_folder(docs.sparkSession, "rans"), id_kind(file, end_id)
    write(landed(tokenize(docs, file, end_id, kind), "tokens"), folder, kind)
    return read(docs.sparkSession, folder, digest=True)
