"""Language identification by compression: the language whose dictionary shortens a text most.

Each language has a raw-content zstandard dictionary of sample text. A text is reduced to lower-case
letters and single spaces, cut into segments, and every segment of the whole text is compressed with each
dictionary; the smallest total wins. A text is rejected if the margin to the second is narrow, or if it takes more
bits a byte than texts of its length in any learned language do: then no dictionary fits it, and its margin is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stockaudit.llm import arrowtext
from stockaudit.llm.tables import free_name

UNKNOWN = "und"
# Bounds of the training sample: documents a language for its dictionary and as many for the bounds of rejection,
# characters of each, bytes of a dictionary, of which its documents have equal parts as far as they are long enough.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 16_384
DICTIONARY_BYTES = 49_152
# Lengths for which the bits that real text takes are learned, and how far above the most of them a text may be.
# Shorter texts tell too little to be rejected so.
LENGTHS = (128, 256, 512, 1024, 2048)
ALLOWANCE = 1.15
SEGMENT_BYTES = 4_096
LEVEL = 7
# Share by which the best total must be under the second.
MIN_MARGIN = 0.002
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is neither held out nor learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


@dataclass(frozen=True)
class Learned:
    """A dictionary for each language, and the most bits a byte that real texts of each of ``LENGTHS`` take, if known."""

    dictionaries: dict[str, bytes]
    bounds: tuple[float, ...] = ()


def learn(docs: DataFrame) -> Learned:
    """What the documents that are not held out tell of each ``lang``.

    The sample is bounded: of each language the ``2 * SAMPLE_DOCS`` documents with the smallest hash, of which the even
    ones make the dictionary and the odd ones the bounds. Rows are first thinned by that hash to a few times as many, so
    that no language is sorted whole.
    """
    ready = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r.lang: r["count"] for r in ready.groupBy("lang").count().collect()}
    if not counts:
        return Learned({})
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 8 * SAMPLE_DOCS / n))])
    thin = ready.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")] * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    rows = (
        thin.select("lang", "draw", F.substring("text", 1, SAMPLE_CHARS).alias("text"), rank.alias("rank"))
        .where(F.col("rank") <= 2 * SAMPLE_DOCS).collect()
    )
    out, others = {}, []
    for lang in sorted(counts):
        texts = [r.text for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.rank)]
        plain = [x.encode() for x in letters(pa.array(texts, pa.large_string())).to_pylist()]
        out[lang] = _dictionary(plain[::2])
        others += plain[1::2]
    return Learned(out, _bounds(others, _compressors(out)))


def _dictionary(texts: list[bytes]) -> bytes:
    """Equal parts of all texts, shorter ones whole."""
    room, parts = DICTIONARY_BYTES, {}
    for left, place in zip(range(len(texts), 0, -1), sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        parts[place] = texts[place][: max(0, room // left - 1)]
        room -= len(parts[place]) + 1
    return b" ".join(parts[i] for i in range(len(texts)))


def _sizes(raw: bytes, compressors: list) -> list[int]:
    # Segments end where they end: a split character is only a few odd bytes, the same for all.
    parts = [raw[i : i + SEGMENT_BYTES] for i in range(0, len(raw), SEGMENT_BYTES)]
    return [sum(len(c.compress(p)) for p in parts) for c in compressors]


def _bounds(texts: list[bytes], compressors: list) -> tuple[float, ...]:
    """For each of ``LENGTHS`` the most bits a byte that beginnings of that length take, with an allowance."""
    out = []
    for length in LENGTHS:
        taken = [8 * min(_sizes(raw[:length], compressors)) / length for raw in texts if len(raw) >= length]
        out.append(ALLOWANCE * max(taken) if taken else float("inf"))
    return tuple(out)


def _fits(raw: bytes, size: int, bounds: tuple[float, ...]) -> bool:
    """Whether a text takes no more bits a byte than the bound for its length; between two lengths bits fall as 1 / length."""
    n = len(raw)
    if not bounds or n < LENGTHS[0]:
        return True
    at = sum(length <= n for length in LENGTHS) - 1
    bound = bounds[at]
    if at + 1 < len(LENGTHS) and bounds[at + 1] < bound:
        a, b = LENGTHS[at], LENGTHS[at + 1]
        bound = bounds[at + 1] + (bound - bounds[at + 1]) * (1 / n - 1 / b) / (1 / a - 1 / b)
    return 8 * size <= bound * n


def letters(texts: pa.Array) -> pa.Array:
    """Lower-case letters, everything else a single space."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")


def _compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in dictionaries.values():
        kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
        if kept is not None:
            kept.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def judge(texts: pa.Array, langs: list[str], compressors: list, bounds: tuple[float, ...] = ()) -> list[tuple[str, float]]:
    """Language and margin of each whole text; without any letter, or with nothing learned, unknown and 0.

    The margin of a text that is none of the languages, by ``bounds``, is 0.
    """
    out = []
    for raw in letters(texts).cast(pa.large_binary()).to_pylist():
        if not langs or not raw.strip():
            out.append((UNKNOWN, 0.0))
            continue
        sizes = _sizes(raw, compressors)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        margin = 1.0 if second is None else 1.0 - sizes[best] / second
        out.append((langs[best], margin if _fits(raw, sizes[best], bounds) else 0.0))
    return out


def _predicted(batches: Iterator[pa.RecordBatch], learned: Learned, names: list[str]) -> Iterator[pa.RecordBatch]:
    langs, compressors = list(learned.dictionaries), _compressors(learned.dictionaries)
    for batch in arrowtext.slices(batches, "text"):
        found = judge(arrowtext.text_of(batch, "text"), langs, compressors, learned.bounds)
        columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def predict(docs: DataFrame, learned: Learned, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its margin, 0 to 1; only ``text`` is looked at.

    Null and empty texts, and texts without a letter, get ``und`` and 0. Equal totals go to the first
    language by name, with margin 0.
    """
    fields = [*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    names = [f.name for f in fields]
    return docs.mapInArrow(lambda b: _predicted(b, learned, names), T.StructType(fields))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of each row; other columns are not carried."""
    out = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", rejected(F.col("lang_pred"), F.col("score")).alias("rejected")
    )


def rejected(lang: Column, score: Column) -> Column:
    return (lang == UNKNOWN) | (score < MIN_MARGIN)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with enough margin, with their own columns."""
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    found = predict(docs, learn(docs), lang, score)
    return found.where(~rejected(F.col(lang), F.col(score))).select(*docs.columns)
