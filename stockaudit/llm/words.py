"""Words of texts as 64-bit hashes, and rolling hashes of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from stockaudit.llm import arrowtext

_STEP = np.uint64(0x9E3779B97F4A7C15)
# Words are parted by anything but letters, digits, marks and underscores: in ASCII byte by byte, so that the
# slower pattern has only the others to look for.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[[b for b in range(128) if not (chr(b).isalnum() or chr(b) == "_")]] = ord(" ")
_APART_BEYOND_ASCII = r"[^\x00-\x7F\pL\pN\pM]+"


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits, marks and underscores."""
    return [w for w in _spaced(pa.array([text], pa.large_string()))[0].as_py().split(" ") if w]


def _spaced(texts: pa.Array) -> pa.Array:
    """Lower-case texts with spaces, often several, between their words."""
    lower = pc.utf8_lower(texts)
    valid, offsets, data = lower.buffers()
    if data is not None:
        data = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)])
    apart = pa.LargeStringArray.from_buffers(len(lower), offsets, data, valid, lower.null_count, lower.offset)
    return pc.replace_substring_regex(apart, _APART_BEYOND_ASCII, " ")


def _hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(bool, pieces), np.int64, len(pieces))
    return np.array([xxhash.xxh3_64_intdigest(w) for w in pieces if w], np.uint64), lengths


_table = arrowtext.PieceTable(_hashes, np.uint64)


def hashed_words(texts: pa.Array, table: arrowtext.PieceTable = _table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text begins (and the last one ends).

    Another ``table`` may stand for each word by another number; it gives none for the empty piece.
    """
    codes, offsets, pieces = arrowtext.pieces_of(_spaced(texts))
    values, lengths = table.gather(codes, pieces)
    return values, arrowtext.bounds(offsets, lengths)


def counted_words(texts: pa.Array, table: arrowtext.PieceTable = _table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the distinct words of all texts together, and how often each one occurs."""
    codes, _, pieces = arrowtext.pieces_of(_spaced(texts))
    values, lengths = table.gather(np.arange(len(pieces)), pieces)
    return values, np.bincount(codes, minlength=len(pieces))[lengths > 0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, as if all texts were one; the last ones are short and mean nothing."""
    total = np.zeros(len(values), np.uint64)
    factor = np.ones(1, np.uint64)
    for j in range(min(size, len(values))):
        factor = factor * _STEP
        total[: len(values) - j] += values[j:] * factor
    return mixed(total)
