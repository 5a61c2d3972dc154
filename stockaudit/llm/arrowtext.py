"""Text in Arrow batches: byte-bounded slices, words as codes, and per-word results kept in a bounded table.

A batch of texts is split at single spaces and its distinct pieces are numbered by Arrow. Whatever a
piece stands for (token ids, word hashes) is worked out once per distinct piece and then gathered for
all its places with numpy, so the cost of a corpus is that of its distinct words plus a gather.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once, and the pieces, and characters of them, that are kept between batches.
SLICE_BYTES = 4 << 20
KEPT_PIECES = 500_000
KEPT_CHARS = 10 << 20


def give_back() -> None:
    """Return to the system what Arrow and the C library keep for later, which would stay with the worker process."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column with 64-bit offsets; null is the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text; a longer text is a batch of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the space-separated pieces of all texts, where each text begins, and the distinct pieces."""
    lists = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(lists.flatten())
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.indices.to_numpy(), offsets - offsets[0], coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def bounds(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each text begins among gathered values, given its first piece and the values of each piece."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return ends[offsets]


def flattened(rows: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Short lists of numbers as one array and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for row in rows for x in row), dtype, int(lengths.sum())), lengths


class PieceTable:
    """Remembers the numbers that stand for each piece; forgets all before ``limit`` pieces or ``chars`` of them are passed.

    What it holds is bounded by these and by one batch, however long pieces are. A worker process runs one operator
    after another, so a table that is used after another one makes that one forget.
    """

    in_use: PieceTable | None = None

    def __init__(
        self, work: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = KEPT_PIECES, chars: int = KEPT_CHARS
    ):
        self.work, self.dtype, self.limit, self.chars = work, dtype, limit, chars
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = np.zeros(1 << 12, self.dtype)
        self.starts, self.lengths = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.used = self.held = 0

    def _add(self, fresh: list[str]) -> None:
        self._store(fresh, *self.work(fresh))

    def _store(self, fresh: list[str], values: np.ndarray, lengths: np.ndarray) -> None:
        at, used = len(self.places), self.used
        while at + len(fresh) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while used + len(values) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.lengths[at : at + len(fresh)] = lengths
        self.starts[at : at + len(fresh)] = used + np.cumsum(lengths) - lengths
        self.flat[used : used + len(values)] = values
        self.used = used + len(values)
        self.held += sum(map(len, fresh))
        self.places.update(zip(fresh, range(at, at + len(fresh))))

    def _take_over(self) -> None:
        if PieceTable.in_use is not self:
            if PieceTable.in_use is not None:
                PieceTable.in_use._clear()
                give_back()
            PieceTable.in_use = self

    def gather(self, codes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in order, and how many each piece has."""
        self._take_over()
        fresh = [piece for piece in pieces if piece not in self.places]
        if len(self.places) + len(fresh) > self.limit or self.held + sum(map(len, fresh)) > self.chars:
            self._clear()
            fresh = pieces
        if fresh:
            self._add(fresh)
        index = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))[codes]
        lengths = self.lengths[index]
        return self.flat[ragged(self.starts[index], lengths)], lengths


class UnkeptPieces(PieceTable):
    """Keeps nothing: for pieces of one number or none, which are as fast to work out as to look up."""

    def gather(self, codes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in order, and how many each piece has."""
        self._take_over()
        values, each = self.work(pieces)
        lengths = each[codes]
        return values[(np.cumsum(each) - each)[codes[lengths > 0]]], lengths


class RecentPieceTable(PieceTable):
    """Forgets only the pieces longest not used, so that frequent ones are not worked out anew.

    When it is full it keeps at most half of each limit, and no more than leaves room for the batch.
    """

    batches = 0

    def _clear(self) -> None:
        super()._clear()
        self.last_used = np.zeros(len(self.starts), np.int64)

    def _store(self, fresh: list[str], values: np.ndarray, lengths: np.ndarray) -> None:
        super()._store(fresh, values, lengths)
        if len(self.last_used) < len(self.starts):
            self.last_used = np.resize(self.last_used, len(self.starts))

    def _keep(self, pieces: int, chars: int) -> None:
        """Forget all but the last used, up to so many pieces and characters."""
        n = len(self.places)
        order = np.argsort(-self.last_used[:n], kind="stable")
        sizes = np.fromiter(map(len, self.places), np.int64, n)
        fitting = int(np.searchsorted(np.cumsum(sizes[order]), chars, "right"))
        kept = np.sort(order[: max(0, min(pieces, fitting))])
        chosen = np.zeros(n, bool)
        chosen[kept] = True
        names, lengths, last_used = list(compress(self.places, chosen)), self.lengths[kept], self.last_used[kept]
        values = self.flat[ragged(self.starts[kept], lengths)]
        self._clear()
        if names:
            self._store(names, values, lengths)
            self.last_used[: len(names)] = last_used

    def _found(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece, -1 if it has none."""
        return np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))

    def gather(self, codes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in order, and how many each piece has; ``pieces`` are distinct."""
        self._take_over()
        self.batches += 1
        at = self._found(pieces)
        fresh = list(compress(pieces, at < 0))
        if len(self.places) + len(fresh) > self.limit or self.held + sum(map(len, fresh)) > self.chars:
            self.last_used[at[at >= 0]] = self.batches
            self._keep(min(self.limit // 2, self.limit - len(pieces)), min(self.chars // 2, self.chars - sum(map(len, pieces))))
            at = self._found(pieces)
            fresh = list(compress(pieces, at < 0))
        if fresh:
            first = len(self.places)
            self._add(fresh)
            at[at < 0] = np.arange(first, first + len(fresh))
        self.last_used[at] = self.batches
        index = at[codes]
        lengths = self.lengths[index]
        return self.flat[ragged(self.starts[index], lengths)], lengths
