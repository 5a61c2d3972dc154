"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

For merge-type vocabularies with byte fallback, identity normalisation and a dummy prefix. A text is
cut where a word mark follows another character; no piece of such a vocabulary holds that border (which
is checked on loading), so each cut part is merged alone and equal parts of a worker's batches are merged
once. Every distinct part of a batch is also encoded by the sentencepiece library, and compared.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from stockaudit.llm import arrowtext

MARK = "▁"
# No piece: the id of characters that the vocabulary lacks, and of the border after a part.
NONE = 0xFFFF
# Parts merged at once, and characters beyond which a part is merged alone.
ROWS_AT_ONCE = 8192
LONG_PART = 40

_BORDER = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

TEXT_AT_ONCE = arrowtext.SLICE_BYTES
NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "matches_library"]
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, matches_library boolean"


class MergeModel:
    """Pieces, scores and byte ids of a vocabulary file, with the agenda encoder and the decoder."""

    def __init__(self, model_file: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.ids: dict[str, int] = {}
        self.costs: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.is_byte: list[bool] = []
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            self.is_byte.append(lib.is_byte(i))
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif lib.is_control(i):
                self.surface.append(b"")
            elif lib.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"piece {piece!r} crosses a word border")
                self.ids[piece] = i
                self.costs[piece] = -lib.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self._pair_arrays()
        self.mismatches = 0
        self.table = arrowtext.PieceTable(self._checked, np.uint32)

    def _pair_arrays(self) -> None:
        """Sorted keys of all id pairs that join to a piece, with the cost and id of each, for many parts at once."""
        rows = []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                pair = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if None not in pair:
                    rows.append((pair[0] << 16 | pair[1], self.costs[piece], i))
        rows.sort()
        self.pair_keys = np.array([r[0] for r in rows], np.uint32)
        self.pair_costs = np.array([r[1] for r in rows] + [np.inf], np.float32)
        self.pair_ids = np.array([r[2] for r in rows] + [NONE], np.uint16)
        self.char_ids = np.full(0x110000, NONE, np.uint16)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i

    def _checked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new distinct pieces, compared with the library's in the same batch."""
        values, lengths = self.merge_many([MARK + p for p in pieces])
        done = 0
        for at in range(0, len(pieces), 16384):
            expected, counts = arrowtext.flattened(self.library.encode(pieces[at : at + 16384], num_threads=1), np.uint32)
            own = values[done : done + len(expected)]
            self.mismatches += int(not (np.array_equal(lengths[at : at + 16384], counts) and np.array_equal(own, expected)))
            done += len(expected)
        return values, lengths

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each pair of ids is in the pair arrays; the last place if it joins to nothing."""
        keys = a.astype(np.uint32) << np.uint32(16) | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys))

    def merge_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many parts at once; returns all ids in order and their number for each part.

        Each part's agenda is a row with the cost of the pair that begins at each symbol. In every round
        each row joins its cheapest pair, the leftmost among equals, and renews the two pairs beside it.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(sizes, kind="stable")
        counts = np.zeros(len(parts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        short = int(np.searchsorted(sizes[order], LONG_PART, "right"))
        for at in range(0, short, ROWS_AT_ONCE):
            rows = order[at : min(at + ROWS_AT_ONCE, short)]
            found.append((rows, self._merge_rows([parts[i] for i in rows], sizes[rows], counts, rows)))
        for i in order[short:]:
            ids = np.array(self.merge(parts[i]), np.uint32)
            counts[i] = len(ids)
            found.append((np.array([i]), ids))
        # Bring the ids into the order of the parts.
        values = np.zeros(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        for rows, ids in found:
            values[arrowtext.ragged(starts[rows], counts[rows])] = ids
        return values, counts

    def _merge_rows(self, parts: list[str], sizes: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n, width = len(parts), int(sizes.max(initial=1))
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < sizes[:, None]
        chars = np.zeros((n, width), np.uint32)
        chars[inside] = points
        symbols = np.full((n, width + 1), NONE, np.uint16)  # the last column is a border that joins nothing
        symbols[:, :width][inside] = self.char_ids[points]
        alive = inside.copy()
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        after[:, width] = width
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        before[:, 0] = width
        pair = self._joined(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
        cost = np.full((n, width + 1), np.inf, np.float32)
        cost[:, :width] = self.pair_costs[pair]
        row = np.arange(n)
        while True:
            i = np.argmin(cost[row], axis=1)
            live = np.isfinite(cost[row, i])
            row, i = row[live], i[live]
            if not len(row):
                break
            j = after[row, i]
            symbols[row, i] = self.pair_ids[self._joined(symbols[row, i], symbols[row, j])]
            alive[row, j] = False
            cost[row, j] = np.inf
            k = after[row, j]
            after[row, i] = k
            before[row, k] = i
            joined = symbols[row, i]
            cost[row, i] = self.pair_costs[self._joined(joined, symbols[row, k])]
            h = before[row, i]
            cost[row, h] = self.pair_costs[self._joined(symbols[row, h], joined)]
        # Symbols that are no piece become the ids of their bytes.
        left = symbols[:, :width][alive].astype(np.uint32)
        per_row = alive.sum(axis=1)
        strange = np.flatnonzero(left == NONE)
        if len(strange):
            codes = chars[alive][strange]
            spelled = [[self.byte_ids[b] for b in chr(c).encode()] for c in codes.tolist()]
            widths = np.ones(len(left), np.int64)
            widths[strange] = [len(s) for s in spelled]
            out = np.repeat(left, widths)
            begins = np.cumsum(widths) - widths
            out[arrowtext.ragged(begins[strange], widths[strange])] = [b for s in spelled for b in s]
            owner = np.repeat(np.arange(n), per_row)
            per_row = np.bincount(owner, weights=widths, minlength=n).astype(np.int64)
            left = out
        counts[rows] = per_row
        return left

    def merge(self, part: str) -> list[int]:
        """Ids of one part: the best adjacent pair is joined, the leftmost among equals, until none is a piece."""
        costs, symbols = self.costs, list(part)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            joined = symbols[i] + symbols[i + 1]
            if joined in costs:
                agenda.append((costs[joined], i, i + 1, joined))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            # An entry is stale once either side was merged away or grew.
            if symbols[i] + symbols[j] != joined or not symbols[j] or not symbols[i]:
                continue
            symbols[i], symbols[j] = joined, ""
            after, before = right[j], left[i]
            right[i] = after
            if after < n:
                left[after] = i
                longer = joined + symbols[after]
                if longer in costs:
                    heapq.heappush(agenda, (costs[longer], i, after, longer))
            if before >= 0:
                longer = symbols[before] + joined
                if longer in costs:
                    heapq.heappush(agenda, (costs[longer], before, i, longer))
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                found = self.ids.get(symbol)
                if found is None:
                    out.extend(self.byte_ids[b] for b in symbol.encode())
                else:
                    out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without begin and end."""
        return [i for part in _BORDER.findall(MARK + text.replace(" ", MARK)) for i in self.merge(part)] if text else []

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with begin and end, text after text, and where each text begins (and the last one ends)."""
        # Texts with runs of spaces, spaces at an end or word marks of their own go by the general cut.
        special = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        special = pc.or_(special, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        special = pc.or_(special, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~special)
        codes, offsets, pieces = arrowtext.pieces_of(texts.take(pa.array(plain)) if len(plain) < len(texts) else texts)
        values, lengths = self.table.gather(codes, pieces)
        ends = arrowtext.bounds(offsets, lengths)
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(ends)
        others = {}
        for i in np.flatnonzero(special).tolist():
            text = texts[i].as_py()
            others[i] = np.array(self.encode(text), np.uint32)
            self.mismatches += int(others[i].tolist() != self.library.encode(text))
            counts[i] = len(others[i])
        starts = np.concatenate(([0], np.cumsum(counts + 2)))
        out = np.empty(int(starts[-1]), np.uint32)
        out[starts[:-1]], out[starts[1:] - 1] = self.begin, self.end
        if others:
            out[arrowtext.ragged(starts[plain] + 1, counts[plain])] = values
            for i, ids in others.items():
                out[starts[i] + 1 : starts[i + 1] - 1] = ids
        else:
            inside = np.ones(len(out), bool)
            inside[starts[:-1]] = inside[starts[1:] - 1] = False
            out[inside] = values
        return out, starts

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: byte ids in a row join to characters, a broken one gives U+FFFD per byte, the dummy prefix goes."""
        parts, run = [], []
        for i in ids:
            if self.surface[i]:
                run.append(i)
            elif run:
                parts.append(run)
                run = []
        text = ""
        for k, run in enumerate([*parts, run]):
            raw = b"".join(map(self.surface.__getitem__, run))
            if k == 0 and run and run[0] != self.unknown and not self.is_byte[run[0]] and raw[:1] == b" ":
                raw = raw[1:]
            text += re.sub("[\udc80-\udcff]", "\ufffd", raw.decode(errors="surrogateescape"))
        return text

    def decode_batch(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """``decode`` of texts that lie one after the other, as UTF-8."""
        if not hasattr(self, "surface_bytes"):
            self.surface_sizes = np.array([len(x) for x in self.surface], np.int64)
            self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
            self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        sizes = self.surface_sizes[ids]
        raw = self.surface_bytes[arrowtext.ragged(self.surface_starts[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[starts]
        out = []
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            text = raw[a:b]
            own = ids[starts[k] : starts[k + 1]]
            # Bytes that stand between a text's own begin and end are one run; anything else goes one by one.
            regular = len(own) >= 2 and own[0] == self.begin and own[-1] == self.end and _valid(text)
            if regular and not (self.surface_sizes[own[1:-1]] == 0).any() and len(own) > 2:
                first = int(own[1])
                out.append(text[1:] if first != self.unknown and not self.is_byte[first] and text[:1] == b" " else text)
            else:
                out.append(self.decode(own.tolist()).encode())
        return out


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_models: dict[str, MergeModel] = {}


def model(model_file: str) -> MergeModel:
    """The vocabulary, loaded once per Python worker."""
    if model_file not in _models:
        _models[model_file] = MergeModel(model_file)
    return _models[model_file]


def _digests(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    m = model(model_file)
    for batch in arrowtext.slices(batches, "text", TEXT_AT_ONCE):
        before = m.mismatches
        ids, starts = m.encode_batch(arrowtext.text_of(batch, "text"))
        raw, cuts = ids.astype("<u4").tobytes(), (4 * starts).tolist()
        hashes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        decoded = [hashlib.sha256(text).hexdigest() for text in m.decode_batch(ids, starts)]
        same = np.full(batch.num_rows, m.mismatches == before)
        columns = [pa.array(np.diff(starts)), pa.array(hashes), pa.array(decoded), pa.array(same)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=NAMES)


def _ids(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    m = model(model_file)
    for batch in arrowtext.slices(batches, "text", TEXT_AT_ONCE):
        ids, starts = m.encode_batch(arrowtext.text_of(batch, "text"))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])


def _texts(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    m = model(model_file)
    for batch in batches:
        texts = [m.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids`` of every whole text, begin and end included; null text is empty: just those two."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _ids(b, model_file), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` of encoded rows; null ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _texts(b, model_file), "doc_id long, text string")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Counts and hashes of the ids and of their decoded text per document, checked against the library.

    One row per input row, whatever repeats; a null ``doc_id`` stays null; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: _digests(b, model_file), SCHEMA)
