"""SentencePiece ids against the library, token files against the tokenizers library, the coder on its own."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from stockaudit.llm import arrowtext, queries, rans_tokens, sentencepiece_agenda as agenda
from stockaudit.llm.tables import read

PIECES = public_tokenizers.path(queries.PIECE_MODEL)
WORDS = public_tokenizers.path(queries.WORD_TOKENIZER)
ODD = ["", " ", "a", " a  b ", "a\nb\t\0　x", "▁a▁ ▁b", "é<s></s><0x41>", "日本語 😀😀", "x" * 100 + " " + "ab" * 70, "don't <|endoftext|> İ, é!"]


def noise(letters, n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_encode_and_decode_as_the_library():
    m = agenda.model(PIECES)
    texts = ODD + noise("ab  theinon▁é\n😀.,x0", 1500, 3)
    ids, starts = m.encode_batch(pa.array(texts, pa.large_string()))
    want = m.library.encode(texts, add_bos=True, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want
    assert [t.decode() for t in m.decode_batch(ids, starts)] == [m.library.decode(w) for w in want]
    assert m.mismatches == 0
    assert [m.merge("▁" + t) for t in ("hello", "x" * 80)] == [m.library.encode(t) for t in ("hello", "x" * 80)]


def test_decode_of_any_ids():
    m, draw = agenda.model(PIECES), random.Random(5)
    lists = [[draw.choice([0, 1, 2, 3 + draw.randrange(256), draw.randrange(259, 32000), 198, 172]) for _ in range(draw.randint(0, 6))] for _ in range(3000)]
    assert [m.decode(ids) for ids in lists] == [m.library.decode(ids) for ids in lists]


def test_query_over_documents(spark, sf_dir):
    m = agenda.model(PIECES)
    texts = {r.doc_id: r.text or "" for r in read(spark, sf_dir, "documents").collect()}
    rows = queries.queries()["op1_sentencepiece_agenda"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.matches_library for r in rows)
    for r in rows:
        ids = m.library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(m.library.decode(ids).encode()).hexdigest()


def test_codec_on_odd_rows(spark):
    schema = "doc_id long, text string, n_tokens string"
    docs = spark.createDataFrame([(1, None, "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "", "x")], schema)
    assert sorted(r.n_tokens for r in agenda.digests(docs, PIECES).collect()) == [2, 2, 4, 4]
    assert sorted(r.text for r in agenda.decode(agenda.encode(docs, PIECES), PIECES).collect()) == ["", "", "a b", "a b"]
    assert agenda.digests(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=40_000).astype(np.uint32)
    counts = np.bincount(ids, minlength=2)
    symbols = np.flatnonzero(counts) if n else np.array([0])
    table = rans_tokens.Table.from_counts(symbols, np.maximum(counts[symbols], 1).astype(float))
    block = rans_tokens.pack(ids, table)
    assert (rans_tokens.unpack(block, table) == ids).all()
    parts = -(-n // (rans_tokens.LANES * rans_tokens.CHECKPOINT_STEPS))
    alone = [rans_tokens.unpack(block, table, k) for k in reversed(range(parts))][::-1]
    assert not parts or (np.concatenate(alone) == ids).all()
    if n:
        with pytest.raises(ValueError):
            rans_tokens.unpack(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_tokens_as_the_library():
    t = rans_tokens.tokenizer(WORDS)
    texts = ODD + noise(["a", "B", "don't", "'s", " ", "  ", "\n", "é", "é", "İ", "Σ", "ж", "1", "²", ".", ",", "<|endoftext|>", " ", "　", "\x1c", "😀"], 3000, 5)
    ids, starts = t.encode_batch(pa.array(texts, pa.large_string()))
    want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


def test_letters_that_normalising_takes_apart():
    t = rans_tokens.tokenizer(WORDS)
    apart = [chr(c) for c in (*range(0x958, 0x960), 0x9DC, 0x9DD, 0x9DF, 0xF43, 0xFB2A, 0x2ADC, 0x1D15E)]
    assert {ord(c) for c in apart} <= set(rans_tokens._taken_apart())
    letters = [*apart, "ड", "a", "B", "İ", "ß", "Å", "가", "ᄀ", "ᅡ", "Ω", "ﬁ", "ǅ", "९", "1", " ", " ", ",", ".", "-", "\n", "़", "́", "'", "豈"]
    texts = ["\u095c,", *noise(letters, 30_000, 11)]
    ids, starts = t.encode_batch(pa.array(texts, pa.large_string()))
    want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


def test_letters_newer_than_arrows_patterns():
    t = rans_tokens.WordTokenizer(WORDS)
    texts = ["a\u1c89b, \ua7cb.", "!\U0001fae9 !", *noise(["\u1c89", "\ua7cb", "\U00010d50", "\U000323b0", "\U0001fae9", "\u0378", "a", "B", "é", ",", "!", " ", "\n"], 3000, 31)]
    ids, starts = t.encode_batch(pa.array(texts, pa.large_string()))
    want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


def test_words_are_told_apart_in_one_call():
    t = rans_tokens.WordTokenizer(WORDS)
    pieces = ["a", "the", "İstanbul", "x" * 500, "naïve", "日本語", "don", "", "\n", "2024,", "é", "ﬁn", "<|endoftext|>", "ab\ncd", *noise("abcdeé", 3000, 4)]
    flat, lengths = t._encode(pieces)
    ends = np.cumsum(lengths)
    assert [flat[b - n : b].tolist() for b, n in zip(ends, lengths)] == [e.ids for e in t.tokenizer.encode_batch(pieces, add_special_tokens=False)]
    assert [len(x) for x in t._encode([])] == [0, 0]


def test_piece_table_is_bounded():
    seen = []

    def work(pieces):
        seen.append(len(pieces))
        return np.arange(len(pieces)), np.ones(len(pieces), np.int64)

    table = arrowtext.PieceTable(work, np.int64, limit=10, chars=50)
    for batch in (["a" * 30], ["b" * 15], ["a" * 30], ["c" * 30], ["a" * 30, "d"], [f"{i}" for i in range(9)]):
        values, lengths = table.gather(np.arange(len(batch)), batch)
        assert lengths.tolist() == [1] * len(batch) and table.held <= 50 and len(table.places) <= 10
    assert seen == [1, 1, 1, 2, 9]


def test_recently_used_pieces_stay_when_a_table_is_full():
    seen = []

    def work(pieces):
        seen.extend(pieces)
        return np.array([ord(p[0]) for p in pieces for _ in p], np.int64), np.array([len(p) for p in pieces], np.int64)

    table = arrowtext.RecentPieceTable(work, np.int64, limit=10, chars=1000)
    for n in range(40):
        batch = ["often", "also", chr(200 + 2 * n) * 3, chr(201 + 2 * n)]
        values, lengths = table.gather(np.array([3, 0, 2, 1, 0]), batch)
        assert values.tolist() == [ord(p[0]) for at in (3, 0, 2, 1, 0) for p in batch[at : at + 1] for _ in p]
        assert lengths.tolist() == [1, 5, 3, 4, 5] and len(table.places) <= 10
    assert len(seen) == 82
    for batch in (["x" * 600], ["y" * 300], ["x" * 600, "y" * 300], ["z" * 900], [chr(300 + n) for n in range(30)], ["y" * 300]):
        values, lengths = table.gather(np.arange(len(batch)), batch)
        assert values.tolist() == [ord(c) for p in batch for c in p] and lengths.tolist() == [*map(len, batch)]
        assert len(table.places) <= 30 and table.held <= 1000


def test_words_are_encoded_once_in_any_case_and_beside_any_white_space():
    t, encoded = rans_tokens.WordTokenizer(WORDS), []
    t.table.work = lambda pieces: encoded.extend(pieces) or t._encode(pieces)
    ids, starts = t.encode_batch(pa.array(["Stone stone\nSTONE,\tstone. \r\nstone", "", ", Stone"], pa.large_string()).slice(1))
    assert sorted(encoded) == ["", ",", "stone"]
    ids, starts = t.encode_batch(pa.array(["Stone stone\nSTONE,\tstone. \r\nstone", "", None], pa.large_string()).fill_null(""))
    assert sorted(encoded) == ["", ",", ".", "stone"]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.ids for e in t.tokenizer.encode_batch(["stone stone stone, stone. stone", "", ""], add_special_tokens=False)]


def test_case_and_white_space_as_the_library():
    t = rans_tokens.WordTokenizer(WORDS)
    signs = ["J", "H", "T", "W", "I", "K", "\u030c", "\u0331", "\u0308", "\u0307", "İ", "ẞ", "\u212a", "\u212b", "Σ", "Å", "É", "À", "Dz", "Ⅷ", "Ⓐ", "\u037e", "\u1fef", "ᄀ", "ᅡ"]
    white = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\f", "\x1c", "\x85", "\xa0", "\u2000", "\u2028", "\u200b", "\ufeff", "\0"]
    for letters, seed in ((signs + white + ["a", "B", ",", "!", "3"], 21), (["A", "b", "É", "Σ", ".", "!", "7", "…", "²", "—", "😀"] + white, 22), (["<|ENDOFTEXT|>", "<|endoftext|>", "A", "'S", "S", "\n", " "], 23)):
        texts = noise(letters, 8000, seed)
        ids, starts = t.encode_batch(pa.array(texts, pa.large_string()))
        want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


def test_files_read_back(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in read(spark, sf_dir, "documents").collect())
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.queries()["op5_rans_tokens"](spark, sf_dir).collect()}
    encoded = rans_tokens.tokenizer(WORDS).tokenizer.encode_batch([t for _, t in docs], add_special_tokens=False)
    start, want = 0, {}
    for (doc, _), e in zip(docs, encoded):
        ids = np.array([*e.ids, queries.END_ID], "<u4")
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert found == want


def test_files_of_odd_rows(spark):
    docs = spark.createDataFrame([(2, "b"), (None, "a"), (1, None), (2, "b")], "doc_id long, text string")
    rows = sorted(rans_tokens.round_trip(docs, WORDS, 2).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]
    assert rans_tokens.round_trip(docs.limit(0), WORDS, 2).count() == 0


def test_pieces_are_worked_on_in_small_slices(monkeypatch):
    """What a worker needs grows with the text it takes at once, so that is bounded; memory goes back once a table gives way to another."""
    taken, returned = [], []
    monkeypatch.setattr(agenda.MergeModel, "encode_batch", lambda self, texts: taken.append(texts) or (np.zeros(2 * len(texts), np.uint32), 2 * np.arange(len(texts) + 1)))
    monkeypatch.setattr(agenda.MergeModel, "decode_batch", lambda self, ids, starts: [b""] * (len(starts) - 1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(90)), pa.array(["word " * 20_000] * 90)], names=["doc_id", "text"])
    rows = sum(b.num_rows for b in agenda._digests(iter([batch]), PIECES))
    assert rows == 90 and max(t.nbytes for t in taken) < 5 << 20
    monkeypatch.setattr(arrowtext, "give_back", lambda: returned.append(1))
    for table in (arrowtext.PieceTable(lambda p: (np.zeros(len(p)), np.ones(len(p), np.int64)), float) for _ in range(2)):
        table.gather(np.zeros(1, np.int64), ["a"])
    assert returned
