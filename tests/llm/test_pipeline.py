"""Every stage of the pipeline against a plain version, each on the written result of the stage before."""

import hashlib
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from stockaudit.llm import language_zstd, pii_boosting, queries, string_tiling, tables, weighted_minhash, words
from stockaudit.llm.tables import read
from tests.llm.test_filters import plain_language
from tests.llm.test_pairs import plain_matches, seed_places


@pytest.fixture(scope="module")
def written(spark, sf_dir, tmp_path_factory):
    """The input of each stage and its written result."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), read(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def by_id(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_columns_stay_until_the_last_stage(spark, sf_dir, written):
    for docs, after in written[:-1]:
        assert after.columns == docs.columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, written[-1][1].collect()))


def test_language_stage(written):
    docs, after = written[0]
    learned, rows, kept = language_zstd.learn(docs), by_id(docs), by_id(after)
    found = {r.doc_id: r for r in language_zstd.identify(docs).collect()}
    assert set(kept) == {k for k, r in found.items() if not r.rejected} and all(kept[k] == rows[k] for k in kept)
    # Rejected are texts that no language tells, or that two tell equally; all others stay.
    for k in set(rows) - set(kept):
        text = rows[k].text or ""
        assert plain_language(text, learned) == "und" or len(text) < 200 or found[k].score < language_zstd.MIN_MARGIN
    assert len(kept) >= 0.9 * len(rows)


def test_near_duplicate_stage(written):
    docs, after = written[1]
    rows, inverse = sorted(by_id(docs).items()), weighted_minhash.learn_weights(docs)
    sets, label = [], {}
    for k, r in rows:
        w = words.words(r.text or "")
        values = np.array([words._hashes([x])[0][0] for x in w], np.uint64)
        hashes, counts = weighted_minhash.shingles(values)
        sets.append((k, hashes, weighted_minhash.weights(hashes, counts, inverse), tuple(w) or r.text or ""))
        label[k] = k
    for a, b in itertools.combinations(sets, 2):
        alike = a[3] == b[3] or len(a[1]) and len(b[1]) and weighted_minhash.similarity(a[1:3], b[1:3]) >= weighted_minhash.SIMILARITY
        if alike and label[a[0]] != label[b[0]]:
            old, new = max(label[a[0]], label[b[0]]), min(label[a[0]], label[b[0]])
            label = {k: new if v == old else v for k, v in label.items()}
    assert set(by_id(after)) == set(label.values()) and len(set(label.values())) < len(rows)


def test_benchmark_stage(spark, sf_dir, written):
    docs, after = written[2]
    items = [words.words(r.text or "") for r in read(spark, sf_dir, "benchmark").collect()]
    grams = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]
    bad = set()
    for k, r in by_id(docs).items():
        doc = words.words(r.text or "")
        own = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        for item, five in zip(items, grams):
            if own & five:
                covered = sum(t[2] for t in string_tiling.tiles(plain_matches(seed_places(doc, item))))
                if covered >= string_tiling.COVERAGE * len(item):
                    bad.add(k)
    assert bad and set(by_id(after)) == set(by_id(docs)) - bad


def test_personal_data_stage(written):
    docs, after = written[3]
    rows, changed = by_id(docs), by_id(after)
    assert set(rows) == set(changed)
    hidden = 0
    for r in pii_boosting.digests(docs).collect():
        spans = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in r.spans.split(",") if s))
        text, out, at = rows[r.doc_id].text, "", 0
        for start, end, kind in spans:
            if start >= at:
                out += text[at:start] + f"[{kind}]"
                hidden += 1
            at = max(at, end)
        want = text if text is None or not spans else out + text[at:]
        assert changed[r.doc_id].text == want and changed[r.doc_id].n_chars == (None if want is None else len(want))
    assert hidden


def test_sentencepiece_stage(written):
    docs, after = written[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    found = by_id(after)
    for k, r in by_id(docs).items():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert (found[k].n_tokens, found[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert found[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert len(found) == docs.count()


def test_filtered_joins_give_the_same(written, monkeypatch):
    """As if all tables were too large to be sent."""
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables, "LISTED_ROWS", 0)
    for stage, (docs, after) in ((weighted_minhash.one_of_each, written[1]), (pii_boosting.redact, written[3])):
        assert sorted(map(tuple, stage(docs).collect()), key=repr) == sorted(map(tuple, after.collect()), key=repr)


def test_stages_delete_what_earlier_ones_stored(spark, sf_dir, tmp_path):
    tables.begin_chain()
    kept = tables.landed(spark.range(3), "kept")
    other = tables.landed(spark.range(4), "other")
    tables.reclaim(kept)
    assert kept.count() == 3 and kept.inputFiles()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        other.count()
    tables.forget(kept)
    tables.begin_chain()


def test_workers_get_batches_of_bounded_bytes(spark, tmp_path):
    from stockaudit.llm import arrowtext

    spark.range(6000).selectExpr("id AS doc_id", "repeat('ab ', 700) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.piece_ids(spark, docs, str(tmp_path))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 2 and max(r.n for r in sizes) < 1.2 * arrowtext.SLICE_BYTES
