import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidecast.llm import bpe, queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check_digests(rows, got):
    assert len(got) == len(rows)
    want = []
    for i, text in rows:
        ids = library_ids(text)
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(back)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_query(spark, sf, small):
    check_digests([(r.doc_id, r.text) for r in small], queries.op6_bpe(spark, sf).collect())


def test_bpe_odd_rows(odd, odd_rows, no_docs):
    check_digests(odd_rows, bpe.digests(odd, PATH).collect())
    assert bpe.digests(no_docs, PATH).count() == 0


def test_encode_and_decode_tables(odd, odd_rows):
    encoded = bpe.encode(odd, PATH)
    back = bpe.decode(encoded, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in odd_rows), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aab 's\n\t<|endoftext|>", max_size=60)), max_size=8))
def test_both_encoders_equal_the_library(texts):
    for vocab in (bpe.vocabulary(PATH), token_files.library_encoder(PATH)):
        ids, counts = vocab.encode(texts)
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [library_ids(t) for t in texts]
        for t in texts:
            assert vocab.decode(library_ids(t)) == LIBRARY.decode(library_ids(t), skip_special_tokens=False)


def test_many_small_gatherings_and_blocks(monkeypatch, small):
    texts = [r.text for r in small]
    vocab = bpe.Vocabulary(PATH)
    whole = [r.tolist() for r in vocab.rows(texts)]
    assert whole == [library_ids(t) for t in texts]
    for pending, bits in ((1, 0), (7, 16), (100, 3)):
        monkeypatch.setattr(bpe, "PENDING", pending)
        monkeypatch.setattr(bpe, "BLOCK_BITS", bits)
        assert [r.tolist() for r in vocab.rows(texts[:40])] == whole[:40]


def plain_positions(rows):
    at, out = 0, []
    for i, text in rows:
        ids = library_ids(text) + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_query(spark, sf, small):
    got = queries.op3_token_files(spark, sf).collect()
    assert sorted(map(tuple, got)) == plain_positions([(r.doc_id, r.text) for r in small])


def test_token_files_odd_rows(odd, odd_rows, no_docs):
    got = sorted(map(tuple, token_files.round_trip(odd, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])))[:-1].tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in plain_positions(odd_rows))
    assert token_files.round_trip(no_docs, PATH).count() == 0


def test_files_are_sorted_with_statistics(spark, small, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = str(tmp_path / "t")
    token_files.write_token_files(docs, PATH, folder)
    rows = token_files.read_token_files(spark, folder, [small[3].doc_id, small[50].doc_id])
    assert sorted(r.doc_id for r in rows.collect()) == [small[3].doc_id, small[50].doc_id]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    from pyarrow import orc

    last = -1
    for file in sorted((tmp_path / "t").glob("part-*.orc")):
        data = orc.ORCFile(str(file))
        ids = data.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
        assert data.row_index_stride == token_files.INDEX_ROWS and data.compression == "ZSTD"


def test_other_vocabularies_are_refused(tmp_path):
    text = open(PATH, encoding="utf-8").read().replace('"add_prefix_space":false', '"add_prefix_space":true', 1)
    text = text.replace('"add_prefix_space": false', '"add_prefix_space": true', 1)
    other = tmp_path / "v.json"
    other.write_text(text, encoding="utf-8")
    with pytest.raises(ValueError):
        token_files.LibraryEncoder(str(other))
