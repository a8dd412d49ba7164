import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from arraymill.llm import packing
from arraymill.llm.queries import vocabulary

TEXTS = ["Hello world.\nNew line, it's fine.", "", None, "two  blanks", " edge ", "tab\tand nbsp x  y", "<|endoftext|> a", "ünï cödé 'tis\n\n12 345", "word " * 3000, "Hello world.\nNew line, it's fine.", "a\x00b c"]


def expected(text):
    plain = Tokenizer.from_file(vocabulary())
    return [*plain.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("window", [2048, 7])
def test_every_id_lies_in_one_piece(spark, window):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, part string").repartition(3)
    rows = packing.pack(docs, vocabulary(), window).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        pieces = sorted(by_doc[i if i else None], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u2") for r in pieces]).tolist() == expected(t)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(expected(t))}
    for s, pieces in by_seq.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == window or s == max(by_seq)


def test_digest_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    row = packing.ids_crc32(packing.pack(docs, vocabulary())).collect()[0]
    assert row.ids_crc32 == zlib.crc32(np.array(expected("some text"), "<u4").tobytes())
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_one_python_worker_a_task_and_any_width_of_ids(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    found = packing.ids_crc32(packing.pack(docs, vocabulary()))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    ids = np.array([1, 0, 65535, 0x0A0D, 256], "<u2")
    table = spark.createDataFrame([(bytearray(ids.tobytes()), 3), (bytearray(), 4)], "ids binary, `a.b` int")
    assert [(r[0], r[1]) for r in packing.ids_crc32(table).orderBy("`a.b`").collect()] == [(zlib.crc32(ids.astype("<u4").tobytes()), 3), (0, 4)]


def test_each_chunk_of_a_batch_is_encoded_once():
    encoder, given = packing.Encoder(vocabulary()), []
    fast = encoder.fast
    encoder.fast = lambda text: given.append(text) or fast(text)
    texts = ["one two  three\nfour　 five", " edges ", "é à  b\x85 c\x1c d", "", "\n", "é à \nx\n\nà b"]
    ids, n = encoder(pa.array(["left out", *texts * 500]).slice(1))
    assert [np.frombuffer(x, "<u2").tolist() for x in ids.to_pylist()] == [expected(t) for t in texts] * 500
    assert n.tolist() == [len(expected(t)) for t in texts] * 500
    assert sum(map(len, given)) < 2 * sum(map(len, texts))
    assert encoder(pa.array([], pa.string()))[0].to_pylist() == []
