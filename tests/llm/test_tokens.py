"""Encoding, decoding and counting against the public libraries."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from samples import ROWS, SCHEMA
from tokenizers import Tokenizer

from tidegauge.llm import bpe_merge, piece_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_digests(spark, library):
    got = bpe_merge.round_trip_digests(spark.createDataFrame(ROWS, SCHEMA)).collect()
    want = []
    for i, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_ids_and_decoded_text(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    encoded = bpe_merge.encode_documents(docs)
    for r in encoded.collect():
        assert r.ids == library.encode(r.row.text or "", add_special_tokens=False).ids
    for r in bpe_merge.decode_documents(encoded).collect():
        ids = library.encode(r.row.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_merge.round_trip_digests(docs.limit(0)).count() == 0


def test_small_memory_and_single_merges_give_equal_ids(library):
    texts = [t or "" for _, t, *_ in ROWS]
    encoder = bpe_merge.Encoder(bpe_merge.MergeTable("word_bpe_49k.json"), known_bytes=3)
    encoder.table.grown = False
    for text in texts[:12] + texts[13:-3]:
        words = bpe_merge.chunks(text)
        encoder.learn(set(words))
        assert np.frombuffer(b"".join(encoder.known[w] for w in words), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = piece_counts.count_tokens(docs).collect()
    want = []
    for i, text, *_ in ROWS:
        n = len(model.encode(text or ""))
        want.append((i, len((text or "").encode()), n, n > 4096))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert piece_counts.count_tokens(docs.limit(0)).count() == 0


def test_small_memory_counts():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counter = piece_counts.PieceCounter("piece_bpe_32k.model", known_bytes=2)
    for _, text, *_ in ROWS[:-3]:
        assert counter.counts([text or ""]) == [len(model.encode(text or ""))]
