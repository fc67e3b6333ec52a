"""Token files: contents against the library, order, starts, and the layout of the files."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from samples import ROWS, SCHEMA
from tokenizers import Tokenizer

from tidegauge.llm import token_files as op


def expected(rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_digests_follow_the_id_order(spark):
    rows = sorted((r[:2] for r in ROWS), key=lambda r: (r[0] is not None, r[0]))
    got = sorted((tuple(r) for r in op.file_digests(spark.createDataFrame(ROWS, SCHEMA)).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_repeated_rows_follow_each_other(spark):
    rows = [(4, "b c"), (4, "b c"), (4, "a"), (1, "x")]
    got = sorted((tuple(r) for r in op.file_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 4, 4, 4] and got[-1][1] + got[-1][2] == sum(r[2] for r in got)
    assert [a[1] + a[2] for a in got[:-1]] == [b[1] for b in got[1:]]
    assert op.file_digests(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_small_memory_gives_equal_ids():
    import pyarrow as pa

    from tidegauge.llm.bytewords import text_bytes

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = op.ChunkEncoder("word_bpe_49k.json", known_bytes=2)
    texts = [text or "" for _, text, *_ in ROWS] + ["<|ENDOFTEXT|> AÀ <|endoftext|>", "a\u00a0B\u2003c"]
    for group in [[t] for t in texts] + [texts]:
        want = [library.encode(t, add_special_tokens=False).ids + [2] for t in group]
        ids, sizes = encoder.encode(*text_bytes(pa.array(group)), 2)
        assert (ids.tolist(), sizes.tolist()) == (sum(want, []), list(map(len, want)))


def test_parts_of_one_kind_are_learned_once():
    import pyarrow as pa

    from tidegauge.llm.bytewords import text_bytes

    encoder = op.ChunkEncoder("word_bpe_49k.json")
    encoder.encode(*text_bytes(pa.array(["thoner thoner, (thoner) thoner*** 12-thoner12 ", "don't thoner"])), 2)
    assert set(encoder.memory.now) == {b"thoner", b",", b"(", b")", b"***", b"-", b"12", b"don't"}


def test_parts_of_odd_chunks_are_those_of_the_library():
    import random

    import pyarrow as pa

    from tidegauge.llm.bytewords import text_bytes

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(5)
    some = [*"aZé×÷ßÀÿ'sS109.,-_|<>=&`\\ \t\n\x0b\x1c\x85\u00a0\u0338\u0301İΣſ\u212a\u65e5\u0663\u2019\U0001f600\x00\x7f", "'re", "'LL", "<|endoftext|>", "<|", "the", "\u0130", "…"]
    texts = ["".join(draw.choices(some, k=draw.randrange(30))) for _ in range(1000)]
    encoder = op.ChunkEncoder("word_bpe_49k.json")
    for low in range(0, len(texts), 7):
        group = texts[low : low + 7]
        want = [library.encode(t, add_special_tokens=False).ids + [2] for t in group]
        ids, sizes = encoder.encode(*text_bytes(pa.array(group)), 2)
        assert (ids.tolist(), sizes.tolist()) == (sum(want, []), list(map(len, want)))


def test_files_have_the_declared_layout(spark, tmp_path):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('thanedble', id % 50, ' ouchan er '), 40) AS text")
    op.write_tokens(docs, str(tmp_path))
    files = glob.glob(f"{tmp_path}/tokens/*.parquet")
    assert files
    for file in files:
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            by = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and "DELTA_BINARY_PACKED" in by["local_start"].encodings
            assert "RLE_DICTIONARY" in by["tokens.list.element"].encodings
            assert by["doc_id"].has_column_index and by["doc_id"].has_offset_index
            assert by["tokens.list.element"].total_uncompressed_size < 4 * meta.row_group(g).num_rows * 400
    one = op.read_tokens(spark, str(tmp_path)).where("doc_id = 4321")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4321)" in one._jdf.queryExecution().toString().replace("IsNotNull(part), ", "")
    assert one.count() == 1
    slim = op.read_tokens(spark, str(tmp_path)).select("doc_id", "start")
    assert "tokens:array" not in slim._jdf.queryExecution().executedPlan().toString()
