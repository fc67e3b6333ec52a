"""Token files: Parquet with one row per document in ascending id order.

Columns: doc_id, part, local_start, n_tokens and the list ``tokens``. Token ids are dictionary-encoded
and packed to the bits they need; the metadata columns are delta-encoded. Row groups and pages are
small enough that Parquet's page index lets a reader fetch a range of documents, or only metadata.
A second small table holds one row per written partition with the tokens before it, so the first
token's place in the whole stream is known without touching tokens.

The tokenizers library encodes; a worker keeps the ids of parts of the chunks between ASCII white space, which that
vocabulary drops, up to a bound. A chunk of Latin letters, ASCII marks and digits alone is cut where one follows another, as
the vocabulary's word pattern cuts it; any other chunk is one part.

Defined results: null and empty texts hold the end id alone; null ids come first; repeated ids are
ordered by a hash of their text, and repeated rows follow each other; an empty table gives empty files. Other
columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import compress, pairwise
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import NON_SPACE, Words, row_blocks, text_bytes
from tidegauge.llm.shared import Memory, forget_worker_values, kept_by_worker, vocabulary, work_folder

KNOWN_BYTES = 112 << 20
END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1000
BLOCK_BYTES = 2 << 20
#: Kinds of bytes: white space, Latin letters, marks, digits, and all others.
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
#: An apostrophe may begin a word of the vocabulary's pattern, and ``<`` a special string; both count as others.
_KINDS = np.full(256, _OTHER, dtype=np.uint8)
_KINDS[~NON_SPACE] = _SPACE
for _kind, _bytes in (
    (_LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (_MARK, b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"), (_DIGIT, b"0123456789"),
):
    _KINDS[list(_bytes)] = _kind


def part_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; all bytes of a chunk that holds an other one are others.

    Here a chunk may run over the end of a text: its parts are then longer than need be, never wrong.
    """
    kinds = _KINDS[data]
    # U+00C0 to U+00FF without the signs for times and division.
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kinds[lead] = kinds[lead + 1] = _LETTER
    others = kinds == _OTHER
    if others.any():
        spaces = np.flatnonzero(kinds == _SPACE)
        bounds = np.concatenate(([-1], spaces, [len(kinds)]))
        before = np.concatenate(([0], np.cumsum(others)))
        whole = np.repeat(before[bounds[1:]] > before[bounds[:-1] + 1], np.diff(bounds))[:-1]
        whole[spaces] = False
        kinds[whole] = _OTHER
    return kinds


class ChunkEncoder:
    """Ids of parts as 32-bit words, by the library; unknown parts of a batch go to it together."""

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory(known_bytes)
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        #: Whether an id ends a word, where the vocabulary tells.
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True

    def learn(self, parts: list[bytes], plain: list[bool]) -> None:
        """Encode the parts not known yet; plain ones are of one kind, letters, marks or digits."""
        self._learn_lines(list(self.memory.missing(set(compress(parts, plain)))))
        rest = self.memory.missing(set(compress(parts, map(not_, plain))), turn=False)
        encoded = self.tokenizer.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)
        self.memory.now.update(zip(rest, [array("I", got.ids).tobytes() for got in encoded], strict=True))

    def _learn_lines(self, parts: list[bytes]) -> None:
        """Encode plain parts as long texts; the ids that end a word tell them apart: one a part, or one a digit."""
        if not parts:
            return
        lines = [b" ".join(parts[low : low + 1000]).decode() for low in range(0, len(parts), 1000)]
        encoded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(got.ids, dtype="<u4") for got in encoded])
        words = np.fromiter((len(x) if x.isdigit() else 1 for x in parts), np.int64, len(parts))
        last = np.flatnonzero(self.ends[ids])
        if len(last) != words.sum():
            raise ValueError("the vocabulary does not cut letters, marks and digits apart")
        cuts = [0, *((last[np.cumsum(words) - 1] + 1) * 4).tolist()]
        data = ids.tobytes()
        self.memory.now.update(zip(parts, [data[a:b] for a, b in pairwise(cuts)], strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's end id included, and how many each has."""
        # A special string in capitals is none, so texts that may hold one keep them.
        words = Words(data, offsets, NON_SPACE if self.ends is None else part_kinds, fold=b"<|" not in data.tobytes())
        if not len(words):
            return np.full(len(offsets) - 1, end_id, "<u4"), np.ones(len(offsets) - 1, np.int64)
        which, first = words.numbers()
        parts = words.bytes_of(first)
        self.learn(parts, ((words.kinds[first] != _OTHER) & (self.ends is not None)).tolist())
        # The end id is one more part, after each text's own.
        found = [*map(self.memory.now.__getitem__, parts), end_id.to_bytes(4, "little")]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        which = np.insert(which, words.first[1:], len(parts))
        each = sizes[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.diff(ends[words.first[1:] + np.arange(len(offsets) - 1)], prepend=0)


_SCHEMA = "part int, local_start long, n_tokens long, tokens array<int>"


def encoded(docs: DataFrame, path: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """Rows of the token files, dealt by range of ids and in order within each partition."""

    def run(batches):
        encoder = kept_by_worker(f"library_{path}", lambda: ChunkEncoder(path))
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high in row_blocks(offsets, BLOCK_BYTES):
                ids, sizes = encoder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1], end_id)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                tokens = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.full(high - low, part, np.int32)), pa.array(at + cuts[:-1]), pa.array(sizes), tokens],
                    ["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                at += int(cuts[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


def write_tokens(docs: DataFrame, folder: str, path: str = "word_bpe_49k.json", end_id: int = END_ID) -> None:
    """Write the token files and the table of partition offsets."""
    writer = encoded(docs, path, end_id).write.option("compression", "snappy")
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start", "n_tokens")},
    }
    writer.options(**{k: str(v) for k, v in options.items()}).parquet(f"{folder}/tokens")
    parts = docs.sparkSession.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each written partition.
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and tokens; unused columns and documents outside a filter are not read."""
    parts = spark.read.parquet(f"{folder}/parts")
    tokens = spark.read.parquet(f"{folder}/tokens")
    return tokens.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """`read_tokens` with the crc32 of each list as little-endian 32-bit words instead of the list."""

    def run(batches):
        # The encoder of an earlier stage may still be in this worker.
        forget_worker_values()
        for batch in batches:
            lists = batch.column(3)
            values, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], [*batch.schema.names[:3], "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def file_digests(docs: DataFrame, path: str = "word_bpe_49k.json") -> DataFrame:
    """Write the token files to the shared folder and return what is read back from them."""
    folder = work_folder(docs.sparkSession)
    write_tokens(docs, folder, path)
    return checksums(read_tokens(docs.sparkSession, folder))
