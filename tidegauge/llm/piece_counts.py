"""Token counts of a BPE piece model by heap and linked list; no identifiers are made.

A chunk's characters form a linked list. The heap holds neighbours whose joined text is a piece;
the best-ranked, then leftmost pair is popped and joined until none is left. The count is the
initial symbols less the merges, where a character outside the vocabulary counts its bytes.

Pieces hold the space mark only in front, so a text is cut before each run of spaces and equal
chunks are counted once per worker, in a memory with a bound.

Defined results: null and empty texts have no tokens; repeated rows get equal rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import Memory, kept_by_worker, vocabulary

KNOWN_BYTES = 160 << 20
MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


class PieceCounter:
    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
        kinds = (model.is_unknown, model.is_control, model.is_byte, model.is_unused)
        #: Rank of each piece, best first; equal scores share a rank, so the left one wins.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not any(kind(i) for kind in kinds)}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece holds the space mark behind other characters")
        self.memory = Memory(known_bytes)

    def count(self, chunk: str) -> int:
        rank = self.rank
        chars = list(chunk)
        n = len(chars)
        total = sum(1 if c in rank else len(c.encode()) for c in chars)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            pair = chars[i] + chars[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, left, text = heapq.heappop(heap)
            right = after[left]
            if right < 0 or not chars[left] or chars[left] + chars[right] != text:
                continue
            chars[left], chars[right] = text, ""
            total -= 1
            follow = after[left] = after[right]
            if follow >= 0:
                before[follow] = left
                pair = text + chars[follow]
                if pair in rank:
                    heapq.heappush(heap, (rank[pair], left, pair))
            ahead = before[left]
            if ahead >= 0:
                pair = chars[ahead] + text
                if pair in rank:
                    heapq.heappush(heap, (rank[pair], ahead, pair))
        return total

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split = [chunks(t) for t in texts]
        missing = self.memory.missing(set(chain.from_iterable(split)))
        known = self.memory.now
        for chunk in missing:
            known[chunk] = self.count(MARK + chunk if chunk[0] != " " else chunk.replace(" ", MARK))
        return [sum(map(known.__getitem__, words)) for words in split]


def chunks(text: str) -> list[str]:
    """A text's words, each with one space in front understood; other runs of spaces are kept."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    found = _CHUNK.findall(" " + text)
    return [c[1:] if len(c) > 1 and c[1] != " " else c for c in found]


def count_tokens(docs: DataFrame, path: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Per document: bytes, tokens, and whether the tokens are more than ``limit``."""

    def run(batches):
        counter = kept_by_worker(f"pieces_{path}", lambda: PieceCounter(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, low = [], 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and size < 4 << 20:
                    size += len(texts[high] or "")
                    high += 1
                counts += counter.counts([t or "" for t in texts[low:high]])
                low = high
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
