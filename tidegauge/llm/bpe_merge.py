"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each round forms the pair of every two
neighbours, finds its rank by binary search over the sorted pair keys, takes the lowest rank of
each word and merges all its places, from the left. Words without a pair leave the batch. A worker
keeps the words it has met, up to a bound; results never depend on it.

The vocabulary is a byte-level BPE file with an end-of-word suffix: NFC, white space runs as one
space, lower case by character, words by pattern, special strings cut out first.

Defined results: null and empty texts have no tokens; repeated rows get equal rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.shared import Memory, kept_by_worker, vocabulary

KNOWN_BYTES = 64 << 20
#: The word pattern of the vocabulary file, and what splits words in every text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
_SHIFT = np.int64(1 << 20)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class MergeTable:
    """Pair keys in order, their ranks and products, and the strings of all ids."""

    def __init__(self, path: str):
        import regex

        with open(vocabulary(path), encoding="utf-8") as file:
            spec = json.load(file)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in chain(vocab.items(), self.special.items())}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.words = regex.compile(WORD_PATTERN)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * int(_SHIFT) + vocab[b] for a, b in pairs], dtype=np.int64)
        products = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.products = keys[order], order.astype(np.int64), products
        born = {int(p): rank for rank, p in enumerate(products)}
        #: With every part older than its product, all places of a rank can merge in one round.
        self.grown = all(max(born.get(vocab[a], -1), born.get(vocab[b], -1)) < rank for rank, (a, b) in enumerate(pairs))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word begins in it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        symbols[np.cumsum(sizes) - 1] = self.final[data[np.cumsum(sizes) - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        none = np.int64(len(self.ranks))
        while len(symbols):
            key = symbols[:-1] * _SHIFT + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, heads)
            low = np.repeat(lowest, np.diff(np.append(heads, len(owner))))
            over = low == none
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            here = (rank == low) & ~over
            places = np.flatnonzero(here)
            if self.grown:
                # Of touching places (a pair of equal symbols) every second one merges, from the left.
                run = np.flatnonzero(np.diff(places, prepend=-2) != 1)
                length = np.diff(np.append(run, len(places)))
                places = places[(np.arange(len(places)) - np.repeat(run, length)) % 2 == 0]
            else:
                places = places[np.concatenate(([True], owner[places][1:] != owner[places][:-1]))] if len(places) else places
            symbols[places] = self.products[rank[places]]
            keep = ~over
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_owner:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def chunks(text: str) -> list[str]:
    """Pieces between white space."""
    if _ODD_SPACE.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def lowered(text: str) -> str:
    """Lower case character by character (no final sigma)."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class Encoder:
    """Token ids of chunks as 32-bit words; encodes the unknown ones of a batch together."""

    def __init__(self, table: MergeTable, known_bytes: int = KNOWN_BYTES):
        self.table, self.memory = table, Memory(known_bytes)
        self.named: dict[str, tuple[str, str]] = {}
        self.named_bytes = 0

    @property
    def known(self) -> dict[str, bytes]:
        return self.memory.now

    def names(self, chunk: str) -> tuple[str, str]:
        """A known chunk's ids as text, and what they decode to."""
        found = self.named.get(chunk)
        if found is None:
            ids = np.frombuffer(self.known[chunk], dtype="<u4").tolist()
            found = self.named[chunk] = (" ".join(map(str, ids)), self.decode(ids))
            self.named_bytes += sys.getsizeof(found[0]) + sys.getsizeof(found[1]) + Memory.OVERHEAD
        return found

    def learn(self, wanted: set[str]) -> None:
        """Encode the chunks not known yet."""
        table, found = self.table, self.memory.missing(wanted)
        if self.named_bytes > self.memory.limit:
            self.named.clear()
            self.named_bytes = 0
        plans, words = [], {}
        for chunk in found:
            parts = []
            for text, special in self._cut(chunk):
                if special is not None:
                    parts.append(-special - 1)
                else:
                    for word in table.words.findall(lowered(unicodedata.normalize("NFC", text))):
                        parts.append(words.setdefault(word, len(words)))
            plans.append((chunk, parts))
        ids, first = table.encode([w.encode() for w in words])
        data, first = ids.astype("<u4").tobytes(), (4 * first).tolist()
        known = self.memory.now
        for chunk, parts in plans:
            known[chunk] = b"".join([data[first[p] : first[p + 1]] if p >= 0 else (-p - 1).to_bytes(4, "little") for p in parts])

    def _cut(self, chunk: str):
        at = 0
        if "<" in chunk:
            for hit in self.table.cut.finditer(chunk):
                yield chunk[at : hit.start()], None
                yield "", self.table.special[hit[0]]
                at = hit.end()
        yield chunk[at:], None

    def decode(self, ids) -> str:
        """The ids' strings, joined by one space."""
        return " ".join(map(self.table.strings.__getitem__, ids))


def _encoder(path: str) -> Encoder:
    return kept_by_worker(f"encoder_{path}", lambda: Encoder(MergeTable(path)))


def _encoded(texts: list[str], encoder: Encoder):
    """Per text its chunks; all of them are known to the encoder afterwards."""
    split = [chunks(t) for t in texts]
    encoder.learn(set(chain.from_iterable(split)))
    return split


def _text_blocks(column: pa.Array, limit: int = 4 << 20):
    """(first row, texts) with about ``limit`` characters each."""
    texts, at, size = [], 0, 0
    for row, text in enumerate(column.to_pylist()):
        texts.append(text or "")
        size += len(texts[-1])
        if size >= limit:
            yield at, texts
            texts, at, size = [], row + 1, 0
    if texts:
        yield at, texts


def encode_documents(docs: DataFrame, path: str = "word_bpe_49k.json") -> DataFrame:
    """``row`` (the input row) and ``ids`` of every document's whole text."""
    from pyspark.sql import functions as F

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for low, texts in _text_blocks(batch.column(1)):
                found = [b"".join(map(encoder.known.__getitem__, words)) for words in _encoded(texts, encoder)]
                cuts = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), ids], ["row", "ids"])

    frame = docs.select(F.struct("*").alias("row"), "text")
    return frame.mapInArrow(run, f"{frame.select('row')._jdf.schema().toDDL()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = "word_bpe_49k.json") -> DataFrame:
    """``row`` and ``decoded`` text of a table of `encode_documents`."""

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            texts = [encoder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    frame = encoded.select("row", "ids")
    return frame.mapInArrow(run, f"{frame.select('row')._jdf.schema().toDDL()}, decoded string")


def round_trip_digests(docs: DataFrame, path: str = "word_bpe_49k.json") -> DataFrame:
    """Per document: number of tokens, and digests of the ids and of the text decoded from them."""

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for low, texts in _text_blocks(batch.column(1)):
                split = _encoded(texts, encoder)
                counts, digests, back = [], [], []
                for words in split:
                    pairs = [p for p in map(encoder.names, words) if p[0]]
                    ids = " ".join([p[0] for p in pairs])
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    digests.append(hashlib.sha256(ids.encode()).hexdigest())
                    back.append(hashlib.sha256(" ".join([p[1] for p in pairs]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(texts)), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
