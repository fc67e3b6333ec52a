"""Benchmark decontamination: which words of a document lie in a benchmark window.

The distinct windows of the benchmark go to the executors as a hash set. A scan hashes every run
of words of a document, looks the hash up and compares the bytes of each hit. The set has a bound
in bytes; a larger benchmark is split by (window, item) into blocks under that bound, so a window that
very many items share is spread as well, and the documents are scanned once per block, with the table
between two scans written to the shared folder.

Defined results: null and empty texts have no words and no hits; repeated rows each get their own
row; an empty benchmark hits nothing; benchmark rows without words have no window; a null item id
marks words but counts as no item. Columns of the input are carried in one struct ``row``, so no
name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import ALNUM, Words, row_blocks, run_hashes, run_starts, text_bytes
from tidegauge.llm.shared import written

WINDOW = 10
MAX_SET_BYTES = 64 << 20


def benchmark_windows(bench: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct (window, n, item) rows; a text of fewer than ``n`` words is one window."""

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            words = Words(data, offsets, ALNUM)
            found, sizes, items = [], [], []
            ids = batch.column(0).to_pylist()
            for row, (first, count) in enumerate(zip(words.first, words.counts, strict=False)):
                size = min(n, int(count))
                for at in range(first, first + count - size + 1) if size else ():
                    found.append(words.phrase(at, size))
                    sizes.append(size)
                    items.append(ids[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array(sizes, pa.int32()), pa.array(items, pa.string())], ["phrase", "n", "item"]
            )

    source = bench.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return source.mapInArrow(cut, "phrase binary, n int, item string").distinct()


def window_table(rows) -> dict:
    """Windows of one block as plain arrays and lists by size: sorted hashes, texts, owners and a gate of hash prefixes.

    Only built-in and numpy types, so workers need no copy of this package to read a broadcast of it.
    """
    table: dict[int, dict[bytes, list[str]]] = {}
    for phrase, n, item in rows:
        items = table.setdefault(n, {}).setdefault(bytes(phrase), [])
        if item is not None:
            items.append(item)
    sizes = {}
    for n, phrases in table.items():
        texts = list(phrases)
        keys = run_hashes_of(pa.array([t.decode("utf-8", "surrogateescape") for t in texts], pa.large_string()), n)
        order = np.argsort(keys, kind="stable")
        gate = np.zeros(1 << 16, dtype=bool)
        gate[(keys >> np.uint64(48)).astype(np.int64)] = True
        sizes[n] = (keys[order], [texts[i] for i in order], [tuple(sorted(phrases[texts[i]])) for i in order], gate)
    return sizes


def run_hashes_of(phrases: pa.Array, n: int) -> np.ndarray:
    data, offsets = text_bytes(phrases)
    words = Words(data, offsets, ALNUM)
    return run_hashes(words.hashes(), n)[words.first[:-1]]


def _scan(words: Words, windows: dict, covered: np.ndarray, items: list[set]) -> None:
    """Add to the covered words and to each text's items what one block finds."""
    hashes = words.hashes()
    rows = words.rows()
    for n, (keys, texts, owners, gate) in windows.items():
        starts = run_starts(words, n)
        if not len(starts):
            continue
        found = run_hashes(hashes, n)[starts]
        near = gate[(found >> np.uint64(48)).astype(np.int64)]
        starts, found = starts[near], found[near]
        at = np.searchsorted(keys, found)
        hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == found)
        for start, key, low in zip(starts[hit].tolist(), found[hit], at[hit].tolist(), strict=True):
            phrase = words.phrase(start, n)
            while low < len(keys) and keys[low] == key:
                if texts[low] == phrase:
                    covered[start : start + n] = True
                    items[rows[start]].update(owners[low])
                    break
                low += 1


_RESULT = "n_words long, hits array<struct<first: int, last: int, start: int, stop: int>>, items array<string>"


def _pass_over(frame: DataFrame, block) -> DataFrame:
    """Scan the texts for one block; ``hits`` and ``items`` so far are added to."""
    names = frame.columns

    def scan(batches):
        windows = block.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(names.index("text")))
            for low, high in row_blocks(offsets):
                part = batch.slice(low, high - low)
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1], ALNUM)
                covered = np.zeros(len(words) + 1, dtype=bool)
                items = [set() for _ in range(high - low)]
                if "hits" in names:
                    for row, (old, seen) in enumerate(zip(part.column(names.index("hits")).to_pylist(), part.column(names.index("items")).to_pylist(), strict=True)):
                        items[row].update(seen)
                        for hit in old:
                            covered[words.first[row] + hit["first"] : words.first[row] + hit["last"] + 1] = True
                _scan(words, windows, covered, items)
                yield pa.RecordBatch.from_arrays(
                    [part.column(names.index("row")), part.column(names.index("text")), pa.array(words.counts, pa.int64()), _hits(words, covered), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["row", "text", "n_words", "hits", "items"],
                )

    schema = f"{frame.select('row', 'text')._jdf.schema().toDDL()}, {_RESULT}"
    return frame.mapInArrow(scan, schema)


def _hits(words: Words, covered: np.ndarray) -> pa.Array:
    """Runs of covered words within a text: word numbers and byte positions."""
    edge = np.zeros(len(words) + 1, dtype=bool)
    edge[words.first] = True
    body = covered[: len(words)]
    begin = body & (edge[:-1] | ~np.concatenate(([False], body[:-1])))
    end = body & (edge[1:] | ~np.concatenate((body[1:], [False])))
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    row = np.searchsorted(words.first, first, side="right") - 1
    fields = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int32)) for x in (first - words.first[row], last - words.first[row], words.starts[first] - words.offsets[row], words.ends[last] - words.offsets[row])],
        ["first", "last", "start", "stop"],
    )
    offsets = np.searchsorted(first, words.first).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), fields)


def find_contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, max_set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """``row`` (the input row), ``text``, ``n_words``, ``hits`` and sorted ``items`` of every document.

    A hit is a run of covered words: their first and last number and byte positions in the text.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(bench, item, item_text, n)
    size = windows.select(F.sum(F.length("phrase") + F.length(F.coalesce("item", F.lit(""))) + 150)).first()[0] or 0
    n_blocks = max(1, -(-size // max_set_bytes))
    frame = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    for number in range(n_blocks):
        rows = windows.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(n_blocks)) == number).collect()
        if number:
            frame = written(frame)
        frame = _pass_over(frame, spark.sparkContext.broadcast(window_table(rows)))
    return frame


def without_spans(found: DataFrame) -> DataFrame:
    """Texts of `find_contamination` with the covered byte spans cut out, as ``clean_text``."""

    def cut(batches):
        for batch in batches:
            clean = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                if hits:
                    raw, kept, at = text.encode(), [], 0
                    for hit in hits:
                        kept.append(raw[at : hit["start"]])
                        at = hit["stop"]
                    text = (b"".join(kept) + raw[at:]).decode()
                clean.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean, pa.string())], [*batch.schema.names, "clean_text"])

    return found.mapInArrow(cut, f"{found._jdf.schema().toDDL()}, clean_text string")


def clean_documents(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents without any covered word, with their own columns."""
    found = find_contamination(docs, bench, **options)
    return found.where(F.size("hits") == 0).select("row.*")


def contamination_report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """One row per document: counts of words, covered words and items, and the items' digest."""
    found = find_contamination(docs.select("doc_id", "text"), bench.select("item_id", "text"), **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"] + 1)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
