"""Line deduplication by content-defined chunks of lines, with DataFrame functions only.

A rolling hash runs over the hashes of each two successive lines; a line whose value is below those
of its neighbours ends a chunk, so an inserted line moves only the boundaries beside it. A line of
``LONG_LINE`` words or more is a chunk of its own. Chunks of several lines, or of one long line,
are counted over all documents by their bytes; a repeated chunk stays only at its first place in the
document with the smallest id, and is removed everywhere else.

The bytes are compared by grouping on the chunk's text; a place is matched with a group by two
64-bit hashes and the length. Groups that only those could not tell apart are left alone.

A second level, ``runs=True``, finds repeated passages whose lines are all short, wherever chunks end:
for each line with a word, the shortest run of lines from it, and the shortest up to it, that holds
``LONG_LINE`` words. Every line of a repeated passage of so many words lies in a run within it. Runs are
met by a hash first; those met twice are compared by bytes like chunks. Lines under a repeated run go,
except those of its first place, in the document with the smallest id.

Defined results: a null text stays null and has no lines; an empty text has one empty line; chunks
without a word are never removed; rows that share a doc_id count as one document when the first place
is chosen, and each loses chunks by its own text; rows with a null id are no one's first place, and if
only they hold a chunk it stays. A text whose lines all go is
empty. The input's columns stay in one struct ``row``, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import let, written

LONG_LINE = 50
_PRIME = 2147483629


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_lines(text: Column) -> Column:
    """Chunks in order: struct(lines, has_word, long)."""

    def rolled(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: (F.coalesce(F.get(hashes, i - 1), F.lit(0)) * 31 + h) % _PRIME)

    def ends(lines: Column, long: Column, rolls: Column) -> Column:
        def is_end(i: Column) -> Column:
            low = (F.get(rolls, i) < F.get(rolls, i - 1)) & (F.get(rolls, i) < F.get(rolls, i + 1))
            return (i == F.size(lines) - 1) | F.get(long, i) | F.coalesce(F.get(long, i + 1), F.lit(False)) | F.coalesce(low, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), is_end)

    def cut(lines: Column, long: Column, stops: Column) -> Column:
        def chunk(stop: Column, k: Column) -> Column:
            start = F.coalesce(F.get(stops, k - 1), F.lit(-1)) + 1
            return F.struct(F.slice(lines, start + 1, stop - start + 1).alias("lines"), start.alias("start"), F.get(long, stop).alias("long"))

        return F.transform(stops, chunk)

    return let(
        F.split(text, "\n"),
        lambda lines: let(
            F.transform(lines, lambda x: words_of(x) >= LONG_LINE),
            lambda long: let(
                F.transform(lines, line_hash),
                lambda hashes: let(rolled(hashes), lambda rolls: let(ends(lines, long, rolls), lambda stops: cut(lines, long, stops))),
            ),
        ),
    )


def words_of(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def line_runs(lines: Column) -> Column:
    """First and last line of the shortest runs of ``LONG_LINE`` words from each line and up to each line."""

    def spans(of_word: Column) -> Column:
        def span(w: Column) -> Column:
            here = F.get(of_word, w)
            opens = ~F.get(of_word, w - 1).eqNullSafe(here) & F.get(of_word, w + LONG_LINE - 1).isNotNull()
            closes = ~F.get(of_word, w + 1).eqNullSafe(here) & (w >= LONG_LINE - 1)
            pair = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
            none = F.lit(None).cast("struct<start: int, stop: int>")
            return F.array(
                F.when(opens, pair(here, F.get(of_word, w + LONG_LINE - 1))).otherwise(none),
                F.when(closes, pair(F.get(of_word, w - LONG_LINE + 1), here)).otherwise(none),
            )

        edges = F.filter(
            F.sequence(F.lit(0), F.size(of_word) - 1),
            lambda w: ~(F.get(of_word, w - 1).eqNullSafe(F.get(of_word, w)) & F.get(of_word, w + 1).eqNullSafe(F.get(of_word, w))),
        )
        found = F.array_distinct(F.filter(F.flatten(F.transform(edges, span)), lambda x: x.isNotNull()))
        return F.when(F.size(of_word) >= LONG_LINE, found).otherwise(F.array().cast("array<struct<start: int, stop: int>>"))

    return let(F.flatten(F.transform(lines, lambda x, i: F.array_repeat(i, words_of(x)))), spans)


def _runs(docs: DataFrame, text: str) -> DataFrame:
    """One row per run of lines, with a hash of its lines."""
    hashed = let(F.split(text, "\n"), lambda lines: let(F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: F.transform(
        line_runs(lines), lambda r: F.struct(
            r["start"].alias("start"), r["stop"].alias("stop"), F.xxhash64(F.slice(hashes, r["start"] + 1, r["stop"] - r["start"] + 1)).alias("hash"),
        ),
    )))
    return docs.where(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("text_key"), F.explode(hashed).alias("run")).select("doc_id", "text_key", "run.*")


def run_removals(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, hash of the text, and the numbers of its lines under repeated runs."""
    met = written(_runs(docs, text).groupBy("hash").count().where("count > 1").select("hash"))
    held = _runs(docs, text).join(met, "hash").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    held = written(held).select(F.col("doc_id").alias("held_id"), F.col("text_key").alias("held_key"), "runs")
    both = docs.withColumn("text_key", F.xxhash64(text)).join(held, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("text_key") == F.col("held_key")))
    rows = both.select("doc_id", "text_key", F.explode(let(F.split(text, "\n"), lambda lines: F.transform("runs", lambda r: F.struct(
        r["start"].alias("start"), r["stop"].alias("stop"), F.array_join(F.slice(lines, r["start"] + 1, r["stop"] - r["start"] + 1), "\n").alias("body"),
    )))).alias("run")).select("doc_id", "text_key", "run.*")
    found = _keyed(rows).drop("body").join(_repeated(rows), list(_KEY))
    # Within one document, a run's own first place covers the lines that overlapping places share with it.
    places = found.groupBy("doc_id", "text_key", *_KEY).agg(F.min("first_id").alias("first_id"), F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("at"))
    first = F.get("at", F.lit(0))
    stays = F.col("first_id").isNull() | F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False))
    later = F.transform(F.filter("at", lambda r: r["stop"] > first["stop"]), lambda r: F.sequence(F.greatest(r["start"], first["stop"] + 1), r["stop"]))
    every = F.transform("at", lambda r: F.sequence(r["start"], r["stop"]))
    gone = places.select("doc_id", "text_key", F.array_distinct(F.flatten(F.when(stays, later).otherwise(every))).alias("lines")).where(F.size("lines") > 0)
    return gone.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone_lines"))


def _chunks(docs: DataFrame, text: str) -> DataFrame:
    """One row per removable chunk, with its place and its text."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(chunk_lines(F.col(text))).alias("pos", "chunk"))
    body = F.array_join("chunk.lines", "\n")
    kept = rows.where((F.size("chunk.lines") > 1) | F.col("chunk.long")).select("doc_id", "text_key", "pos", body.alias("body"))
    return kept.where(F.col("body").rlike(r"[^\x20\x09-\x0D]"))


_KEY = ("h1", "h2", "len")


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({
        "h1": F.xxhash64("body"), "len": F.length("body"),
        "h2": F.conv(F.substring(F.md5("body"), 1, 15), 16, 10).cast("long"),
    })


def _repeated(places: DataFrame) -> DataFrame:
    groups = places.groupBy("body").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    keyed = _keyed(groups.where("n > 1")).groupBy(*_KEY).agg(F.count("*").alias("texts"), F.min("first_id").alias("first_id"))
    return written(keyed.where("texts = 1").drop("texts"))


def repeated_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunk texts found at two places or more: their key, and the smallest doc_id that has one."""
    return _repeated(_chunks(docs, text))


def removals(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, hash of the text, and the positions, in order, of its chunks to remove."""
    repeated = repeated_chunks(docs, text)
    places = _keyed(_chunks(docs, text)).drop("body")
    # A document's places of one chunk meet before the join: only its first can stay.
    found = places.join(repeated, list(_KEY)).groupBy("doc_id", "text_key", *_KEY).agg(
        F.min("first_id").alias("first_id"), F.sort_array(F.collect_set("pos")).alias("at")
    )
    stays = F.col("first_id").isNull() | F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False))
    gone = found.select("doc_id", "text_key", F.when(stays, F.slice("at", 2, F.size("at"))).otherwise(F.col("at")).alias("at")).where(F.size("at") > 0)
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))


def without_repeats(docs: DataFrame, text: str = "text", runs: bool = False) -> DataFrame:
    """``row`` (the input row), clean_text, n_lines, n_chunks and what was removed, for every document."""
    texts = docs.select("doc_id", text)
    gone = removals(texts, text).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "at", F.lit(None).cast("array<int>").alias("gone_lines"))
    if runs:
        more = run_removals(texts, text).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), F.lit(None).cast("array<int>").alias("at"), "gone_lines")
        gone = gone.unionByName(more).groupBy("gone_id", "gone_key").agg(F.first("at", True).alias("at"), F.first("gone_lines", True).alias("gone_lines"))
    frame = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("body"))
    joined = frame.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")

    def result(chunks: Column, at: Column) -> Column:
        size = lambda c: F.size(c["lines"])
        under = F.flatten(F.transform(F.filter(chunks, lambda x, i: F.array_contains(at, i)), lambda c: F.sequence(c["start"], c["start"] + size(c) - 1)))
        return let(F.flatten(F.transform(chunks, lambda x: x["lines"])), lambda lines: let(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.concat(under, F.coalesce("gone_lines", F.array().cast("array<int>")))),
            lambda left: F.struct(
                F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("clean_text"),
                F.size(lines).cast("long").alias("n_lines"), F.size(chunks).cast("long").alias("n_chunks"),
                F.size(at).cast("long").alias("n_removed_chunks"), (F.size(lines) - F.size(left)).cast("long").alias("n_removed_lines"),
            ),
        ))

    cleaned = joined.withColumn("r", let(
        chunk_lines(F.coalesce("body", F.lit(""))),
        lambda chunks: let(F.coalesce("at", F.array().cast("array<int>")), lambda at: result(chunks, at)),
    ))
    count = lambda name: F.when(F.col("body").isNull(), F.lit(0).cast("long")).otherwise(F.col(f"r.{name}")).alias(name)
    return cleaned.select(
        "row", F.when(F.col("body").isNull(), F.lit(None)).otherwise(F.col("r.clean_text")).alias("clean_text"),
        *map(count, ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")),
    )


def deduplicated(docs: DataFrame, runs: bool = False) -> DataFrame:
    """The documents with repeated chunks removed from their text; those left without a line go."""
    found = without_repeats(docs, runs=runs).where((F.col("n_removed_lines") == 0) | (F.col("n_removed_lines") < F.col("n_lines")))
    columns = [F.col("clean_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns)


def line_report(docs: DataFrame, runs: bool = False) -> DataFrame:
    """doc_id, counts, and the whole text that remains, of every document."""
    return without_repeats(docs.select("doc_id", "text"), runs=runs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.col("clean_text").alias("text")
    )
