"""Quality rules by document and by host, with DataFrame functions only.

Each document gets counts and rule failures. Failures are summed by host; for each rule the hosts'
rates give a beta prior by the method of moments, and each host's rate is shrunk towards it:
``(failures + a) / (documents + a + b)``. A host whose shrunk rate of any rule is over ``host_limit``
is rejected, and its verdict is joined back to its documents.

Defined results: null and empty texts have no words, so they fail the word rule; a null host is no
host, and its documents are judged alone; repeated rows count each; hosts of an empty table have no
verdict. Windows of three words are compared by 64-bit hash. Other columns are not read, and the
filter keeps the input's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import let, written

MIN_WORDS = 50
HOST_LIMIT = 0.5
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda x: x != "")


def repeated_window_words(words: Column, n: int = 3) -> Column:
    """Words that lie in a window of ``n`` words found twice or more."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(n), F.get(places, i + 1) - p), F.lit(n)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def places_in(runs: Column) -> Column:
        again = F.filter(runs, lambda x, i: (x["h"] == F.get(runs, i - 1)["h"]) | (x["h"] == F.get(runs, i + 1)["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["p"])), covered)

    def runs_of(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        hashed = F.transform(heads, lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, n)]).alias("h"), i.alias("p")))
        return let(F.sort_array(hashed), places_in)

    return let(words, runs_of)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with one struct column ``quality`` of counts and rule failures."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        let(word_list(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).cast("long").alias("again"))).alias("w"),
        F.length(F.regexp_replace(body, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("l"),
    )

    def judged(c: Column) -> Column:
        return F.struct(
            c["w"]["n"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["l"]["again"].alias("n_dup_lines"), c["w"]["again"].alias("n_repeat_words"),
            (c["w"]["n"] < MIN_WORDS).alias("few_words"),
            (100 * c["w"]["again"] > 50 * c["w"]["n"]).alias("repeats"),
            (10 * c["n_symbols"] > c["w"]["n"]).alias("symbols"),
            (10 * c["l"]["again"] > 3 * c["l"]["n"]).alias("dup_lines"),
        )

    return docs.withColumn("quality", let(counts, judged))


RULES = ("few_words", "repeats", "symbols", "dup_lines")


def rejected_hosts(counted: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts over the limit, with documents and shrunk rates; ``counted`` has the ``quality`` struct."""
    hosts = counted.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"quality.{r}").cast("long")).alias(r) for r in RULES]
    )
    moments = hosts.agg(*[x for r in RULES for x in (F.avg(F.col(r) / F.col("n")).alias(f"m_{r}"), F.coalesce(F.var_pop(F.col(r) / F.col("n")), F.lit(0.0)).alias(f"v_{r}"))])

    def shrunk(rule: str) -> Column:
        mean, spread = F.col(f"m_{rule}"), F.greatest(F.col(f"v_{rule}"), F.lit(1e-6))
        weight = F.greatest(mean * (1 - mean) / spread - 1, F.lit(1e-3))
        return (F.col(rule) + mean * weight) / (F.col("n") + weight)

    # One row of moments meets every host.
    rated = hosts.crossJoin(F.broadcast(moments)).select("host", "n", *[shrunk(r).alias(r) for r in RULES])
    return rated.where(F.greatest(*RULES) > host_limit)


def base_failed(quality: str = "quality") -> Column:
    return F.col(f"{quality}.few_words") | F.col(f"{quality}.repeats")


def judge_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = written(with_counts(docs.select("doc_id", "source", "text")).select("doc_id", "source", "quality"))
    bad = written(rejected_hosts(counted, "source", host_limit).select(F.col("host").alias("source"), F.lit(True).alias("rejected")))
    return counted.join(bad, "source", "left").select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.col("rejected").isNull()).alias("kept"),
    )


def passing_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass their own rules and whose host is not rejected, with their own columns.

    Texts are counted once; they are written with their counts, as hosts are judged before documents go.
    """
    counted = written(with_counts(docs.select(F.struct("*").alias("row"), "source", "text")).select("row", "source", "quality"))
    bad = written(rejected_hosts(counted, "source", host_limit).select(F.col("host").alias("bad_host")))
    kept = counted.where(~base_failed()).join(bad, F.col("source") == F.col("bad_host"), "left_anti")
    return kept.select("row.*")
