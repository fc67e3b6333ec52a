"""A corpus from raw documents to token ids: five stages, each one operator of the text subpackage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as
Parquet and read again. All but the last return the columns of ``documents``.
"""

from pyspark.sql import functions as F

from tidegauge.llm import bpe_merge, decontaminate, line_chunks, minhash, quality_rules
from tidegauge.llm.shared import documents, written


def good_documents(spark, docs, sf_dir):
    """Documents that fail no base rule and whose host is not rejected."""
    return quality_rules.passing_documents(docs)


def unrepeated_lines(spark, docs, sf_dir):
    """Texts without chunks of lines that stand elsewhere; a document left without a line goes."""
    return line_chunks.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return minhash.one_of_each_group(docs)


def uncontaminated(spark, docs, sf_dir):
    """Documents without any benchmark passage."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark, docs, sf_dir):
    """Token ids of each document."""
    encoded = bpe_merge.encode_documents(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", uncontaminated),
    ("bpe_encoding", token_ids),
]

#: The line chunks' hashes, the merges and the groups are tested against plain versions instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
