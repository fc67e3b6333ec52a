"""The pipeline on a small corpus, stage by stage against plain versions; the guard of the entry."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
import test_line_chunks
import test_minhash
import test_quality_rules
from corpora import SCHEMA, corpus, lower_ascii
from test_decontaminate import WORD
from tokenizers import Tokenizer

REPO = Path(__file__).parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, " ".join([t] * 3) if t and 20 < len(t) < 300 else t, *r) for i, t, *r in corpus(12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    source = max((r for r in rows if r[1]), key=lambda r: len(r[1]))[1]
    items = [(1, " ".join(source.split()[40:60])), (2, "never seen in any text of these documents at all surely"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def windows(text):
    words = WORD.findall(lower_ascii(text))
    n = min(10, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def test_stages_equal_plain_versions(spark, folder):
    path, rows, items = folder
    judged, _ = test_quality_rules.expected(rows)
    passed = {r[0] for r in judged if r[-1]}
    rows = [r for r in rows if r[0] in passed]
    lines = test_line_chunks.expected(rows)
    rows = [(r[0], lines[r[0]][4], *r[2:4], len(lines[r[0]][4])) for r in rows if lines[r[0]][3] == 0 or lines[r[0]][3] < lines[r[0]][0]]
    single = {i for i, _, _, kept in test_minhash.groups(rows) if kept}
    rows = [r for r in rows if r[0] in single]
    bench = set().union(*(windows(t) for _, t in items))
    clean = [r for r in rows if not any(w in bench for w in windows(r[1]))]
    assert len(clean) < len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r[0], library.encode(r[1], add_special_tokens=False).ids) for r in clean)
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert [f.name for f in stage(spark, docs, path).schema] == docs.columns


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tidegauge"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tidegauge" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) > 200 and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_empty_tables_give_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_and_clashing_names_pass_through(spark, tmp_path):
    """Rows of one id are judged by their own text, a repeated row stays once, and columns with internal names change nothing."""
    words = [" ".join(f"word{k * 7919 % 997 + 1000 * j}" for k in range(80)) for j in range(3)]
    rows = [(1, words[0], "en", "a", 1), (1, words[1], "en", "a", 1), (2, words[2], "en", "a", 1), (2, words[2], "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "quality", "node", "text_key", "hits", "ids"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "nothing of this stands there at all in any of the documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2] and all(r.n_tokens == len(r.ids) > 0 for r in got)
