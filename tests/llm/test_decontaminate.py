"""Decontamination against a plain scan of every window."""

import hashlib
import re

import pytest

from tidegauge.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, hits string, row int"
BENCH = "item_id long, text string, n int"

ITEM = "the quick brown fox jumps over the lazy dog while eleven owls watch"
ROWS = [
    (1, f"Intro. {ITEM.upper()}! End", "x", 1),
    (2, None, None, None),
    (3, "", "x", 2),
    (4, "nothing to see here", "x", 3),
    (5, " ".join(ITEM.split()[2:12]), "x", 4),
    (6, " ".join(ITEM.split()[2:11]), "x", 5),
    (7, "pre short item! post", "x", 6),
    (7, "pre short item! post", "x", 6),
    (8, "été À Ünïcode " + "filler " * 60000 + ITEM, "x", 7),
    (9, "short\nshort ITEM item", "x", 8),
]
ITEMS = [(10, ITEM, 1), (2, "Short item", 1), (3, None, 1), (4, "  ", 1), (10, ITEM, 1), (11, "owls watch", 2), (None, "see here", 1)]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text):
    windows = {}
    for item, body, _ in ITEMS:
        w = words(body)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).update({str(item)} - {"None"})
    w, hit, items = words(text), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                items |= windows[tuple(w[k : k + n])]
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(w), len(hit), len(items), digest, bool(hit)


@pytest.mark.parametrize("limit", [op.MAX_SET_BYTES, 1200])
def test_report_equals_brute_force(spark, limit):
    docs, bench = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    got = op.contamination_report(docs, bench, max_set_bytes=limit).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *expected(text)) for i, text, *_ in ROWS)


def test_clean_documents_keep_their_columns(spark):
    docs, bench = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    kept = op.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, text, *_ in ROWS if not expected(text)[-1])


def test_spans_are_cut(spark):
    docs, bench = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    cut = {r.row.doc_id: r.clean_text for r in op.without_spans(op.find_contamination(docs, bench)).collect()}
    assert cut[1] == "Intro. ! End" and cut[7] == "pre ! post" and cut[2] is None and cut[6] == ROWS[5][1]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    assert op.contamination_report(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in op.contamination_report(docs, bench.limit(0)).collect())


def test_a_window_of_very_many_items_is_spread_over_blocks(spark):
    items = [(i, ITEM, 1) for i in range(300)]
    docs = spark.createDataFrame([(1, ITEM, "x", 1), (2, "none of it", "x", 1)], DOCS)
    bench = spark.createDataFrame(items, BENCH)
    plain = sorted(map(tuple, op.contamination_report(docs, bench).collect()))
    assert plain[0][3] == 300
    split = op.contamination_report(docs, bench, max_set_bytes=40_000)
    assert sorted(map(tuple, split.collect())) == plain


def test_windows_travel_without_the_package():
    import pickle
    import subprocess
    import sys

    held = pickle.dumps(op.window_table([(b"one two", 2, "7"), (b"one two", 2, "3")]))
    code = "import pickle, sys; t = pickle.loads(sys.stdin.buffer.read()); assert t[2][2] == [('3', '7')]; assert 'tidegauge' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=held, cwd="/", check=True)
