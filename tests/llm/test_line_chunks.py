"""Line chunks against a plain version."""

import hashlib
from collections import Counter

from corpora import SCHEMA, corpus, sentence, spaced

from tidegauge.llm import line_chunks as op


def cut(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    rolls = [((hashes[i - 1] if i else 0) * 31 + h) % 2147483629 for i, h in enumerate(hashes)]
    long = [len(spaced(x)) >= 50 for x in lines]
    chunks, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        low = 0 < i < len(lines) - 1 and rolls[i] < rolls[i - 1] and rolls[i] < rolls[i + 1]
        if i == len(lines) - 1 or long[i] or long[i + 1] or low:
            body = "\n".join(now)
            chunks.append((body, len(now), (len(now) > 1 or long[i]) and bool(spaced(body))))
            now = []
    return chunks


def expected(rows):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        if text is None:
            out[i] = (0, 0, 0, 0, None)
            continue
        chunks, kept = cut(text), []
        for body, n, fit in chunks:
            if fit and body in seen:
                continue
            if fit:
                seen.add(body)
            kept.append((body, n))
        lines, left = sum(n for _, n, _ in chunks), sum(n for _, n in kept)
        out[i] = (lines, len(chunks), len(chunks) - len(kept), lines - left, "\n".join(b for b, _ in kept))
    return out


def test_report_equals_plain_version(spark):
    rows = corpus(4)
    got = {r[0]: tuple(r[1:]) for r in op.line_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected(rows)
    assert sum(r[3] for r in got.values()) > 100


def test_boundaries_move_only_beside_an_insertion():
    import random

    rng = random.Random(8)
    lines = [sentence(rng, 8) for _ in range(60)]
    before = {b for b, *_ in cut("\n".join(lines))}
    after = Counter(b for b, *_ in cut("\n".join([*lines[:30], "inserted", *lines[30:]])))
    assert len(before - set(after)) <= 2


def test_deduplicated_keeps_columns_and_drops_emptied_documents(spark):
    rows = [(1, "a b\nc d", "x", "s", 7), (2, "a b\nc d", "y", "s", 7), (3, None, None, None, None), (4, "", "z", "s", 0), (None, "a b\nc d", "n", "s", 7), (1, "a b\nc d", "again", "s", 7)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "chunk").withColumnRenamed("n_chars", "at")
    out = op.deduplicated(frame)
    assert out.columns == frame.columns
    assert sorted((str(r.doc_id), r.text, str(r.chunk)) for r in out.collect()) == [("1", "a b\nc d", "again"), ("1", "a b\nc d", "x"), ("3", None, "None"), ("4", "", "z")]


def test_rows_without_an_id_lose_only_their_own_chunks(spark):
    rows = [(1, "a b\nc d", "", "", 0), (None, "a b\nc d", "", "", 0), (None, "e f\ng h", "", "", 0), (1, "i j\nk l", "", "", 0)]
    out = op.line_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("1", "a b\nc d"), ("1", "i j\nk l"), ("None", ""), ("None", "e f\ng h")]


def test_empty_table_and_only_null_ids(spark):
    frame = spark.createDataFrame([(None, "a b\nc d", "n", "s", 7), (None, "a b\nc d\nnew", "n", "s", 7)], SCHEMA)
    assert all(r.n_removed_lines == 0 for r in op.line_report(frame).collect())
    assert op.line_report(frame.limit(0)).count() == 0


def with_runs(rows):
    """Removal by chunks and by shortest runs of 50 words, plainly."""
    by_chunk, places = expected(rows), {}
    for i, text, *_ in sorted(r for r in rows if r[1] is not None):
        lines = text.split("\n")
        n = [len(spaced(x)) for x in lines]
        spans = set()
        for a in range(len(lines)):
            ends = [b for b in range(a, len(lines)) if n[a] and sum(n[a : b + 1]) >= 50]
            starts = [b for b in range(a + 1) if n[a] and sum(n[b : a + 1]) >= 50]
            spans |= {(a, ends[0])} if ends else set()
            spans |= {(starts[-1], a)} if starts else set()
        for a, b in sorted(spans):
            places.setdefault("\n".join(lines[a : b + 1]), []).append((i, a, b))
    gone = {}
    for (home, _, end), *again in places.values():
        for i, a, b in again:
            gone.setdefault(i, set()).update(range(max(a, end + 1) if i == home else a, b + 1))
    out = {}
    for i, text, *_ in rows:
        if text is None:
            out[i] = (0, 0, 0, 0, None)
            continue
        seen_before = {b for j, other, *_ in sorted(r for r in rows if r[1] is not None) if j < i for b, _, fit in cut(other) if fit}
        k, left = 0, []
        for body, size, fit in cut(text):
            if not (fit and body in seen_before):
                left += [(k + j, line) for j, line in enumerate(body.split("\n"))]
            if fit:
                seen_before.add(body)
            k += size
        left = [line for j, line in left if j not in gone.get(i, ())]
        out[i] = (*by_chunk[i][:3], k - len(left), "\n".join(left))
    return out


def test_runs_equal_plain_version(spark):
    rows = corpus(4)
    got = {r[0]: tuple(r[1:]) for r in op.line_report(spark.createDataFrame(rows, SCHEMA), runs=True).collect()}
    assert got == with_runs(rows)
    assert sum(r[3] for r in got.values()) > sum(r[3] for r in expected(rows).values())


def test_passages_of_short_lines_stay_once(spark):
    import random

    rng, rows, passages = random.Random(3), [], []
    for n, words in [(2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (8, 12), (12, 12)] * 3:
        passages.append([sentence(rng, words) for _ in range(n)])
        passages[-1][-1:] += ["", sentence(rng, 3)]
        for _ in range(3):
            rows.append((len(rows), "\n".join([*(sentence(rng, 9) for _ in range(6)), *passages[-1], *(sentence(rng, 9) for _ in range(6))]), "", "", 0))
    got = {r.doc_id: r for r in op.line_report(spark.createDataFrame(rows, SCHEMA), runs=True).collect()}
    for k, lines in enumerate(passages):
        assert "\n".join(lines) in got[3 * k].text
        for copy in (1, 2):
            assert got[3 * k + copy].n_lines - got[3 * k + copy].n_removed_lines == 12, (k, lines)


def test_a_run_that_overlaps_itself_keeps_its_first_place(spark):
    periodic = "\n".join(["ta ro ne li su mek an ta ro ne", "one two three four five six seven eight nine ten"] * 6)
    gone = op.run_removals(spark.createDataFrame([(1, periodic, "", "", 0)], SCHEMA).select("doc_id", "text")).first()
    assert sorted(gone.gone_lines) == list(range(5, 12))


def test_runs_of_rows_without_an_id(spark):
    lines = "\n".join(["w " * 20 + str(k) for k in range(3)])
    frame = spark.createDataFrame([(None, lines + "\nx", "", "", 0), (None, lines + "\ny", "", "", 0)], SCHEMA)
    assert all(r.n_removed_lines == 0 for r in op.line_report(frame, runs=True).collect())
    more = frame.unionByName(spark.createDataFrame([(5, lines + "\nz", "", "", 0)], SCHEMA))
    assert sorted(r.text for r in op.line_report(more, runs=True).collect()) == sorted(["x", "y", lines + "\nz"])
    assert op.line_report(frame.limit(0), runs=True).count() == 0
