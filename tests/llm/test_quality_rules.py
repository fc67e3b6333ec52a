"""Counts, base rules and host verdicts against a plain version."""

from collections import Counter, defaultdict

from corpora import SCHEMA, corpus, spaced

from tidegauge.llm import quality_rules as op


def counts(text):
    text = text or ""
    words = spaced(text)
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times, covered = Counter(runs), set()
    for k, run in enumerate(runs):
        if times[run] > 1:
            covered.update((k, k + 1, k + 2))
    lines = [x for x in text.split("\n") if spaced(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def failures(c):
    return c[0] < 50, 100 * c[4] > 50 * c[0], 10 * c[2] > c[0], 10 * c[3] > 3 * c[5]


def expected(rows):
    hosts = defaultdict(list)
    found = [(r, counts(r[1])) for r in rows]
    for r, c in found:
        if r[3] is not None:
            hosts[r[3]].append(failures(c))
    bad = set()
    for rule in range(4):
        rates = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        spread = max(sum((x - mean) ** 2 for x in rates.values()) / len(rates), 1e-6)
        weight = max(mean * (1 - mean) / spread - 1, 1e-3)
        bad |= {h for h, fs in hosts.items() if (rates[h] * len(fs) + mean * weight) / (len(fs) + weight) > 0.5}
    out = []
    for r, c in found:
        base = any(failures(c)[:2])
        out.append((r[0], *c[:5], base, not base and r[3] not in bad))
    return sorted(out, key=str), bad


def test_report_equals_plain_version(spark):
    rows = corpus(6)
    junk = [(1000 + i, ("junk *** " * (40 + i)) + "".join(f" w{j}" for j in range(200)), "en", "spam", 0) for i in range(20)]
    rows += [*junk, (2000, "".join(f" w{j}" for j in range(90)), "en", "spam", 0), (None, "x " * 3, None, None, None)]
    want, bad = expected(rows)
    got = sorted((tuple(r) for r in op.judge_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == want
    assert bad == {"spam"} and any(r[0] == 2000 and not r[-2] and not r[-1] for r in got)


def test_filter_keeps_columns(spark):
    rows = corpus(6)
    frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "quality").withColumnRenamed("n_chars", "rejected")
    out = op.passing_documents(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in expected(rows)[0] if r[-1])


def test_very_long_text_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c d " * 100000, "", "h", 0)], SCHEMA)
    assert op.judge_documents(frame).first()[1:6] == (400000, 400000, 0, 0, 400000)
    assert op.judge_documents(frame.limit(0)).count() == 0
