"""Base phrases against a plain scan; signatures, priority and containment on worked cases."""

import random
import re
from re import _parser

import pytest
from corpora import SCHEMA, corpus, lower_ascii

from tidegauge.llm import license_rules
from tidegauge.llm import license_scan as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CASES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0,apache", 1),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", 1),
    ("Licensed under CC BY-NC 4.0. All rights reserved", "cc-by-nc,proprietary", 0),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0", 0),
    ("mit  License; MIT\nLICENSE the Mit license", "mit", 3),
    ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1", 1),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", 0),
    ("the summit license was limited; mit lizenz", "", 0),
    ("Provided under a Business Source license; released into the public domain", "busl,public-domain", 0),
    (None, "", 0),
    ("", "", 0),
]


def base(text):
    words = WORD.findall(lower_ascii(text))
    hits = []
    for label, phrase in op.BASE:
        hits += [(k, label) for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase]
    starts = [k for k, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_worked_cases_and_base_phrases(spark):
    rows = [(i, t, "", "", 0) for i, (t, *_) in enumerate(CASES)] + [(100 + r[0], r[1], *r[2:]) for r in corpus(7)]
    rows += [(900, "été mit license " * 3000 + "ü", "", "", 0), (None, "Apache license", "", "", 0), (901, "under " * 400, "", "", 0)]
    got = {r.doc_id: r for r in op.license_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        assert tuple(got[i])[1:6] == base(text), text
    for i, (_, labels, n) in enumerate(CASES):
        assert (set(got[i].labels.split(",")), got[i].n_base) == (set(labels.split(",")), n)
        assert (got[i].score > 0) == bool(labels)
    assert got[3].score == 1.0


def test_contained_detections_are_suppressed(spark):
    rows = [(1, "It is licensed under the Apache License, Version 2.0 here", "", "", 0)]
    found = op.scan_licenses(spark.createDataFrame(rows, SCHEMA)).first().detections
    assert [(d.label, d.first, d.last) for d in found] == [("apache-2.0", 2, 9)]


def test_rules_are_ordered_and_gated():
    rules = license_rules.rules()
    assert len(rules) > 300 and {r[3] for r in rules} == set(range(op.LEVELS))
    for label, gate, pattern, *_ in rules:
        assert re.compile(pattern) and label
    for label, gate, name, identifier in license_rules.LICENSES:
        plain = re.sub(r"\(\?:[^()]*\)\?|\?", "", name)
        assert any(w in f"licensed under the {name} license" for w in license_rules.first_words()), plain


def test_empty_table(spark):
    assert op.license_report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("column", ["body", "gated", "w", "row"])
def test_clashing_names(spark, column):
    frame = spark.createDataFrame([(1, "mit license", "", "", 0)], SCHEMA).withColumnRenamed("lang", column)
    assert op.scan_licenses(frame).first().n_words == 2


@pytest.mark.parametrize(("text", "labels"), [
    ("reproduced without prior written permission", "proprietary"),
    ("copied without written permission", "proprietary"),
    ("unauthorised copying is prohibited", "proprietary"),
    ("Unauthorized use of this file, in whole or in part, and by any means whatsoever, is strictly prohibited", "proprietary"),
    ("for academic use only", "research-only"),
    ("trial version only", "trial"),
    ("Apache version 2.0", "apache-2.0"),
    ("GNU Library General Public License version 2", "gpl,lgpl-2.0"),
    ("Neither the name of " + "the University of a Very Long Place " * 5 + "nor the names of its contributors may be used", "bsd-3-clause"),
])
def test_texts_that_gates_or_short_gaps_hid(spark, text, labels):
    row = op.license_report(spark.createDataFrame([(1, text, "", "", 0)], SCHEMA)).first()
    assert row.labels == labels


def examples(pattern):
    """Texts that a pattern matches, in which each of its choices is made once at least."""

    def every(parts):
        choices = [part(*p) for p in parts]
        first = [c[0] for c in choices]
        return list(dict.fromkeys("".join([*first[:k], c, *first[k + 1 :]]) for k, found in enumerate(choices) for c in found)) or [""]

    def part(kind, value):
        name = str(kind)
        if name == "LITERAL":
            return [chr(value)]
        if name == "NOT_LITERAL":
            return ["x"]
        if name == "BRANCH":
            return [x for parts in value[1] for x in every(parts)]
        if name == "SUBPATTERN":
            return every(value[-1])
        if name == "IN":
            return [chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
        if name == "ASSERT":
            return [""]
        low, high, inner = value
        found = every(inner)
        return [*(["".join([found[0]] * low)] if low != 1 else []), *(x * max(low, 1) for x in found), found[0] * min(int(high), 50)]

    found = every(_parser.parse(pattern))
    # What a condition asks for is not drawn, so texts that fail one are left out.
    return [x for x in found if spaced_match(pattern, x)] if "(?=" in pattern else found


def spaced_match(pattern, text):
    hit = re.search(f"(?<= )(?:{pattern})(?= )", f" {text} ")
    return hit and hit[0] == text


def test_every_alternative_passes_its_gates(spark):
    rules = license_rules.rules()
    rows = [(n, text) for n, rule in enumerate(rules) for text in examples(rule[2])]
    assert all(spaced_match(rules[n][2], text) for n, text in rows) and len(rows) > 2500
    hidden = [(n, text) for n, text in rows if f" {rules[n][1]}" not in f" {text} " or not any(w in text for w in license_rules.first_words())]
    assert hidden == []
    few = [r for k, r in enumerate(rows) if r[0] >= len(rules) - len(license_rules.PHRASES) or k % 20 == 0]
    frame = spark.createDataFrame([(k, text, "", "", 0) for k, (_, text) in enumerate(few)], SCHEMA).repartition(8)
    missed = [few[r.row.doc_id] for r in op.scan_licenses(frame).select("row", "detections").collect() if not r.detections]
    assert missed == []


def plain_scan(text):
    """All detections by each pattern over the whole text, and of these the ones that no better one contains, by all pairs."""
    words = WORD.findall(lower_ascii(text))
    spaced = " " + " ".join(words) + " "
    found = []
    for number, (label, _, pattern, priority, score) in enumerate(license_rules.rules()):
        for hit in re.finditer(f"(?<= )(?:{pattern})(?= )", spaced):
            first = spaced.count(" ", 0, hit.start()) - 1
            found.append((first, first + hit[0].count(" "), priority, number, label, score))

    def better(a, b):
        """Whether ``a`` suppresses ``b``."""
        if a is b or not (a[0] <= b[0] and b[1] <= a[1]):
            return False
        longer = (a[0], a[1]) != (b[0], b[1])
        return a[2] < b[2] or a[2] == b[2] and (longer or a[3] < b[3])

    return sorted(x for x in found if not any(better(y, x) for y in found))


def test_scan_equals_all_patterns_and_all_pairs(spark):
    rng = random.Random(8)
    rules = license_rules.rules()
    pieces = [x for rule in rules for x in examples(rule[2])[:2]]
    texts = [t for _, t, *_ in corpus(9)[:40]]
    for _ in range(150):
        some = [rng.choice(pieces) if rng.random() < 0.6 else rng.choice(("foo", "the", "license", "MIT", "under", "copyright 1999", "gnu", "2.0", "é")) for _ in range(rng.randint(1, 30))]
        texts.append(rng.choice((" ", "\n", "-")).join(some))
    texts += [" ".join(rng.choices(pieces, k=700))]
    frame = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(8)
    for r in op.scan_licenses(frame).select("row.doc_id", "detections").collect():
        assert sorted(tuple(d[c] for c in ("first", "last", "priority", "rule", "label", "score")) for d in r.detections) == plain_scan(texts[r.doc_id]), texts[r.doc_id]


def test_very_long_repetitions_end(spark):
    """A million years, words without an end between two parts of a rule, and a hundred thousand detections."""
    texts = [
        "copyright" + " 2001" * 1_000_000 + " by", "unauthorized use " + "and " * 300_000 + "is prohibited",
        "neither the name of " + "x" * 3_000_000 + " nor the names of its contributors may be used", "all rights reserved x " * 100_000,
        "copyright 1999 2000 20011 x", "mit license " * 50_000, "licensed under the " * 100_000, "under " + "a" * 2_000_000,
    ]
    got = {r.doc_id: r for r in op.license_report(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(8)).collect()}
    assert [got[i].labels for i in range(len(texts))] == ["copyright", "", "bsd-3-clause", "proprietary", "copyright", "mit", "", ""]
    assert got[0].n_words == 1_000_002 and got[5].n_base == 50_000
