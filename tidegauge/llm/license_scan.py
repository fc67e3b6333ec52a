"""Licence scan with ordered signature rules, with DataFrame functions only.

Texts without any word that some rule needs are done after one search. The others are brought to
lower-cased words joined by one space; a rule's pattern runs only where its gate keyword stands. A
detection is suppressed when its words lie within those of a detection of higher priority, or of equal
priority with more words, or of the same words by an earlier rule. Base phrases are found by words and
always stay.

Defined results: null and empty texts have no words and no detection; repeated rows get equal rows;
columns of the input stay in one struct ``row``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.license_rules import first_words, rules
from tidegauge.llm.shared import let

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = 4
#: Detections that one step of the sweep takes.
BLOCK = 256
#: Label, words.
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
_EMPTY = "array<struct<first: int, last: int, priority: int, rule: int, label: string, score: double>>"


def _gates() -> dict[str, list[tuple[int, str, str, int, float]]]:
    gates: dict[str, list] = {}
    for number, (label, gate, pattern, priority, score) in enumerate(rules()):
        gates.setdefault(gate, []).append((number, label, pattern, priority, score))
    return gates


def _worth_scanning(text: Column) -> Column:
    """Whether any word stands in the text without which no rule and no base phrase matches."""
    return let(F.lower(text), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(word)) for word in first_words()]))


def _rule_table() -> Column:
    """Gates with their rules as one literal array."""
    def one(number, label, pattern, priority, score):
        whole = f"(?<= )(?:{pattern})(?= )"
        return F.struct(
            F.lit(number).alias("rule"), F.lit(label).alias("label"), F.lit(whole).alias("find"), F.lit(f"(?<= )({pattern})(?= )").alias("mark"),
            F.lit(priority).alias("priority"), F.lit(score).alias("score"),
        )

    return F.array(*[F.struct(F.lit(f" {gate}").alias("gate"), F.array(*[one(*r) for r in found]).alias("rules")) for gate, found in _gates().items()])


def _places(text: Column, rule: Column) -> Column:
    """Intervals of words, from 0, that a rule's pattern matches."""

    def found(words: Column) -> Column:
        at = lambda mark, ends: F.filter(F.transform(words, lambda w, i: F.when(ends(w, F.lit(mark)), i)), lambda i: i.isNotNull())
        pairs = F.arrays_zip(at("\u0001", F.startswith).alias("first"), at("\u0002", F.endswith).alias("last"))
        return F.transform(pairs, lambda p: F.struct(
            p["first"].alias("first"), p["last"].alias("last"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["score"].alias("score"),
        ))

    return let(F.split(F.trim(F.regexp_replace(text, rule["mark"], F.lit("\u0001$1\u0002"))), " "), found)


def _detections(text: Column, table: Column) -> Column:
    """All detections in a text of spaced words."""
    gated = F.flatten(F.transform(F.filter(table, lambda g: F.contains(text, g["gate"])), lambda g: g["rules"]))
    return F.flatten(F.transform(F.filter(gated, lambda r: F.regexp_like(text, r["find"])), lambda r: _places(text, r)))


def _unsuppressed(found: Column) -> Column:
    """Detections that no better one contains, in one sweep by first word and length."""
    ordered = F.transform(
        F.sort_array(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("neg"), d["priority"].alias("priority"), d["rule"].alias("rule"), d.alias("d")))),
        lambda x: x["d"],
    )
    none = [F.lit(-1).alias(f"e{p}") for p in range(LEVELS)]
    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def step(state: Column, d: Column) -> Column:
        inside = reduce(lambda a, b: a | b, [(F.lit(p) <= d["priority"]) & (state[f"e{p}"] >= d["last"]) for p in range(LEVELS)])
        ends = [F.when(d["priority"] == p, F.greatest(state[f"e{p}"], d["last"])).otherwise(state[f"e{p}"]).alias(f"e{p}") for p in range(LEVELS)]
        return F.struct(*ends, F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    def block(state: Column, part: Column) -> Column:
        """Sweep one block; what it keeps is appended once, so long lists are not copied for each detection."""
        begin = F.struct(*[state[f"e{p}"].alias(f"e{p}") for p in range(LEVELS)], F.array().cast(_EMPTY).alias("kept"))
        return let(F.aggregate(part, begin, step), lambda x: F.struct(*[x[f"e{p}"].alias(f"e{p}") for p in range(LEVELS)], F.concat(state["all"], F.array(x["kept"])).alias("all")))

    start = F.struct(*none, F.array().cast(f"array<{_EMPTY}>").alias("all"))
    return F.when(F.size(found) > 0, let(ordered, lambda all_: F.aggregate(blocks(all_), start, block, lambda s: F.flatten(s["all"])))).otherwise(F.array().cast(_EMPTY))


def _base_places(words: Column) -> Column:
    """Starts and labels of the base phrases."""
    ends = F.filter(F.transform(words, lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())

    def phrase(i: Column) -> Column:
        hit = F.lit(None).cast("struct<first: int, label: string>")
        for label, parts in BASE:
            same = reduce(lambda a, b: a & b, [F.get(words, i - (len(parts) - 1 - k)) == part for k, part in enumerate(parts[:-1])])
            hit = F.when(F.coalesce(same, F.lit(False)), F.struct((i - (len(parts) - 1)).alias("first"), F.lit(label).alias("label"))).otherwise(hit)
        return hit

    return F.filter(F.transform(ends, phrase), lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input row), n_words, base phrases and the detections left, for every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    frame = docs.select(F.struct("*").alias("row"), body.alias("body"))
    scanned = let(F.filter(F.split(F.translate("body", _UPPER, _LOWER), _GAP), lambda x: x != ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _base_places(w).alias("base"),
        let(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), lambda t: let(_rule_table(), lambda table: _unsuppressed(_detections(t, table)))).alias("detections"),
    ))
    plain = F.struct(
        F.size(F.filter(F.split("body", _GAP), lambda x: x != "")).cast("long").alias("n_words"),
        F.array().cast("array<struct<first: int, label: string>>").alias("base"), F.array().cast(_EMPTY).alias("detections"),
    )
    return frame.select("row", F.when(_worth_scanning(F.col("body")), scanned).otherwise(plain).alias("s")).select("row", "s.*")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, words, base places and labels, all labels, and the best score of every document."""
    found = scan_licenses(docs.select("doc_id", "text"))
    starts = F.transform("base", lambda b: b["first"])
    base = F.transform("base", lambda b: b["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    scores = F.concat(F.transform("detections", lambda d: d["score"]), F.transform("base", lambda b: F.lit(0.8).cast("double")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )
