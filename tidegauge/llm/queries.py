"""One thin query per operator over the given tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from tidegauge.llm import (
    bpe_merge,
    decontaminate,
    fat_trie,
    hilbert_shards,
    hnsw,
    license_scan,
    line_chunks,
    merkle,
    minhash,
    piece_counts,
    quality_model,
    quality_rules,
    token_files,
)
from tidegauge.llm.shared import documents

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_ALNUM_WORDS = r"""
  regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
"""


@query(
    "op1_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {_ALNUM_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    b AS (SELECT item_id, {_ALNUM_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, w[k : k + least(10, len(w)) - 1] AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
    runs AS (
      SELECT doc_id, n, k, w[k : k + n - 1] AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
    hits AS (SELECT doc_id, n, k, item_id FROM runs JOIN windows USING (win)),
    covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op1_decontaminate(spark, folder):
    """Benchmark windows of ten words found in whole documents."""
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.contamination_report(documents(spark, folder), bench)


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark, folder):
    """Whole texts to ids and back."""
    return bpe_merge.round_trip_digests(documents(spark, folder))


@query("op10_token_counts")
def op10_token_counts(spark, folder):
    """Tokens of whole texts, counted without ids."""
    return piece_counts.count_tokens(documents(spark, folder))


@query("op2_token_files")
def op2_token_files(spark, folder):
    """Token files of whole texts, written in id order and read back."""
    return token_files.file_digests(documents(spark, folder))


@query("op3_hilbert_shards")
def op3_hilbert_shards(spark, folder):
    """Eight shards along a Hilbert curve over language, source, size and id."""
    return hilbert_shards.shard_documents(documents(spark, folder))


@query(
    "op5_line_chunks",
    r"""
    WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    each AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM lines),
    hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS long FROM each),
    rolled AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % 2147483629 AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    ended AS (
      SELECT *, lead(i) OVER w IS NULL OR long OR coalesce(lead(long) OVER w, false)
        OR coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, false) AS stop
      FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (
      SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM ended),
    chunks AS (
      SELECT doc_id, c, count(*) AS n, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS body
      FROM numbered GROUP BY doc_id, c),
    marked AS (SELECT *, (n > 1 OR long) AND regexp_matches(body, '[^\x20\x09-\x0D]') AS fit FROM chunks),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY body, fit ORDER BY doc_id, c) AS k FROM marked),
    result AS (SELECT *, fit AND k > 1 AS gone FROM ranked)
    SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines, CAST(count(c) AS BIGINT) AS n_chunks,
      CAST(coalesce(sum(CAST(gone AS INT)), 0) AS BIGINT) AS n_removed_chunks,
      CAST(coalesce(sum(CASE WHEN gone THEN n ELSE 0 END), 0) AS BIGINT) AS n_removed_lines,
      CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT gone), '') END AS text
    FROM documents d LEFT JOIN result USING (doc_id) GROUP BY d.doc_id
    """,
)
def op5_line_chunks(spark, folder):
    """Whole texts without chunks of lines that stand elsewhere."""
    return line_chunks.line_report(documents(spark, folder))


@query(
    "op5_line_passages",
    r"""
    WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    each AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM lines),
    hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, words >= 50 AS long FROM each),
    rolled AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % 2147483629 AS r, sum(words) OVER w AS hi FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    ended AS (
      SELECT *, lead(i) OVER w IS NULL OR long OR coalesce(lead(long) OVER w, false)
        OR coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, false) AS stop
      FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (
      SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM ended),
    chunks AS (
      SELECT doc_id, c, count(*) AS n, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS body
      FROM numbered GROUP BY doc_id, c),
    marked AS (SELECT *, (n > 1 OR long) AND regexp_matches(body, '[^\x20\x09-\x0D]') AS fit FROM chunks),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY body, fit ORDER BY doc_id, c) AS k FROM marked),
    worded AS (SELECT doc_id, i, hi - words AS lo, hi FROM rolled WHERE words > 0),
    spans AS (
      SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.hi >= a.lo + 50 GROUP BY a.doc_id, a.i
      UNION
      SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND a.lo <= b.hi - 50 GROUP BY b.doc_id, b.i),
    runs AS (SELECT doc_id, s, e, array_to_string(l[s:e], chr(10)) AS run FROM spans JOIN lines USING (doc_id)),
    placed AS (SELECT doc_id, s, e, first_value(doc_id) OVER w AS home, first_value(e) OVER w AS last FROM runs WINDOW w AS (PARTITION BY run ORDER BY doc_id, s)),
    under AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = home THEN greatest(s, last + 1) ELSE s END, e + 1)) AS i FROM placed),
    result AS (
      SELECT doc_id, c, i, line, fit AND k > 1 AS chunk_gone, (fit AND k > 1) OR under.i IS NOT NULL AS gone
      FROM numbered JOIN ranked USING (doc_id, c) LEFT JOIN under USING (doc_id, i))
    SELECT d.doc_id, count(r.i) AS n_lines, count(DISTINCT c) AS n_chunks,
      count(DISTINCT c) FILTER (chunk_gone) AS n_removed_chunks, count(*) FILTER (gone) AS n_removed_lines,
      CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY r.i) FILTER (NOT gone), '') END AS text
    FROM documents d LEFT JOIN result r USING (doc_id) GROUP BY d.doc_id
    """,
)
def op5_line_passages(spark, folder):
    """Whole texts without chunks of lines, or passages of 50 words over short lines, that stand elsewhere."""
    return line_chunks.line_report(documents(spark, folder), runs=True)


@query("op6_quality_model")
def op6_quality_model(spark, folder):
    """Quality scores of whole texts by a model of labelled rows."""
    return quality_model.quality_scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


_SHRUNK = " OR ".join(
    f"({r} + m_{r} * greatest(m_{r} * (1 - m_{r}) / greatest(v_{r}, 1e-6) - 1, 1e-3)) / (n + greatest(m_{r} * (1 - m_{r}) / greatest(v_{r}, 1e-6) - 1, 1e-3)) > 0.5"
    for r in quality_rules.RULES
)


@query(
    "op7_quality_rules",
    rf"""
    WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
    runs AS (SELECT doc_id, k, w[k : k + 2] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) > 2)),
    again AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1),
    covered AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 3)) AS p FROM again) GROUP BY doc_id),
    counted AS (
      SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered USING (doc_id)),
    judged AS (
      SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeats,
        10 * n_symbols > n_words AS symbols, 10 * (len(l) - len(list_distinct(l))) > 3 * len(l) AS dup_lines
      FROM counted),
    hosts AS (SELECT source, count(*) AS n, {", ".join(f"sum(CAST({r} AS INT)) AS {r}" for r in quality_rules.RULES)} FROM judged WHERE source IS NOT NULL GROUP BY source),
    moments AS (SELECT {", ".join(f"avg({r} / n) AS m_{r}, coalesce(var_pop({r} / n), 0) AS v_{r}" for r in quality_rules.RULES)} FROM hosts),
    bad AS (SELECT source, true AS rejected FROM hosts, moments WHERE {_SHRUNK})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
      NOT (few_words OR repeats) AND rejected IS NULL AS kept
    FROM judged LEFT JOIN bad USING (source)
    """,
)
def op7_quality_rules(spark, folder):
    """Counts of whole texts, base rules, and verdicts of hosts."""
    return quality_rules.judge_documents(documents(spark, folder))


@query("op8_license_scan")
def op8_license_scan(spark, folder):
    """Licence phrases and signatures in whole texts."""
    return license_scan.license_report(documents(spark, folder))


@query(
    "op9_minhash",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, w[k : k + least(5, len(w)) - 1] AS sh
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (
      SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
    reach(a, b) AS (SELECT u, v FROM links UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
      least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
    """,
)
def op9_minhash(spark, folder):
    """Near-duplicate groups of whole texts."""
    return minhash.near_duplicates(documents(spark, folder))


def _crc32(number: str) -> str:
    """DuckDB's crc32 of a number's decimal digits, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, x), range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, x: {byte}))"


@query(
    "op11_fat_trie",
    rf"""
    WITH t AS (
      SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
        CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '') AS turn,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 20 AS base, {_crc32("c")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    turns AS (
      SELECT convs.c, 0 AS part, i, turn, words FROM convs JOIN t ON t.c = base AND i < h
      UNION ALL SELECT c, 1, i, turn, words FROM convs JOIN t USING (c) WHERE i >= h),
    lists AS (
      SELECT c, coalesce(list(turn ORDER BY part, i) FILTER (turn IS NOT NULL), []) AS s, coalesce(list(words ORDER BY part, i) FILTER (turn IS NOT NULL), []) AS w
      FROM convs LEFT JOIN turns USING (c) GROUP BY c),
    prefixes AS (SELECT c, len(s) AS m, w, s, unnest(range(0, len(s) + 1)) AS d FROM lists),
    nodes AS (
      SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n, any_value(coalesce(w[d], 0)) AS words,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (m = d), '')) AS ends
      FROM prefixes GROUP BY s[1:d], d),
    children AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY p[1:d - 1]),
    whole AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN children USING (p)),
    below AS (
      SELECT top AS p, sum((n - 1) * words) AS saved, count(*) FILTER (k = 0) AS leaves
      FROM (SELECT p[1:a] AS top, n, words, k FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM whole)) GROUP BY top)
    SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children, leaves AS n_leaves,
      CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
    FROM whole x JOIN below ON below.p = x.p LEFT JOIN whole up ON x.d > 0 AND up.p = x.p[1:x.d - 1]
    """,
)
def op11_fat_trie(spark, folder):
    """Every prefix of the rebuilt conversations, from a z-fast trie."""
    return fat_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


def _leaf_sql(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({f})) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER () AS k
      FROM (SELECT doc_id, coalesce('=' || source, '') AS source, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed FROM documents)),
    tree(t, level, idx, n, h) AS (
      SELECT source, 0, idx, n, leaf FROM leaves
      UNION ALL
      SELECT t, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY t, level, n, idx // 3),
    subroots AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
    top(level, idx, n, h) AS (
      SELECT 0, idx, n, h FROM subroots
      UNION ALL
      SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, n, idx // 3),
    nodes AS (SELECT * FROM tree UNION ALL SELECT NULL, level, idx, n, h FROM top),
    steps AS (
      SELECT a.t, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
      FROM nodes a JOIN nodes b ON a.t IS NOT DISTINCT FROM b.t AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.t, a.level, a.idx),
    walk(k, t, level, idx, h, proof) AS (
      SELECT k, source, 0, idx, changed, '' FROM leaves
      UNION ALL
      SELECT k, walk.t, walk.level + 1, walk.idx // 3, sha256(l || h || r), proof || l || r
      FROM walk JOIN steps ON steps.t = walk.t AND steps.level = walk.level AND steps.idx = walk.idx),
    over AS (SELECT k, walk.h, proof, s.idx, s.h AS subroot FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level DESC) AS last FROM walk) walk JOIN subroots s USING (t) WHERE last = 1),
    climb(k, level, idx, h, proof, subroot) AS (
      SELECT k, 0, idx, h, proof, subroot FROM over
      UNION ALL
      SELECT k, climb.level + 1, climb.idx // 3, sha256(l || h || r), proof || l || r, subroot
      FROM climb JOIN steps ON steps.t IS NULL AND steps.level = climb.level AND steps.idx = climb.idx),
    done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level DESC) AS last FROM climb) WHERE last = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = root AS verified
    FROM leaves JOIN done USING (k), (SELECT h AS root FROM top WHERE n = 1)
    """,
)
def op12_merkle_manifest(spark, folder):
    """Leaves, roots and proofs of all documents, checked after half of the texts were tampered with."""
    return merkle.tampering_report(documents(spark, folder))


@query("op13_hnsw_neighbours")
def op13_hnsw_neighbours(spark, folder):
    """Twenty nearest rows of every twentieth vector, from graphs of all rows."""
    return hnsw.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"))
