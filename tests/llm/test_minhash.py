"""Near-duplicate groups against every pair of shingle sets."""

import random
from itertools import combinations

from corpora import SCHEMA, corpus, lower_ascii, sentence, spaced

from tidegauge.llm import components, minhash


def shingles(text):
    w = spaced(lower_ascii(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(rows):
    """Expected (doc_id, n_shingles, component_id, kept), from all pairs."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_groups_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == groups(rows)


def test_links_across_a_chain_and_a_hot_group(spark):
    """Neighbours of a chain are alike and its ends are not; a hot group has many different near copies."""
    rng = random.Random(5)
    words = sentence(rng, 120).split(" ")
    chain = [" ".join(words[k * 6 : k * 6 + 60]) for k in range(10)]
    base = sentence(rng, 100).split(" ")
    hot = [" ".join(base[:k] + [f"x{j}"] + base[k + 1 :]) for j, k in enumerate(rng.choices(range(100), k=150))]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(chain + hot)]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == groups(rows)


def test_one_row_of_each_group_stays_with_its_columns(spark):
    rows = corpus(3)
    repeated = rows + rows[:5] + [(None, "a b c d e f", None, None, None)] * 2
    frame = spark.createDataFrame(repeated, SCHEMA).withColumnRenamed("n_chars", "n").withColumnRenamed("lang", "root")
    kept = minhash.one_of_each_group(frame)
    assert kept.columns == frame.columns
    want = [i for i, _, _, keep in groups(rows) if keep]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 2


def test_null_ids_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b c d e f g", "", "", 0), (7, "a b c d e f g", "", "", 0), (7, "other text of its own kind here", "", "", 0), (None, "lonely one here again ever after", "", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    rows = sorted(map(str, (tuple(r) for r in minhash.near_duplicates(frame).collect())))
    assert rows == ["(7, 3, 7, True)", "(7, 3, 7, True)", "(None, 2, None, True)", "(None, 3, 7, False)"]
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)], "u long, v long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert components.components(links.limit(0)).count() == 0


def test_frequent_pivots_and_buckets_are_met_in_blocks(spark, monkeypatch):
    """Many copies of different texts that share most shingles: small blocks give the same groups."""
    monkeypatch.setattr(minhash, "MEET", 7)
    rng = random.Random(15)
    base = sentence(rng, 90).split(" ")
    hot = []
    for j in range(120):
        words = list(base)
        for k in rng.sample(range(90), rng.randint(0, 4)):
            words[k] = f"x{j}"
        hot.append(" ".join(words))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(hot)]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == groups(rows)


def test_very_long_texts_and_ties_between_pivots(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(5, long, "", "", 0), (3, long + " end", "", "", 0), (4, "a b c d e f g h", "", "", 0), (2, "a b c d e f g h", "", "", 0), (1, "h g f e d c b a", "", "", 0)]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == groups(rows)
