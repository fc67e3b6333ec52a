"""Words of flat byte arrays: hashes by lane, numbers by bytes."""

import numpy as np
import pyarrow as pa
from corpora import SCHEMA

from tidegauge.llm import bytewords, minhash, token_files


def thue_morse(n):
    """Two words of ``n`` letters whose difference defeats every power sum modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def words_of(*texts):
    return bytewords.Words(*bytewords.text_bytes(pa.array(texts)), bytewords.NON_SPACE)


def test_equal_words_have_equal_hashes_anywhere():
    words = words_of("alpha beta x", "x  alpha", "y" * 17 + " beta", None, "")
    names = [words.lower[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    hashes = words.hashes().tolist()
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert (hashes[i] == hashes[j]) == (a == b)
    assert len(words_of("", None).hashes()) == 0 and words_of(" ").distinct()[0] == []


def test_words_that_differ_in_length_by_zero_bytes():
    words = words_of("ab\0", "ab", "ab\0\0", "ab" + "\0" * 8)
    assert len(set(words.hashes().tolist())) == 4 and len(words.distinct()[0]) == 4


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bytewords.Words, "hashes", lambda self, seed=1, lanes=None: np.zeros(len(self), np.uint64))
    found, which = words_of("one two three one", "two four").distinct()
    assert [found[i] for i in which] == [b"one", b"two", b"three", b"one", b"two", b"four"]
    assert sorted(found) == sorted(set(found))
    one = minhash.exact_shingles(words_of("a b c d e f", "b c d e f g", "a b"))
    assert len(set(zip(*map(np.ndarray.tolist, one)))) == 5 and len(set(one[1].tolist())) == 4


def test_power_sum_collisions_change_no_ids_and_make_no_link(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.vocabulary("word_bpe_49k.json"))
    encoder = token_files.ChunkEncoder("word_bpe_49k.json")
    rows = []
    for n in (1024, 2048, 4096):
        pair = thue_morse(n)
        hashes = words_of(*pair).hashes()
        assert hashes[0] != hashes[1]
        ids, sizes = encoder.encode(*bytewords.text_bytes(pa.array([" ".join(pair), pair[1]])), 2)
        for got, text in zip(np.split(ids, np.cumsum(sizes)[:-1]), (" ".join(pair), pair[1])):
            assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
        rows += [(10 * n + i, word, "en", "s", n) for i, word in enumerate(pair)]
        rows += [(10 * n + 2 + i, "the same words stand around " + word + " here", "en", "s", n) for i, word in enumerate(pair)]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {r[0]: r[0] for r in rows}


def test_memory_is_bounded_by_bytes():
    from tidegauge.llm.shared import Memory

    memory = Memory(100_000)
    for i in range(200):
        wanted = {b"%d" % i + b"x" * 5000}
        memory.now.update(dict.fromkeys(memory.missing(wanted), b"y" * 5000))
        held = sum(len(k) + len(v) for part in (memory.now, memory.old) for k, v in part.items())
        assert held < 130_000
    assert not memory.missing(wanted)


def test_memory_is_asked_without_a_walk_over_the_old_values():
    from tidegauge.llm.shared import Memory

    class Old(dict):
        def __iter__(self):
            raise AssertionError("the old values are walked")

    memory = Memory(100_000)
    memory.old = Old((b"%d" % i, b"y") for i in range(1000))
    assert memory.missing({b"7", b"x"}) == {b"x"} and memory.now == {b"7": b"y"}
