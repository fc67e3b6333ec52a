"""Small corpora with copies, passages and junk, drawn from a fixed seed."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n=9):
    return " ".join("".join(rng.choice(("ta", "ro", "ne", "li", "su", "mek", "an")) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def document(rng, lines=6):
    return "\n".join(sentence(rng, rng.randint(4, 30)) for _ in range(lines))


def corpus(seed=1, n=120):
    """Rows with near copies, exact copies, shared passages, very short, empty and null texts."""
    rng = random.Random(seed)
    texts = [document(rng, rng.randint(1, 12)) for _ in range(n)]
    passage = "\n".join(sentence(rng, 14) for _ in range(7))
    long_line = sentence(rng, 60)
    for i in range(0, 30, 2):
        words = texts[i].split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 60))):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3]] * 40 + [texts[5].upper()]
    texts += [document(rng, 3) + "\n" + passage + "\n" + document(rng, 2) for _ in range(6)]
    texts += [document(rng, 2) + "\n" + long_line + "\n" + document(rng, 2) for _ in range(4)]
    texts += [long_line, "one two", "one two", "One  Two", "three", None, None, "", "", " \n ", "\n\n", "a\nb\na\nb", "The " * 300, "*** " * 60]
    rng.shuffle(texts)
    hosts = ["a", "b", "c", None]
    return [(i, t, "en", hosts[i % 4], len(t or "")) for i, t in enumerate(texts)]


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
