"""Plain versions of the operators, and small tables with odd rows, for the tests."""

import random
import re

SCHEMA = "doc_id long, text string, key string, bucket long, class string, label int, kind string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = tokens(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k: k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def odd_docs(seed=7):
    """Rows with nulls in any column, empty, blank, repeated, copied, edited and long texts, and clashing column names."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" if k % 3 else f"wört{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(40)
    texts = [None, "", "  \t\n ", "one", "ONE", "two words", say(300), say(4000), say(60), say(60)]
    texts += [texts[6], texts[6].replace(" ", "  "), texts[6].upper(), f"{say(20)} {passage} {say(30)}", f"{say(5)} {passage}", passage]
    base = say(120).split()
    for k in range(1, 9):  # near copies that drift away from the first
        base[k * 3] = f"edit{k}"
        texts.append(" ".join(base))
    rows = [(k, t, "x", 1, None, None, "chunk") for k, t in enumerate(texts)]
    rows += [(6, texts[6], None, None, "y", 3, None), (8, texts[9], "z", 2, "q", 0, "words"), (None, texts[7], "n", 1, "n", 1, "n"), (None, None, "n", 1, "n", 1, "n")]
    rng.shuffle(rows)
    return rows
