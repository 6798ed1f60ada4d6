"""Small corpora with the cases every operator must handle, and brute-force versions."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, row string, hash string"


def words(t):
    return WORD.findall(t or "")


def ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def shingles(t):
    w = words(ascii_lower(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeilnorstuàß") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def text(rng, sentences):
    return " ".join(sentence(rng, rng.randint(4, 14)) for _ in range(sentences))


def documents(seed=5):
    """Rows with exact and near copies, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = [text(rng, rng.randint(2, 30)) for _ in range(60)]
    for k in range(8):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts += [texts[k], " ".join(w), texts[k].upper()]
    texts += [None, "", " \n\t", "one two", "one two", "\x00 <|endoftext|> ‘x’ É́ Σς", text(rng, 900), "na " * 400]
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, len(t or ""), 1, 2, "r", "x") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[5], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def near_components(rows):
    """{doc_id: component} by comparing all pairs."""
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    sets = collections.defaultdict(set)
    for r in rows:
        if r[0] is not None:
            sets[r[0]].add(shingles(r[1]))
    flat = [(d, s) for d, v in sorted(sets.items()) for s in v if s]
    for k, (a, x) in enumerate(flat):
        for b, y in flat[:k]:
            if 100 * len(x & y) >= 85 * len(x | y):
                a1, b1 = root(a), root(b)
                up[max(a1, b1)] = min(a1, b1)
    return {d: root(d) for d in sets}
