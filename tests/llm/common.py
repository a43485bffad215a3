"""Small corpora with the hard cases, and brute-force counterparts."""

from __future__ import annotations

import re
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, bucket int, kept string, size string, part string"
WORDS = "the of and alpha beta gamma delta omega river stone light house green winter summer paper".split()


def rows(texts, sources=None):
    out = []
    for i, t in enumerate(texts):
        source = sources[i] if sources else "s"
        out.append((i, t, "en", source, None if t is None else len(t), 1, 2, "x", "y", "z"))
    return out


def table(spark, texts, sources=None):
    return spark.createDataFrame(rows(texts, sources), SCHEMA)


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def near_copy(text, seed, changes):
    r = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in BLANKS.split(lower) if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_by_force(texts, percent=75):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    changed = True
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] > low:
                    label[x], changed = low, True
    return label


HARD = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "ONE two",
    "the same words again and again",
    "the same  words\nagain and AGAIN",
    "the same words again and again",
    "déjà vu — naïve “quotes” 中文 🙂  nbsp line",
    "word " * 3000,
    "x" * 50_000,
    "the " * 500 + "end",
    "<|endoftext|> a  b   c\n\n d\t\te it's I'LL 123,456.78",
    "!!! ??? ...",
    prose(1, 300),
    near_copy(prose(1, 300), 1, 3),
    near_copy(prose(1, 300), 2, 60),
    prose(2, 700),
]
