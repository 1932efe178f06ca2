"""Texts and plain definitions that several test modules share."""

import re

import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp int, node int, label int"

#: Nulls, empty and blank texts, special strings, other scripts, repeated texts, clashing columns.
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "Two words",
    "the quick brown fox jumps over the lazy dog again and again",
    "the quick brown fox jumps over the lazy dog again and again",
    "The Quick brown fox jumps over the lazy dog again and  again",
    "naïve café déjà vu — ünïcödé 日本語 текст \U0001f600 <|endoftext|> x",
    "a\u0085b c\x1cd e　f",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "12345678901234567890 1.2.3.4 +1 (017) 555-7713",
    "word " * 4000,
    "ab" * 20000,
    "\n".join(f"line {i} of a long text with number {i * i}" for i in range(3000)),
]


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", 0, "x", 1, 2, 3) for i, t in enumerate(texts)]


def smallest_reachable(nodes, linked):
    """Of each node the smallest one reachable, by depth-first search."""
    out = {}
    for node in sorted(nodes):
        todo = [node]
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = node
                todo += [other for other in nodes if other not in out and linked(at, other)]
    return out


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


SYLLABLES = {"aa": "ba be bi bo bu da de", "bb": "zka zke vri vro gnu plo", "cc": "ñu ñi llo lla rra éx"}


def word(rng, lang):
    return "".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4)))


def sentence(rng, lang, n=60):
    return " ".join(word(rng, lang) for _ in range(n))
