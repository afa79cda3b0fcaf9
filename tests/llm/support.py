"""Small document tables and brute-force versions of the operators."""

import hashlib
import math
import random
import re

from termloom.llm import decontaminate, jaccard, mixing, quality
from termloom.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").lower())


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def prose(r, n, size=400):
    return " ".join("".join(r.choices("abcdefghij", k=3)) if size > 900 else f"w{r.randrange(size)}" for _ in range(n))


def make(texts, start=1, sources=("web", "news", "code")):
    return [(start + i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]


def features(text, n=jaccard.NGRAM):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similar_pairs(rows, threshold=jaccard.THRESHOLD):
    held = [(r[0], features(r[1])) for r in rows if r[0] is not None and r[1] is not None]
    held = [x for x in held if x[1]]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(held) for b, y in held[i + 1 :] if a != b and len(x & y) / len(x | y) >= threshold - 1e-9}


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    by = {}
    for x in root:
        by.setdefault(find(x), []).append(x)
    return {k: sorted(v) for k, v in by.items() if len(v) > 1}


def rejected(text):
    if text is None or not text.strip(" "):
        return True
    share = lambda chars: sum(c in chars for c in text) / len(text)
    w, lines = text.replace("\n", " ").split(" "), text.split("\n")
    return (
        share(quality.SYMBOLS) > quality.MAX_SYMBOLS
        or share(quality.CAPITALS) > quality.MAX_CAPITALS
        or share(quality.DIGITS) > quality.MAX_DIGITS
        or len(text) / (sum(c in " \n" for c in text) + 1) > quality.MAX_WORD_CHARS
        or (len(lines) - len(set(lines))) / len(lines) > quality.MAX_REPEATED_LINES
        or sum(a == b for a, b in zip(w, w[1:])) / len(w) > quality.MAX_REPEATED_WORDS
    )


def leaked(text, items, max_words=decontaminate.MAX_WORDS, coverage=decontaminate.MAX_COVERAGE, min_words=decontaminate.MIN_WORDS):
    """Merged word ranges of the text that are over a limit in some item."""
    w = words(text)
    held = {tuple(words(x)) for x in items} - {()}
    size = {}  # substring -> words of the shortest item that holds it
    for item in held:
        for i in range(len(item)):
            for j in range(i + 1, len(item) + 1):
                size[item[i:j]] = min(size.get(item[i:j], 1 << 30), len(item))
    found = []
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            own = size.get(tuple(w[i:j]))
            if own is None:
                break
            if j - i >= min(max_words, max(min_words, math.ceil(coverage * own - 1e-9))):
                found.append((i, j))
    return decontaminate.merge(found)


def mixed(rows, temperature=mixing.TEMPERATURE, seed=mixing.SEED):
    """Row -> copies, by one walk over each source."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    size = {s: sum(max(0, r[4] or 0) for r in own) for s, own in by.items()}
    weight = {s: round(x**temperature, 3) if x > 0 else 0.0 for s, x in size.items()}
    out = []
    for s, own in by.items():
        if not size[s]:
            continue
        units = round(weight[s] * sum(size.values()) / sum(weight.values()) / size[s] * mixing.UNIT)
        at = int(hashlib.md5(f"{seed}:{s or ''}".encode()).hexdigest()[:8], 16) * mixing.UNIT // (1 << 32)
        for r in sorted(own, key=lambda r: hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()):
            copies = (at + units) // mixing.UNIT - at // mixing.UNIT
            at += units
            out += [r] * copies
    return out


def near_copies(seed=3, groups=12, alone=40):
    r = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = prose(r, r.choice((8, 30, 120, 500))).split()
        for _ in range(r.randint(2, 6)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(99)}"
            texts.append(" ".join(copy))
    texts += [prose(r, r.choice((5, 20, 90))) for _ in range(alone)]
    r.shuffle(texts)
    return texts


def squeeze(text):
    return re.sub(r"\s+", " ", text or "").strip()
