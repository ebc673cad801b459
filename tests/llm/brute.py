"""Plain Python versions of the operators, and small awkward tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS_DDL = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, size int, word string, start int, node int, bands int, taken int, copies int, row string, "
    "_row int, _words int, _bad_id int, id int, words int, slice int, copy int"
)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def passage(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(n))


def awkward_texts():
    long = passage(1, 300)
    near = long.replace("w", "w", 1).split(" ")
    near[150] = "changed"
    lines = "\n".join(passage(s, 4) for s in range(10, 16))
    return [
        (1, long), (2, long), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t"), (7, "!!! ??? ###"),
        (8, "!!! ??? ###"), (9, "one two"), (10, "ONE, two."), (11, lines), (12, "Intro\n" + lines + "\nEnd"),
        (13, lines + "\n" + lines), (14, passage(3, 20_000)), (15, "Ünïcödé ÉÀ straße 日本語 ☃ x" * 3),
        (15, "Ünïcödé ÉÀ straße 日本語 ☃ x" * 3), (None, "no id here"), (None, None), (16, "A" * 3000), (17, passage(20, 60)),
        (18, passage(20, 60) + " tail of other words " + passage(21, 30)), (2, "same id, other text"),
    ]


def docs(spark, texts=None):
    """Documents with nulls, repeats, long texts and columns named like the operators' own."""
    texts = awkward_texts() if texts is None else texts
    sources = ["a", "b", None, "Z", "é"]
    rows = [
        (i, t, None if k % 3 else "en", sources[k % 5], None, "x", k, "y", 1, 2, 3, 4, 5, "z", *range(7))
        for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS_DDL)


def contamination(texts, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in texts:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[s:s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def ngrams(text, n=5):
    w = words(text)
    if not w:
        return frozenset([text]) if text else frozenset()
    size = min(n, len(w))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def near_classes(texts, threshold=0.8):
    """Per row (doc_id, class_id, n_links)."""
    sets = [ngrams(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            a = len(sets[i] & sets[j])
            if a and a >= threshold * (len(sets[i]) + len(sets[j]) - a) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    members = {}
    for i, (doc, _) in enumerate(texts):
        members.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in members.items()}
    return [(texts[i][0], least[find(i)], links[i]) for i in range(len(texts))]


def drop_lines(texts, window=3):
    """Per row (doc_id, text, n_lines, n_removed); equal rows are one document."""
    order = sorted({(d is None, d or 0, t or "", t is None) for d, t in texts})
    seen, covered = {}, {}
    for none, d, t, null in order:
        lines = [] if null else t.split("\n")
        for s in range(len(lines) - window + 1):
            if seen.setdefault(tuple(lines[s:s + window]), (none, d, t, s)) != (none, d, t, s):
                covered.setdefault((none, d, t), set()).update(range(s, s + window))
    out = []
    for d, t in texts:
        gone = covered.get((d is None, d or 0, t or ""), set())
        lines = [] if t is None else t.split("\n")
        kept = t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, kept, len(lines), len(gone)))
    return out
