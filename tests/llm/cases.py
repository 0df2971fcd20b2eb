"""Small documents with the awkward cases, and brute-force versions of the operators."""

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base_text(seed, n):
    rng = np.random.default_rng(seed)
    syllables = "ra to mi lu ne sa ko pe di wu".split()
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


def documents():
    """Copies, near copies, shared passages, NULLs, blanks, a long text and repeated rows."""
    shared, body = base_text(1, 60), base_text(2, 300)
    near = body.split()
    near[7] = "changed"
    texts = [
        body, body, " ".join(near), body.upper(), shared + " " + base_text(3, 40), base_text(4, 50) + "\t" + shared, shared + "\n" + shared,
        "a b c", "A B C", "one", None, "", " \n\t ", "123 456 --- 789", "é" * 120 + " ünï " * 30, base_text(5, 20000), "aaaa " * 200, "x" * 5000,
        base_text(6, 36), base_text(6, 35), base_text(6, 34) + " z",
    ]
    rows = [(k, t, ["en", "de", None][k % 3], ["s1", "s2", None, "ä"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[0], (None, body + " tail", "en", None, None), (None, "one", None, "s1", None)]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def key_of(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def cut_bytes(rows, window=50):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - window + 1):
            w = data[i: i + window]
            first[w] = min(first.get(w, 2**63 - 1), key_of(d))
    out = []
    for d, t in rows:
        data, edge = (t or "").encode(), np.zeros(len((t or "").encode()) + 1, int)
        for i in range(len(data) - window + 1):
            if first[data[i: i + window]] < key_of(d):
                edge[i] += 1
                edge[i + window] -= 1
        gone = np.cumsum(edge)[: len(data)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(data), int(gone.sum()), spans, sha(bytes(np.frombuffer(data, np.uint8)[~gone]))))
    return out


def cut_words(rows, window=35):
    """(doc_id, n_words, n_removed, kept words joined by a blank) per row."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i: i + window])] += 1
    out = []
    for (d, _), w in zip(rows, words):
        edge = np.zeros(len(w) + window + 1, int)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i: i + window])] > 1:
                edge[i] += 1
                edge[i + window] -= 1
        gone = np.cumsum(edge)[: len(w)] > 0
        out.append((d, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows):
    """Component number per row by comparing all pairs; rows without words stay alone."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def components(rows):
    """(doc_id, n_shingles, component_id) per row."""
    sets, owner = groups(rows)
    least = {}
    for (d, _), o in zip(rows, owner):
        if d is not None:
            least[o] = min(least.get(o, d), d)
    return [(d, len(s), least.get(o) if s else d) for (d, _), s, o in zip(rows, sets, owner)]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
