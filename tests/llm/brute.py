"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GAP = "[ \t-\r]+"


def words(text):
    return [w for w in re.split(GAP, (text or "").translate(LOWER)) if w]


def shingles(text, n=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def component_ids(rows):
    """Smallest id that links lead to, for rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                up[root(i)] = root(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(i)] = min(doc_id, lowest.get(root(i), doc_id))
    return [lowest.get(root(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def cut_lines(rows, least=50):
    """{id: text} without lines of runs that occurred before; ids are distinct and in order."""
    places = []
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [(i, re.sub("^[ \t-\r]+|[ \t-\r]+$", "", x)) for i, x in enumerate(lines)]
        places.append((doc_id, lines, [(i, x) for i, x in full if x]))
    seen, gone = set(), {}
    for doc_id, lines, full in places:
        n = [len(words(x)) for _, x in full]
        cut = set()
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                if sum(n[a:b]) < least:
                    continue
                run = tuple(x for _, x in full[a:b])
                if run in seen:
                    cut |= set(range(a, b))
                else:
                    seen.add(run)
        at = sorted(cut)
        drop = set()
        for k, p in enumerate(at):
            drop.add(full[p][0])
            if k and at[k - 1] == p - 1:
                drop |= set(range(full[at[k - 1]][0], full[p][0]))
        gone[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    return gone


def contained(text, item):
    w, q = words(text), words(item)
    if not q:
        return False
    n = min(5, len(q))
    own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    asked = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)}
    return 4 * len(own & asked) >= 3 * len(asked)
