"""Brute-force versions and odd tables for the tests of the training-data operators."""

import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def shingles(s, n=5):
    w = WORDS.findall(lower_ascii(s))
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def similar_groups(rows):
    """(row number, id, text) -> {row number: (n_shingles, component id)} by comparing all rows that share a shingle."""
    sets = {r: shingles(t) for r, _, t in rows}
    ids = {r: i for r, i, _ in rows}
    up = {r: r for r in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for r, s in sets.items():
        shared = Counter(q for h in s for q in having[h])
        for q, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[q]) - k):
                up[root(r)] = root(q)
        for h in s:
            having[h].append(r)
    low = defaultdict(list)
    for r in sets:
        low[root(r)].append(ids[r])
    return {r: (len(sets[r]), min((i for i in low[root(r)] if i is not None), default=ids[r]) if len(low[root(r)]) > 1 else ids[r]) for r in sets}


def odd_texts():
    """Texts with nulls, blanks, a very long one, copies and near copies."""
    import random

    rnd = random.Random(5)
    pick = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(n))
    base = pick(120)
    words = base.split()
    out = [None, "", "   \n\t ", "word", "Two words", base, base, base.upper()]
    for share in (2, 5, 9, 14, 25, 40):
        own = words[:]
        for k in rnd.sample(range(len(own)), share):
            own[k] = pick(1)
        out.append(" ".join(own))
    for size in (3, 4, 5, 6, 9, 20, 45, 60, 64, 70, 90, 130, 300):
        text = pick(size)
        out += [text, text + " " + pick(1), pick(1) + " " + text, text + " " + pick(max(1, size // 4))]
    out.append(pick(30000))
    out += [pick(rnd.randint(1, 200)) for _ in range(40)]
    return out
