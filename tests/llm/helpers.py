"""Plain forms of what the operators compute, and small tables."""

import math
from collections import Counter


def words(text):
    return (text or "").encode().split()


def five_windows(text):
    w = words(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def classes(rows):
    """{doc_id: (class_id, links)} by comparing every pair."""
    sets = [five_windows(t) for _, t in rows]
    up, links = list(range(len(rows))), Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (least[top(i)], links[i]) for i, (d, _) in enumerate(rows)}


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def item_matches(docs, items):
    """{(doc_id, item_id): similarity} of the best window of the item's words in each text, by trying all windows."""

    def grams(text):
        w = "".join(c for c in (text or "").lower() if not c.isascii() or c.isalnum() or c.isspace()).encode().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else []

    made = {i: grams(t) for i, t in items if grams(t)}
    held = Counter(g for gs in made.values() for g in set(gs))
    weight = lambda g: round(16 * math.log2(2 + len(made) / max(held[g], 1)))
    weights, best = {}, {}
    for d, text in docs:
        own = grams(text)
        near = {g: [i for i, gs in made.items() if g in gs] for g in set(own) & held.keys()}
        for i in {i for found in near.values() for i in found}:
            want, n = Counter(made[i]), min(len(made[i]), len(own))
            for start in range(len(own) - n + 1):
                window = own[start : start + n]
                if any(g in want for g in window):
                    have = Counter(window)
                    both = (have | want).keys()
                    weights |= {g: weight(g) for g in both if g not in weights}
                    low, high = (sum(weights[g] * f(have[g], want[g]) for g in both) for f in (min, max))
                    best[d, i] = max(best.get((d, i), 0), low / high)
    return {k: v for k, v in best.items() if v >= 0.8}
