"""Plain Python versions that the tests compare with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_components(docs, percent=85):
    """{doc_id: (set size, component)}; candidates by an exact prefix filter on the rarest shingles."""
    sets = {i: shingle_set(t) for i, t in docs}
    df = Counter(g for s in sets.values() for g in s)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first, index = {}, defaultdict(list)
    for i in sorted(sets):
        s = frozenset(sets[i])
        if not s:
            continue
        if s in first:
            parent[root(i)] = root(first[s])
            continue
        first[s] = i
        order = sorted(s, key=lambda g: (df[g], g))
        found = set()
        for g in order[: len(s) - -(-percent * len(s) // 100) + 1]:
            found.update(index[g])
            index[g].append(i)
        for j in found:
            if root(i) != root(j) and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i in sorted(sets):
        least.setdefault(root(i), i)
    return {i: (len(sets[i]), least[root(i)]) for i in sets}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contained(text, item, k=5, percent=80):
    """Whether so much of the item's shingles stands in the text; an item under k words must stand in it as a whole."""
    grams, words = shingle_set(item, k), words_of(item)
    if not grams:
        return False
    width = min(k, len(words))
    mine = shingle_set(text, width) if len(words_of(text)) >= width else set()
    return 100 * len(grams & mine) >= percent * len(grams)


def kneser_ney(counts, alphabet, order=4):
    """cost(word): nats of a padded word and of each of its n-gram's probabilities, by dictionaries, for one language."""
    grams = [Counter() for _ in range(order)]
    before = [defaultdict(set) for _ in range(order)]
    for word, n in counts.items():
        chars = "\x02" + word + "\x03"
        for i in range(len(chars)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    g = chars[i - k + 1 : i + 1]
                    if k == order or i - k < 0:
                        grams[k - 1][g] += n  # a whole n-gram, or one at the word's start
                    else:
                        before[k - 1][g].add(chars[i - k])
    for k in range(order - 1):
        for g, chars in before[k].items():
            grams[k][g] += len(chars)
    grams[0] = Counter({g: c for g, c in grams[0].items() if g != "\x02"})
    discount = []
    for g in grams:
        one, two = sum(c == 1 for c in g.values()), sum(c == 2 for c in g.values())
        discount.append(one / (one + 2 * two) if one else 0.5)
    total, kinds = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for k in range(order):
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1

    def probability(g):
        k = len(g) - 1
        lower = probability(g[1:]) if k else 1 / (len(alphabet) + 1)
        if not total[k][g[:-1]]:
            return lower
        return max(grams[k][g] - discount[k], 0) / total[k][g[:-1]] + discount[k] * kinds[k][g[:-1]] / total[k][g[:-1]] * lower

    def cost(word):
        import math

        chars = "\x02" + word + "\x03"
        return -sum(math.log(probability(chars[max(0, i - order + 1) : i + 1])) for i in range(1, len(chars)))

    return cost


def license_labels(words, templates, k=3, near=3, share=0.6):
    """Labels of the verified spans of a text's words, and the largest covered share."""
    found, best = set(), 0.0
    at = defaultdict(list)
    for i in range(len(words) - k + 1):
        at[tuple(words[i : i + k])].append(i)
    for label, text in templates:
        t = text.lower().replace(".", " ").split()
        n = len(t) - k + 1
        diagonals = defaultdict(list)
        for j in range(n):
            for i in at.get(tuple(t[j : j + k]), ()):
                diagonals[i - j].append((i, j))
        spans, last = [], None
        for d in sorted(diagonals):
            places = [i for i, _ in diagonals[d]]
            if last is None or d - last[0] > near or abs(min(places) - last[1]) > n + near:
                spans.append(set())
            spans[-1] |= {j for _, j in diagonals[d]}
            last = d, max(places)
        for s in spans:
            if len(s) / n >= share:
                found.add(label)
                best = max(best, len(s) / n)
    return found, best
