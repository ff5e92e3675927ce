"""Plain versions of what the operators compute, by the book."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, fold=True):
    return WORD.findall(lower(text) if fold else text or "")


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def classes(texts, size, percent):
    """id -> smallest id reachable by links, from {id: text}."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            share = len(sets[a] & sets[b])
            if share and 100 * share >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets
