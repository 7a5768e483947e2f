"""Plain versions of the pair operators for small inputs."""

import re


def groups(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard(texts):
    """id -> (size, component) by an inverted index over shingles, exactly."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in index.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = groups(links, sets)
    return {i: (len(s), root[i]) for i, s in sets.items()}
