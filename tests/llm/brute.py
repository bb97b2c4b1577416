"""Plain versions of the operators that remove or group, for small corpora."""

import hashlib
import itertools


def brute_words(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(docs, window):
    count = {}
    for _, text in docs:
        data = (text or "").encode()
        for s in range(len(data) - window + 1):
            count[data[s : s + window]] = count.get(data[s : s + window], 0) + 1
    out = {}
    for i, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - window + 1):
            if count[data[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        spans = sum(1 for n, g in enumerate(gone) if g and (n == 0 or not gone[n - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def brute_near(docs, k, percent):
    sets = {}
    for i, text in docs:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (text or "").encode().decode().split()] if text is None or text.isascii() else [x.decode().lower() for x in text.encode().split()]
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
