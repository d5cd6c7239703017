"""Plain restatements of the contracts, for small tables."""

import collections
import hashlib
import math
import re
import zlib

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def near_duplicates(docs, k, percent=80):
    """{id: (set size, component)} over (id, text)."""
    sets, parent = {}, {}
    for d, text in docs:
        w = words(text, True)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def repeats(docs, length):
    """{id: (words, removed, digest of what is kept)}; a null id is larger than any."""
    first, split = {}, {}
    for d, text in docs:
        split[d] = words(text)
        for i in range(len(split[d]) - length + 1):
            key = tuple(split[d][i : i + length])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def word_scores(docs):
    """{id: (tokens, known, N, base score)}."""
    count, split = collections.Counter(), {}
    for d, text in docs:
        split[d] = [*words(text, True), None]
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(split[d])
    n, v = sum(count.values()), len(count)
    return {d: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, w in split.items()}


def base_secrets(text):
    kinds = (
        ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12, 1),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
        ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
    )
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, least, group) in enumerate(kinds) for m in p.finditer(text or "") if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(found))
