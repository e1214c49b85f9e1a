"""Plain versions of the operators, to compare with on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np


def tables(spark, folder, *names):
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def without_repeats(texts, length):
    """For each text (bytes): size, removed, spans, kept."""
    seen = Counter(x[k : k + length] for x in texts for k in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(x), int(gone.sum()), spans, bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_copies(docs):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text)."""
    docs = sorted(docs, key=lambda d: d[0])
    sets = [shingles(t) for _, t in docs]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links = []
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j > k)
        links += [(k, j) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    root = components(len(docs), links)
    return {d[0]: (len(s), docs[root[k]][0]) for k, (d, s) in enumerate(zip(docs, sets, strict=True))}


def close_vectors(rows, cosine=0.95):
    """{vec_id: (n_links, component_id, kept)} of (vec_id, vector)."""
    rows = sorted(rows, key=lambda r: r[0])
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = []
    rows = [(k, (np.array(v, float) / np.abs(np.array(v, float)).max()).tolist() if g else v) for (k, v), g in zip(rows, good, strict=True)]
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links.append((a, b))
    root = components(len(rows), links)
    degree = Counter(k for link in links for k in link)
    return {r[0]: (degree[k], rows[root[k]][0], root[k] == k) for k, r in enumerate(rows)}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
