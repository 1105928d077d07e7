"""Block-max pruning against exhaustive scoring, on a shard of many blocks."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import search


def corpus(seed, n=900):
    """Texts in three vocabularies of their own, some copies, some empty, one very long."""
    rng = random.Random(seed)
    groups = [[f"{g}{i}" for i in range(400)] for g in "xyz"]
    texts = [" ".join(rng.choices(groups[i % 3], weights=[1 / (r + 1) for r in range(400)], k=rng.randint(1, 60))) for i in range(n)]
    for i in range(0, 60, 7):
        texts[i] = texts[3]
    texts[11], texts[12] = "", " \n"
    texts[13] = " ".join(rng.choices(groups[0], k=20_000))
    return texts


def bag(text):
    return Counter(text.split())


@pytest.mark.parametrize("small", [{}, {"BLOCK": 16, "DENSE": 8, "SPARSE": 4, "LEAD": 1, "CHUNK_WORDS": 50}, {"BLOCK": 8, "DENSE": 0}, {"BLOCK": 32, "LEAD": 4, "CHUNK_QUERIES": 3}])
def test_shard_against_all_scores(monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(search, name, value)
    texts, k = corpus(1), 10
    ids = [None if i % 100 == 99 else (1 << 63) - 1 - i if i % 50 == 7 else -i for i in range(len(texts))]
    bags = [bag(t) for t in texts]
    size = [sum(b.values()) for b in bags]
    mean, df = sum(size) / len(size), Counter(w for b in bags for w in b)
    parts = [search._postings(texts[a : a + 250], a) for a in range(0, len(texts), 250)]
    shard = search.Shard(search.pack(parts, ids), mean)
    chosen = list(range(0, len(texts), 9))
    term, doc, times, _ = search._postings([texts[i] for i in chosen], 0)
    order = np.argsort(doc, kind="stable")
    q = search.Queries([(np.array(chosen), np.bincount(doc, minlength=len(chosen)), term[order], times[order])])
    counts = {search._postings([w], 0)[0][0]: n for w, n in df.items()}
    q.weigh(np.array([counts[t] for t in q.wanted]), len(texts))
    got, lists = {}, {}
    for n, d, s in shard.search(q, k, np.zeros(len(chosen))):
        for i, j, x in zip(n.tolist(), d.tolist(), s.tolist(), strict=True):
            got.setdefault(chosen[i], []).append((None if shard.null[j] else int(shard.ids[j]), round(x, 6)))
    idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for i in chosen:
        found = []
        for j, b in enumerate(bags):
            s = sum(m * idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size[j] / mean)) for w, m in bags[i].items() if w in b)
            if s > 0:
                found.append((-round(s, 9), ids[j] is None, ids[j]))
        lists[i] = [(x[2], round(-x[0], 6)) for x in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
        assert got.get(i, []) == lists[i]
    if small:
        assert shard.skipped > shard.seen / 4
    # A threshold from elsewhere leaves out only what doesn't reach it.
    floor = np.array([lists[i][4][1] if len(lists[i]) > 4 else 0.0 for i in chosen])
    shard.seen = shard.skipped = 0
    again = Counter()
    for n, _, s in shard.search(q, k, floor):
        again.update(n[s >= floor[n] - 1e-6].tolist())
    assert all(again[n] >= 5 for n, i in enumerate(chosen) if len(lists[i]) > 4)
    if small:
        assert shard.skipped > shard.seen / 3
