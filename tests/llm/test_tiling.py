"""Greedy string tiling against a plain search of all matches, and whole documents against tiles of whole texts."""

import random
import time

from strandline.llm import tiling


def plain_tiles(text, item, least):
    """Longest unmarked matches again and again, by looking at all pairs."""
    free_t, free_i = [t >= 0 for t in text], [t >= 0 for t in item]
    out = []
    while True:
        best, found = 0, []
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while j + n < len(item) and i + n < len(text) and free_i[j + n] and free_t[i + n] and item[j + n] == text[i + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n:
                    found.append((j, i))
        if best < least:
            return out
        for j, i in sorted(found):
            if all(free_t[i : i + best]) and all(free_i[j : j + best]):
                out.append((i, j, best))
                free_t[i : i + best] = free_i[j : j + best] = [False] * best


def test_tiles_against_all_pairs():
    rng = random.Random(6)
    for _ in range(400):
        kinds = rng.choice([1, 2, 3, 8])
        text = [rng.randint(-1, kinds) if rng.random() < 0.1 else rng.randint(1, kinds) for _ in range(rng.randint(0, 40))]
        item = [rng.randint(1, kinds) for _ in range(rng.randint(0, 15))]
        least = rng.choice([1, 2, 3, 5])
        assert tiling.tile(text, item, least) == plain_tiles(text, item, least)


def test_documents_against_tiles_of_whole_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 12, 40])))) for i in range(12)] + [(20, None), (21, "! ?")]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items[:12])[1]).split()
            cut = rng.randint(0, len(own))
            parts += rng.choice([[" ".join(own)], [" ".join(own[cut:]), " ".join(own[:cut])], [" ".join(own[:cut])]])
        rng.shuffle(parts)
        docs.append((d if d % 10 else None, " , ".join(parts).upper() if d % 3 else " ".join(parts), d))
    docs += [(500, None, 1), (501, "", 1), docs[3]]
    want = []
    for doc_id, text, _ in docs:
        for item_id, item in items:
            a, b = tiling.tokens(text), tiling.tokens(item)
            number = {t: k for k, t in enumerate(dict.fromkeys(b))}
            least = min(tiling.MATCH, len(b))
            if b and len(b) < tiling.MATCH:
                covered = len(b) if any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1)) else 0
            else:
                covered = sum(t[2] for t in plain_tiles([number.get(t, -1) for t in a], [number[t] for t in b], least)) if b else 0
            if b and covered >= tiling.COVERAGE * len(b):
                want.append((doc_id, item_id, covered))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    got = tiling.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string"), block=40).collect()
    assert sorted([(r.doc_id, r.item_id, r.covered) for r in got], key=str) == sorted(want, key=str) and len(want) > 20
    kept = tiling.keep_clean(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == frame.columns
    leaked = [any(m for b in items for m in tiling.Index([b], tiling.MATCH, tiling.COVERAGE).match(t or "")) for _, t, _ in docs]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([d for (d, _, _), bad in zip(docs, leaked, strict=True) if not bad], key=str)
    assert {d for (d, _, _), bad in zip(docs, leaked, strict=True) if bad} == {w[0] for w in want}


def test_time_of_repetitive_texts():
    start = time.process_time()
    tiling.tile([1] * 40_000, [1] * 400)
    index = tiling.Index([(1, "a " * 400), (2, "b c " * 200)], tiling.MATCH, tiling.COVERAGE)
    assert [m[0] for m in index.match("a " * 100_000 + "b c " * 50_000)] == [1, 2]
    assert time.process_time() - start < 15
