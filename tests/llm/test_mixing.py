"""Mixing against a selection made in plain Python, row by row."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from strandline.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, whole string, _place int, last int"


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) + f" t{rng.randint(0, 9)}", rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src3", "blog", None]), "x", 1, 2) for i in range(150)]
    rows += [(1, "one id two texts here", "en", "src1", "y", 1, 2)] * 40 + [(1, "one id and another", "en", "src1", "y", 1, 2)] * 7
    rows += [(None, "no id", "en", "src2", "z", 1, 2), (None, None, None, None, None, None, None), (5, "", "de", "src3", "", 0, 0), (6, "long " * 900, "fr", "src2", "", 0, 0)]
    return rows


def choose(rows, budget, seed=mixing.SEED):
    """Copies of each (id, text, lang, source), by hand."""
    def domain(source):
        m = re.search(r"([0-9]{1,9})$", source)
        return mixing.DOMAINS[int(m[1]) % 4 if m else 0]

    def fill(caps, weights, given):
        out, open_ = {}, dict(caps)
        while open_:
            level = given / sum(weights(k) for k in open_)
            full = [k for k in open_ if open_[k] <= level * weights(k) + 1e-9]
            if not full:
                return out | {k: level * weights(k) for k in open_}
            for k in full:
                out[k] = open_.pop(k)
                given -= out[k]
        return out

    leaves = {}
    for r in rows:
        source = r[3] or ""
        leaves.setdefault((domain(source), r[2] or "", source), []).append(r)
    size = {k: sum(len((r[1] or "").split()) for r in v) for k, v in leaves.items()}
    cap = lambda p: mixing.EPOCHS * sum(v for k, v in size.items() if k[: len(p)] == p)
    budget = sum(size.values()) if budget is None else budget
    chosen = Counter()
    tops = fill({(k[0],): cap((k[0],)) for k in size}, lambda k: mixing.DOMAIN_WEIGHTS.get(k[0], 1), budget)
    for top, given in tops.items():
        langs = fill({k[:2]: cap(k[:2]) for k in size if k[:1] == top}, lambda k: mixing.LANG_WEIGHTS.get(k[1], 1), given)
        for lang, share in langs.items():
            for leaf, b in fill({k: cap(k) for k in size if k[:2] == lang}, lambda k: 1, share).items():
                b = math.floor(b + 1e-9)
                whole, rest = divmod(b, size[leaf]) if size[leaf] else (0, b)
                md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
                order = sorted(leaves[leaf], key=lambda r: md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}") + md5(r[1] or ""))  # noqa: B023
                held, more = 0, True
                for r in order:
                    held += len((r[1] or "").split())
                    more = more and held <= rest
                    chosen[r[:4]] += whole + more
    return +chosen


@pytest.mark.parametrize("budget", [None, 0, 300, 1200, 2500, 100_000])
def test_choice_by_hand(spark, monkeypatch, budget):
    rows = rows_of(3)
    if budget in (300, 2500):
        monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = choose(rows, budget)
    got = Counter()
    for r in mixing.mixed(docs, budget=budget).collect():
        assert len(r) == len(SCHEMA.split(", "))
        got[r.doc_id, r.text, r.lang, r.source] += 1
    assert got == want
    chosen = mixing.mix(docs, budget=budget).collect()
    ids = Counter()
    for r in chosen:
        ids[r.doc_id, r.n_tokens] += r.copies
    assert ids == Counter({k: v for k, v in ((k, sum(v for r, v in want.items() if (r[0], len((r[1] or "").split())) == k)) for k in {(r[0], len((r[1] or "").split())) for r in want})})
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(r.n_tokens * r.copies for r in chosen) <= (total if budget is None else budget)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns and mixing.mixed(empty).count() == 0
